"""The n-gram Jaccard join against all pairs."""

import brute
import numpy as np
import pytest

from cohortloom.llm import ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def all_pairs(rows, threshold=0.8):
    sets = [brute.shingle_set(r[1]) for r in rows]
    n = len(rows)
    group, links = list(range(n)), [0] * n
    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    near = {(a, b) for who in index.values() for k, a in enumerate(who) for b in who[k + 1 :]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            group[find(a)] = find(b)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], min(ids) if ids else None, links[i]))
    return sorted(out, key=str)


def near_copies():
    """Copies with a growing number of changed words, around the threshold."""
    rng = np.random.default_rng(3)
    rows = brute.awkward_documents()
    for base in range(12):
        words = [f"w{base}x{i}" for i in range(int(rng.integers(40, 200)))]
        for k in range(7):
            copy = list(words)
            for _ in range(k):
                copy[int(rng.integers(len(copy)))] = f"changed{base}{k}"
            rows.append((1000 + base * 10 + k, " ".join(copy), "en", "src0", 0))
    return rows


def links(df, **options):
    out = ngram_join.near_duplicates(df, **options).select("doc_id", "class_id", "n_links")
    return sorted((tuple(r) for r in out.collect()), key=str)


# 160 bands: the pairs of the fixture just above 0.8 must not depend on luck
@pytest.mark.parametrize("options", [{"bands": 160}, {"bands": 160, "tile_bytes": 3000}])
def test_all_links(spark, options):
    rows = near_copies()
    assert links(spark.createDataFrame(rows, SCHEMA), **options) == all_pairs(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert links(spark.createDataFrame(rows, SCHEMA)) == all_pairs(rows)


def test_dense_group_in_blocks(spark):
    words = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):
        copy = list(words)
        copy[k] = f"other{k}"
        rows.append((k, " ".join(copy), None, None, None))
    got = links(spark.createDataFrame(rows, SCHEMA), tile_bytes=20_000)
    assert got == all_pairs(rows)


def variants(n, changes, seed=0):
    """Texts of 300 words with ``changes[k % len]`` words of their own each."""
    rng = np.random.default_rng(seed)
    words = [f"s{seed}w{i}" for i in range(300)]
    rows = []
    for k in range(n):
        copy = list(words)
        for j in range(changes[k % len(changes)]):
            copy[int(rng.integers(300))] = f"own{seed}k{k}j{j}"
        rows.append((10_000 * seed + k, " ".join(copy), None, None, None))
    return rows


@pytest.mark.parametrize("changes", [[1, 1, 2], [0, 1, 2, 3, 4, 6, 8, 10], [9], [14, 1]])
def test_dense_groups_of_all_kinds(spark, changes):
    """Members in and out of the core, copies, groups without a core, several groups at once."""
    rows = variants(150, changes, 1) + variants(60, [2], 2) + variants(40, [30], 3) + near_copies()
    rows += [(90_000 + k, rows[k][1], None, None, None) for k in range(0, 150, 4)]
    got = links(spark.createDataFrame(rows, SCHEMA), bands=160, tile_bytes=30_000)
    assert got == all_pairs(rows)


def test_a_dense_group_moves_its_sets_once(spark, monkeypatch):
    """Four times the members move about four times the bytes, not sixteen times."""
    moved, tiles = [], ngram_join._tiles

    def watched(members, threshold):
        moved.append(members.selectExpr("sum(octet_length(shingles)) AS n").first().n or 0)
        return tiles(members, threshold)

    monkeypatch.setattr(ngram_join, "_tiles", watched)
    for n in (300, 1200):
        # nine in ten near the pivot, the rest further away
        rows = variants(n, [1, 2, 1, 2, 1, 2, 1, 2, 1, 10], 5)
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile_bytes=600_000)
        assert got.agg({"n_links": "max"}).first()[0] > n / 2
    assert 0 < moved[1] < 6 * moved[0]


def test_bucket_of_many_classes(spark):
    classes = spark.range(70_001).selectExpr(
        "id AS class", "5 AS shingles", "IF(id < 70000, array(1L, 2L, id + 10), array(3L)) AS bands"
    )
    got = ngram_join._buckets(classes, ngram_join.TILE_BYTES)
    # both buckets have the same members and count once
    assert [tuple(r) for r in got.groupBy("bucket", "dense").count().collect()] in ([(1, True, 70_000)], [(2, True, 70_000)])


def test_keep_one(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = ngram_join.keep_one(df, bands=160)
    assert kept.columns == df.columns
    got = kept.collect()
    # the lonely text with a null id is a class of its own
    want = {c for _, c, _ in all_pairs(rows)}
    assert {r.doc_id for r in got} == want
    worded = [r.doc_id for r in got if brute.split(r.text)]
    # id 10 names two different texts
    assert len(worded) == len(set(worded)) + 1


def test_empty_and_edge(spark):
    assert links(spark.createDataFrame([], SCHEMA)) == []
    assert ngram_join.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f", 2, 3), (2, "a b c d e f", 2, 3)], "doc_id long, text string, class long, n_links int")
    assert links(clash) == [(1, 1, 1), (2, 1, 1)]
