"""The pipeline stage by stage against plain versions, and the registered queries against their SQL."""

import re
from collections import Counter

import brute
import duckdb
import pytest
from oracle import compare
from test_decontaminate import plain as leaks
from test_ngram_join import all_pairs
from test_packing import check
from test_quality import plain as quality_plain

import __spark_entry__ as entry
import corpus_pipeline
from cohortloom.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def passages(data):
    """Maximal stretches of 180-byte strings that start earlier too, with 51 whole words or more."""
    out = []
    for s, c in zip(data, brute.covered(data, 180, keep_first=True), strict=True):
        edges = [i for i in sorted(c) if i - 1 not in c], [i + 1 for i in sorted(c) if i + 1 not in c]
        out.append([])
        for lo, hi in zip(*edges, strict=True):
            inside = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", s) if lo <= m.start() and m.end() <= hi]
            if len(inside) >= 51:
                out[-1].append((lo, hi))
    return out


def without(s, spans):
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(s[at:lo].decode(errors="ignore"))
        at = hi
    return "".join([*kept, s[at:].decode(errors="ignore")])


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = stages[name](spark, df, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    first = step("quality_rules", docs)
    rows = rows_of(docs)
    want = {r[0] for r in quality_plain(rows, 5, 0.1) if r[-1]}
    assert {r[0] for r in rows_of(first)} == want and first.columns == docs.columns

    second = step("ngram_jaccard_join", first)
    assert sorted(r[0] for r in rows_of(second)) == sorted({c for _, c, _ in all_pairs(rows_of(first))})

    third = step("suffix_array_dedup", second)
    before = {r.doc_id: r.text for r in second.collect()}
    order = [r.doc_id for r in second.selectExpr("doc_id", "xxhash64(text) k").orderBy("doc_id", "k").collect()]
    data = [(before[d] or "").encode() for d in order]
    cut = passages(data)
    after = {r.doc_id: r.text for r in third.collect()}
    for d, s, spans in zip(order, data, cut, strict=True):
        assert after[d] == without(s, spans) if spans else after[d] == before[d]
    assert any(cut)

    fourth = step("benchmark_decontamination", third)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {d for d, *_ in leaks(rows_of(third), items)}
    assert {r[0] for r in rows_of(fourth)} == {r[0] for r in rows_of(third)} - hit

    fifth = step("best_fit_packing", fourth)
    used, least = check(rows_of(fourth), fifth.collect(), 2048)
    assert used <= least * 1.05 + 2


def test_passage_of_51_words_is_cut(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    assert len(passage) < 200
    ahead = [" ".join(f"{k}w{i}w{k}" for i in range(90)) for k in range(3)]
    after = [" ".join(f"{k}v{i}v{k}" for i in range(90)) for k in range(3)]
    # one word less than 51 may repeat
    short = passage.rsplit(" ", 1)[0]
    texts = [f"{ahead[k]} {p}\n{after[k]}" for k, p in enumerate([passage, passage, short])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)], schema)
    for name, stage in corpus_pipeline.STAGES:
        if name == "benchmark_decontamination":
            break
        docs = stage(spark, docs, FOLDER)
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    # the white space around the passage is the same in both places
    want = {**dict(enumerate(texts)), 1: f"{ahead[1]}{after[1]}"}
    assert {k: re.sub(r"\s", "", t) for k, (t, _) in got.items()} == {k: re.sub(r"\s", "", t) for k, t in want.items()}
    assert all(n == len(t) for t, n in got.values())


def test_passages_of_awkward_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = brute.awkward_documents()
    docs = spark.createDataFrame(rows, schema)
    stage = dict(corpus_pipeline.STAGES)["suffix_array_dedup"]
    # rows equal in id and text share one place
    keys = docs.selectExpr("doc_id", "xxhash64(text) k", "text").distinct().collect()
    order = sorted(keys, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.k))
    data = [(r.text or "").encode() for r in order]
    cut = passages(data)
    want = {(r.doc_id, without(s, c) if c else r.text) for r, s, c in zip(order, data, cut, strict=True)}
    got = stage(spark, docs, FOLDER).collect()
    assert {(r.doc_id, r.text) for r in got} == want
    assert len(got) == len(rows) and any(cut)


def test_run_on_awkward_documents(spark, tmp_path):
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, row int"
    docs = spark.createDataFrame([(*r, "x", 1) for r in brute.awkward_documents()], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 10
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
    assert Counter(corpus_pipeline.run(spark, folder).columns)["doc_id"] == 1
