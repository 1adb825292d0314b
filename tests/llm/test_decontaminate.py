"""Containment of benchmark items against brute force."""

import brute
import pytest

from cohortloom.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, items, threshold=0.8):
    sets = [brute.shingle_set(t) for _, t in items]
    out = set()
    for r in rows:
        own = brute.shingle_set(r[1])
        for (item, _), s in zip(items, sets, strict=True):
            if s and len(s & own) >= threshold * len(s):
                out.add((r[0], item, len(s), len(s & own)))
    return out


def found(docs, items, **options):
    out = decontaminate.contained_items(docs, items, **options)
    return {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in out.collect()}


def fixture():
    rows = brute.awkward_documents()
    items = [(i, " ".join(f"item{i}w{j}" for j in range(3 + 5 * i))) for i in range(12)]
    for i, (_, text) in enumerate(items):
        words = text.split()
        filler = [f"f{i}x{j}" for j in range(3000)]
        rows.append((2000 + i, " ".join(filler[:1500] + words + filler[1500:]), None, None, None))
        words[len(words) // 2] = "changed"
        rows.append((2100 + i, " ".join(filler[:50] + words), None, None, None))
        rows.append((2200 + i, " ".join(words[: len(words) // 2] + filler + words[len(words) // 2 :]), None, None, None))
    items += [(None, rows[5][1][:400]), (77, None), (78, " "), (5, "same id again and again and"), items[6], (79, "one")]
    rows.append((2300, "one", None, None, None))
    return rows, items


@pytest.mark.parametrize("most_broadcast", [1 << 20, 0])
def test_awkward(spark, most_broadcast):
    rows, items = fixture()
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(docs, bench, most_broadcast=most_broadcast) == plain(rows, items)


@pytest.mark.parametrize("most_broadcast", [1 << 20, 0])
def test_repeated_rows_give_one_row(spark, most_broadcast):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"before {item} after"), (1, f"before {item} after"), (None, item), (None, item), (1, f"other {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = decontaminate.contained_items(docs, bench, most_broadcast=most_broadcast).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and len({r.text_key for r in got}) == 3


@pytest.mark.parametrize("sketch", [4, 32])
def test_partitions_decide(spark, sketch):
    """Items of every size at 0.8 or a little below: the partition's plan must find all, the check drops the rest."""
    items, rows = [], []
    for i, n in enumerate([5, 9, 16, 33, 63, 64, 127, 128, 300, 1000]):
        words = [f"i{i}w{j}" for j in range(n + 4)]
        items.append((i, " ".join(words)))
        for k, share in enumerate([1.0, 0.9, 0.82, 0.78]):
            rows.append((10 * i + k, " ".join([f"f{i}{k}{j}" for j in range(900)] + words[: round(share * n) + 4])))
    plans = [decontaminate.partition_plan(p, sketch, 0.8) for p in range(11)]
    assert len(set(plans)) > 6 and all(n < k for k, n in plans)
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(docs, bench, sketch=sketch) == plain(rows, items)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert found(docs, bench) == want and want


def test_clean_and_empty(spark):
    rows, items = fixture()
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {d for d, *_ in plain(rows, items)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[0] not in hit}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == len(rows)
    assert found(spark.createDataFrame([], SCHEMA + ", value long"), bench) == set()
