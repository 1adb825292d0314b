"""Repeated windows of words and bytes against brute force."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


def files(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return rows, [tuple(r) for r in rows.collect()]


def substring(df, **options):
    out = substring_dedup.remove_repeats(df, **options)
    out = out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    return Counter(tuple(r) for r in out.collect())


def suffix(df, **options):
    out = suffix_dedup.remove_repeats(df, keep_first=False, **options)
    out = out.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    return Counter(tuple(r) for r in out.collect())


def test_substring_awkward(spark):
    rows = brute.awkward_documents()
    assert substring(spark.createDataFrame(rows, SCHEMA)) == brute.substring(rows, 35)
    assert substring(spark.createDataFrame(rows, SCHEMA), width=7, seed=3) == brute.substring(rows, 7)


def test_substring_whole_table(spark):
    df, rows = files(spark)
    assert substring(df) == brute.substring(rows, 35)


@pytest.mark.parametrize("most_texts", [1024, 1])
def test_suffix_awkward(spark, most_texts):
    rows = brute.awkward_documents()
    df = spark.createDataFrame(rows, SCHEMA)
    assert suffix(df, most_texts=most_texts) == brute.suffix(rows, 400)
    assert suffix(df, width=60, seed=20, most_texts=most_texts) == brute.suffix(rows, 60)


def test_suffix_whole_table(spark):
    df, rows = files(spark)
    assert suffix(df) == brute.suffix(rows, 400)


@pytest.mark.parametrize("most_texts", [1024, 1])
def test_keep_first(spark, most_texts):
    """The earliest copy by (id, hash of the text, place) stays."""
    df = spark.createDataFrame(brute.awkward_documents(), SCHEMA).dropDuplicates(["doc_id", "text"])
    order = df.select("doc_id", "text", F.xxhash64("text").alias("k")).orderBy("doc_id", "k").collect()
    data = [(r.text or "").encode() for r in order]
    want = Counter(
        (r.doc_id, bytes(b for i, b in enumerate(s) if i not in c))
        for r, s, c in zip(order, data, brute.covered(data, 60, keep_first=True), strict=True)
    )
    out = suffix_dedup.remove_repeats(df, width=60, seed=20, most_texts=most_texts)
    assert Counter((r.doc_id, bytes(r.kept)) for r in out.collect()) == want


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring(df) == Counter() and suffix(df) == Counter()
    clash = spark.createDataFrame([(1, "a b", 2, 3, "z")], "doc_id long, text string, lo int, runs int, spans string")
    assert substring(clash).total() == 1 and suffix(clash).total() == 1


def test_pieces_lose_no_window(monkeypatch):
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 5000).astype(np.uint64)
    symbols[3000:3400] = symbols[100:500]
    first = np.array([0, 20, 4000, 5000])
    whole = repeats.text_runs(symbols, first, 35, 12)
    monkeypatch.setattr(repeats, "PIECE", 300)
    cut = repeats.text_runs(symbols, first, 35, 12)
    for found in (whole, cut):
        starts = {(t, s + i) for t, s, n in zip(*found[:3], strict=True) for i in range(n)}
        assert starts == {(t, i) for t, n in enumerate(np.diff(first)) for i in range(n - 34)}
