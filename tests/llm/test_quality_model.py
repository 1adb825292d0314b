"""Positive-unlabelled classifier: held-out accuracy, the prior, the risk, and awkward input."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import quality_model as Q
from cohortloom.llm import text as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def tables(spark, sf):
    return (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.95), ("sf0.1", 0.98)])
def test_held_out_accuracy(spark, sf, least):
    docs, labels = tables(spark, sf)
    rows = Q.classified(docs, labels).where("held_out").join(labels, "doc_id").collect()
    for quality in (0, 1):
        own = [r.predicted == quality for r in rows if r.quality == quality]
        assert len(own) > 5 and sum(own) >= least * len(own)


def test_scores_see_text_and_outer_labels_only(spark):
    docs, labels = tables(spark, "sf0.01")
    before = {r.doc_id: r.score for r in Q.classified(docs, labels).collect()}
    # other ids in other columns, held-out labels turned round: nothing may change
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None), "n_chars": F.lit(-1)})
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in Q.classified(other.repartition(13), turned).collect()} == before


def test_negative_labels_are_not_used(spark):
    docs, labels = tables(spark, "sf0.001")
    a, b = Q.classified(docs, labels), Q.classified(docs, labels.where("quality = 1"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.9):
        u = np.where(rng.random(40_000) < prior, rng.normal(0.8, 0.1, 40_000), rng.normal(0.2, 0.1, 40_000)).clip(0, 1)
        p = rng.normal(0.8, 0.1, 5_000).clip(0, 1)
        bins = np.arange(101)
        tails = list(zip(bins.tolist(), np.bincount((u * 100).astype(int), minlength=101).tolist(), np.bincount((p * 100).astype(int), minlength=101).tolist()))
        assert abs(Q.class_prior(tails) - prior) < 0.03


def test_negative_part_stays_above_zero():
    """A prior that is far too high would make the unbiased risk fall below zero; the minimiser stops there."""
    rng = np.random.default_rng(4)
    x_u = np.column_stack((np.ones(300), rng.integers(0, 2, (300, 40))))
    x_p = np.column_stack((np.ones(12), rng.integers(0, 2, (12, 40))))
    both_u, both_p = x_u.T @ x_u / 300, x_p.T @ x_p / 12
    w = Q.minimise(both_u, both_p, 0.9, 1e-3)
    negative = ((1 + x_u @ w) ** 2).mean() / 4 - 0.9 * ((1 + x_p @ w) ** 2).mean() / 4
    free = np.linalg.solve(both_u / 2 + 2e-3 * np.eye(41), 0.9 * both_p[0] - both_u[0] / 2)
    unbiased = ((1 + x_u @ free) ** 2).mean() / 4 - 0.9 * ((1 + x_p @ free) ** 2).mean() / 4
    assert unbiased < 0 and negative > unbiased and negative > -0.05


def test_moments_are_plain_counts(spark):
    docs, _ = tables(spark, "sf0.001")
    rows = Q.coded(docs, "doc_id").withColumn("positive", F.col("doc_id") % 3 == 0).cache()
    cells = {r.cell: (r.everything, r.positive) for r in Q.together(rows).collect()}
    want = np.zeros((2, Q.CODES, Q.CODES), int)
    for r in rows.collect():
        at = [k * Q.WIDTH + c for k, c in enumerate(r.codes)]
        for i in at:
            for j in at:
                if i <= j:
                    want[0, i, j] += 1
                    want[1, i, j] += r.positive
    flat = want.reshape(2, -1)
    assert cells == {int(c): (int(flat[0, c]), int(flat[1, c])) for c in np.flatnonzero(flat[0])}


def test_statistics_of_one_text():
    import pyarrow as pa

    text = "Aa aa aa |x é!\nAa aa aa |x é!\n\n$$"
    values = dict(zip(Q.STATISTICS, Q.statistics(next(T.groups(pa.array([text]))))[0], strict=True))
    n = len(text)
    assert values["words"] == 11 and values["longest_word"] == 3
    assert values["upper"] == 2 / n and values["bars"] == 2 / n and values["signs"] == 2 / n
    assert values["not_ascii"] == 2 / n and values["stutter"] == 2 / 11 and values["wordless"] == 1 / 11
    assert values["repeated_lines"] == 1 / 3 and values["words_a_line"] == 11 / 3


def test_awkward_tables(spark):
    rows = brute.awkward_documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(2, 40)] + [(2, 0, 0), (3, None, 0), (None, 1, 0), (5, 1, 1), (5, 1, 1)], LABELS
    )
    got = Q.classified(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in got)
    same = {r.score for r in got if r.doc_id in (0, 1)}
    assert len(same) == 1  # null and empty are texts without a character
    nothing = spark.createDataFrame([], LABELS)
    assert {r.score for r in Q.classified(docs, nothing).collect()} == {0.5}
    assert Q.classified(spark.createDataFrame([], SCHEMA), labels).count() == 0
    clash = docs.withColumns({"codes": F.lit(1), "positive": F.lit("x"), "score": F.lit(0), "held_out": F.lit(2)})
    assert sorted(map(str, Q.classified(clash, labels).collect())) == sorted(map(str, got))
