import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import quality as Q
from cohortloom.operators.scale import (
    checkpointed,
    dealt_in_order,
    exact_quantiles,
    first_row,
    number_rows,
    running_sums,
    scratch_path,
    temporary_steps,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; one key holds a third of them, and one has only nulls."""
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else rnd.choice("abcde"), i % 97, i, round(rnd.gauss(0, 10), 2))
            for i in range(3000)]
    rows += [(None, 1, 3000, 1.5), (None, 2, 3001, 2.5), ("void", 1, 3002, None)]
    return spark.createDataFrame(rows, "k string, day int, seq int, x double")


def test_running_sums_match_pandas(skewed):
    out = running_sums(skewed, ["k"], [F.col("day"), F.col("seq")],
                       {"s": F.col("x"), "n": F.lit(1)}, totals=True, rows_per_task=90).toPandas()
    pdf = skewed.toPandas().sort_values(["day", "seq"])
    pdf["k"] = pdf["k"].fillna("~")
    pdf["want"] = pdf.groupby("k")["x"].transform(lambda v: v.fillna(0).cumsum())
    pdf["rank"] = pdf.groupby("k").cumcount() + 1
    both = pdf.merge(out, on="seq")
    assert len(both) == len(pdf)
    assert np.allclose(both["want"], both["s"]) and (both["rank"] == both["n"]).all()
    sizes = both.groupby("k_x")["seq"].size()
    assert (both["n_total"] == both["k_x"].map(sizes)).all()


def test_stretches_are_bounded_while_rows_grow(spark):
    """Ten times the rows, the same largest stretch: with half of all rows on one key and one day, and
    with one order value for everybody."""
    order = [F.col("k"), F.col("day"), F.col("seq")]
    for n in (3_000, 30_000):
        df = spark.range(n).selectExpr(
            "IF(id % 2 = 0, 0, id % 7) AS k", "IF(id % 2 = 0, 5, id % 50) AS day", "(id * 7919) % 1000003 AS seq"
        )
        for by in (order, [F.lit(1), F.col("seq")]):
            sizes = [r["count"] for r in dealt_in_order(df, by, 500).groupBy("__p").count().collect()]
            assert sum(sizes) == n and max(sizes) < 1_500
    out = running_sums(df, ["k"], order[1:], {"rn": F.lit(1)}, rows_per_task=500).toPandas()
    out = out.sort_values(["k", "day", "seq"])
    assert (out["rn"] == out.groupby("k").cumcount() + 1).all()


def test_one_order_value_for_everybody(spark):
    rows = [(7, (i * 7919) % 2000) for i in range(2000)]
    out = number_rows(spark.createDataFrame(rows, "day int, seq int"), [], [F.col("day"), F.col("seq")])
    assert out.toPandas().sort_values("seq")["rn"].tolist() == list(range(1, 2001))


def test_running_sums_of_nothing_and_over_a_column_of_that_name(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert running_sums(empty, ["k"], [F.col("x")], {"s": F.col("x")}, totals=True).collect() == []
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 4)], "k string, x int")
    got = running_sums(df, ["k"], [F.col("x")], {"x": F.col("x")}).orderBy("x").collect()
    assert [tuple(r) for r in got] == [("a", 1), ("a", 3), (None, 4)]


def test_row_numbers_without_a_key_are_a_permutation(skewed):
    out = number_rows(skewed, [], [F.col("seq")]).orderBy("seq")
    assert [r.rn for r in out.collect()] == list(range(1, 3004))


def test_exact_quantiles_match_numpy(skewed):
    out = exact_quantiles(skewed, ["k"], "x", {"q1": 0.25, "med": 0.5, "top": 1.0}, rows_per_task=50)
    got = {r.k: r for r in out.collect()}
    pdf = skewed.toPandas().dropna(subset=["x"])
    pdf["k"] = pdf["k"].where(pdf["k"].notna(), None)
    for key, part in pdf.groupby("k", dropna=False):
        row = got[None if pd.isna(key) else key]
        assert row.n == len(part)
        assert np.allclose([row.q1, row.med, row.top], np.quantile(part["x"], [0.25, 0.5, 1.0]))
    assert "void" not in got


def test_first_row_is_deterministic(skewed):
    out = {r.k: (r.day, r.seq) for r in first_row(skewed, ["k"], ["day", "seq"]).collect()}
    pdf = skewed.toPandas().sort_values(["day", "seq"])
    for key, part in pdf.groupby("k"):
        assert out[key] == (part["day"].iloc[0], part["seq"].iloc[0])


def test_no_window_over_a_raw_key(skewed):
    """The hot key's rows are sorted per (key, stretch), never per key; nothing is joined."""
    plan = number_rows(skewed, ["k"], [F.col("seq")])._jdf.queryExecution().toString()
    rows = [line for line in plan.split("\n") if "Window [" in line and "__v_rn" in line]
    assert rows and all("__p" in line for line in rows if "__row" in line) and "Join" not in plan


def test_steps_go_when_their_block_ends(spark):
    import os

    def there(path):
        return os.path.exists(path.removeprefix("file:"))

    outer = scratch_path(spark, "kept")
    with temporary_steps(spark):
        df = checkpointed(spark.range(5))
        first = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
        with temporary_steps(spark):
            second = checkpointed(df.where("id > 1")).inputFiles()[0].rpartition("/")[0].removeprefix("file://")
            assert there(second)
        assert there(first) and not there(second)
        df.write.parquet(outer)
    assert not there(first) and spark.read.parquet(outer).count() == 5
    with pytest.raises(ZeroDivisionError), temporary_steps(spark):
        path = scratch_path(spark, "failed")
        spark.range(1).write.parquet(path)
        1 / 0  # noqa: B018
    assert not there(path)


def test_quality_reports(frame):
    df = frame([(1, 5), (1, None), (3, -1)], "id int, x int")
    assert [(r.id, r.n) for r in Q.duplicate_keys(df, ["id"]).collect()] == [(1, 2)]
    row = Q.range_check(df, {"x": (0, 4)}).first()
    assert (row.min_value, row.max_value, row.n_outside) == (-1.0, 5.0, 2)
    assert [r.x for r in Q.recode_sentinel(df, "x", -1, 0).orderBy("id", "x").collect()] == [None, 5, 0]
    assert Q.keys_differ(df, df, ["id"]).first()["n"] == 0
    assert Q.keys_differ(df, df.limit(1), ["id"]).first()["n"] == 2
