"""Data-quality reports: missingness, keys, ranges, chronology, expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import null_count, overwrite, ratio


def _long(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*rows)))


def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and percent per column and over all cells, from one aggregation."""
    cols = df.columns
    one = df.agg(F.count("*").alias("n"), *[null_count(c).alias(f"m_{c}") for c in cols])
    n = F.col("n")
    every = sum((F.col(f"m_{c}") for c in cols[1:]), F.col(f"m_{cols[0]}"))
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            missing.alias("n_missing"),
            (100 * ratio(missing, n * width)).alias("pct_missing"),
        )
        for name, missing, width in [
            *[(c, F.col(f"m_{c}"), 1) for c in cols],
            ("(overall)", every, len(cols)),
        ]
    ]
    return _long(one, rows)


def overview(df: DataFrame) -> DataFrame:
    """Type, count, nulls, minimum and maximum per column."""
    one = df.agg(
        F.count("*").alias("n"),
        *[null_count(c).alias(f"m_{c}") for c in df.columns],
        *[F.min(c).cast("string").alias(f"lo_{c}") for c in df.columns],
        *[F.max(c).cast("string").alias(f"hi_{c}") for c in df.columns],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(t).alias("data_type"),
            F.col("n"),
            F.col(f"m_{c}").alias("n_null"),
            F.col(f"lo_{c}").alias("min_value"),
            F.col(f"hi_{c}").alias("max_value"),
        )
        for c, t in df.dtypes
    ]
    return _long(one, rows)


def any_null(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.coalesce(c, F.lit(False)).alias("has_null"))
        for c in columns
    ]
    return _long(one, rows)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def range_check(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Observed range of each column and the number of values outside the allowed one."""
    aggs = []
    for c, (lo, hi) in bounds.items():
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}")]
        aggs.append(F.count_if((x < lo) | (x > hi)).alias(f"out_{c}"))
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"lo_{c}").alias("min_value"),
            F.col(f"hi_{c}").alias("max_value"),
            F.col(f"out_{c}").alias("n_outside"),
        )
        for c in bounds
    ]
    return _long(df.agg(*aggs), rows)


def recode_sentinel(df: DataFrame, column: str, bad, good) -> DataFrame:
    return df.withColumn(column, overwrite(column, F.col(column) == bad, good))


def chronology(df: DataFrame, date: str, anchor: str, keys: list[str]) -> DataFrame:
    """Events without a date, before, on and after the anchor date, counted per key."""
    d, a = F.col(date), F.col(anchor)
    label = (
        F.when(d.isNull(), "no date")
        .when(a.isNull(), "no anchor")
        .when(d < a, "before")
        .when(d == a, "same day")
        .otherwise("after")
    )
    return df.withColumn("timing", label).groupBy(*keys, "timing").agg(F.count("*").alias("n"))


def expect(name: str, actual: DataFrame, expected: int) -> DataFrame:
    """One expectation row from a one-cell DataFrame."""
    value = F.col(actual.columns[0]).cast("long")
    return actual.select(
        F.lit(name).alias("check_name"),
        F.lit(expected).cast("long").alias("expected"),
        value.alias("actual"),
        value.eqNullSafe(F.lit(expected)).alias("ok"),
    )


def expectation_suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def keys_differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Number of key rows present in one table and not in the other (0 when the sets are equal)."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).unionByName(right.exceptAll(left)).agg(F.count("*").alias("n"))


def year_histogram(df: DataFrame, date: str, cond: Column | None = None) -> DataFrame:
    kept = df if cond is None else df.where(cond)
    return kept.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"))
