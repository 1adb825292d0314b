"""Keyed corrections, exclusions, completion and coverage checks used across the analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import join_null_safe


def correct_by_key(
    df: DataFrame, corrections: DataFrame, keys: list[str], target: str, value: str = "corrected"
) -> DataFrame:
    """Replace ``target`` where ``corrections`` (one row per key) holds a value for the key."""
    fixes = corrections.select(*keys, F.col(value).alias("__fix"))
    out = join_null_safe(df, fixes, keys, "left")
    return out.withColumn(target, F.coalesce("__fix", target)).drop("__fix").select(*df.columns)


def exclude_listed(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(listed.select(*keys), keys, "left_anti")


def keep_listed(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(listed.select(*keys), keys, "left_semi")


def drop_when(df: DataFrame, cond: Column) -> DataFrame:
    """Drop rows whose condition is true; a null condition keeps the row."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def union_fill(*parts: DataFrame) -> DataFrame:
    """Stack tables by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys of ``left`` that ``right`` does not know."""
    lost = left.join(right.select(key), key, "left_anti")
    per_key = lost.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_keys")
    )
