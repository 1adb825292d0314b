"""Descriptive tables: categorical Table 1, frequency tables, column summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import null_count, ratio
from .labs import distribution
from .scale import join_null_safe


def frequency(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per combination; null is a level of its own."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    """Wide two-way table over declared ``levels`` of ``column`` plus its null count."""
    names = [f"{column}_{v}" for v in levels]
    cells = [F.count_if(F.col(column) == v).alias(n) for v, n in zip(levels, names)]
    return df.groupBy(row).agg(*cells, null_count(column).alias(f"{column}_null"))


def column_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Six-number summary of the known values with the null count; all-null keys are kept."""
    nulls = df.groupBy(*keys).agg(null_count(value).alias("n_null"))
    return join_null_safe(nulls, distribution(df, keys, value), keys, "left").fillna(0, ["n"])


def table_one(
    df: DataFrame, variables: list[str], filters: dict[str, Column] | None = None
) -> DataFrame:
    """``n (p%)`` per variable and level under each named filter.

    Missing values form a ``(Missing)`` row whose percentage is null; other percentages use the
    non-missing total. One aggregation serves all variables and filters.
    """
    filters = filters or {"all": F.lit(True)}
    masks = {f"__m{i}": c for i, c in enumerate(filters.values())}
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level"))
            for v in variables
        ]
    )
    # rows fan out over variables only; each filter is one conditional count
    counts = (
        df.select(*[c.alias(m) for m, c in masks.items()], cells.alias("__c"))
        .select(*masks, F.inline("__c"))
        .groupBy("variable", "level")
        .agg(*[F.count_if(m).alias(m) for m in masks])
    )
    subsets = F.array(
        *[F.struct(F.lit(n).alias("subset"), F.col(m).alias("n")) for n, m in zip(filters, masks)]
    )
    counts = counts.select("variable", "level", F.inline(subsets)).where("n > 0")
    known = F.when(F.col("level").isNotNull(), F.col("n"))
    total = F.sum(known).over(W.partitionBy("subset", "variable"))
    pct = F.when(F.col("level").isNotNull(), 100 * ratio(F.col("n"), total))
    shown = F.round(pct, 1).cast("decimal(5,1)").cast("string")
    label = F.concat(F.col("n").cast("string"), F.lit(" ("), shown, F.lit("%)"))
    return counts.select(
        "subset",
        "variable",
        F.coalesce("level", F.lit("(Missing)")).alias("level"),
        "n",
        pct.alias("pct"),
        F.coalesce(label, F.col("n").cast("string")).alias("label"),
    )


def lab_presence(wide: DataFrame, conditions: list[str]) -> DataFrame:
    """People with laboratory data per condition, in number and percent."""
    sums = wide.agg(
        F.count("*").alias("total"),
        *[(F.count("*") - F.coalesce(F.sum(f"missing_lab_{c}"), F.lit(0))).alias(c)
          for c in conditions],
    )
    long = sums.unpivot(["total"], conditions, "condition", "n")
    return long.withColumn("pct", 100 * ratio(F.col("n"), F.col("total")))
