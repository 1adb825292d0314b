"""Name -> query registration shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.toxicity import Settings, Sources
from ..sources.views import Views
from .prelude import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The test tables span 1995-2001, so the study dates are moved accordingly.
SETTINGS = Settings(
    min_year=1995,
    era2=(["1995-06-01"], ["first half", "later"]),
    era3=(["1995-03-01", "1995-09-01"], ["era 1", "era 2", "era 3"]),
    dropped_era="era 1",
)


def sources(v: Views) -> Sources:
    return Sources(v.cohort, v.icd, v.lab, v.chart)


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six digits: sums over a shuffle differ in their last bits."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its SQL, if any."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: tidy(fn(Views(spark, folder)))
        if sql is not None:
            ORACLE[name] = with_ctes(sql, extra)
        return fn

    return register
