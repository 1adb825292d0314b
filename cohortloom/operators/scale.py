"""Skew-proof building blocks: running totals, exact quantiles, first rows, reliable checkpoints.

A plain window over a hot key, or over no key at all, sorts everything in one task. The helpers here
cut the order of all rows into stretches of bounded size, do the local work per stretch, and carry the
totals of earlier stretches over through a table of one row a stretch.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# rows of a stretch of a running sum, and those below which no further stretch is opened
ROWS_PER_TASK, LEAST_ROWS = 1_000_000, 10_000

_RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the split costs one more exchange further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; they change plans, never results."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="cohortloom-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open_steps:
        _open_steps[-1].append(path)
    return path


# paths of the steps of each block that is being run, the innermost last
_open_steps: list[list[str]] = []


@contextmanager
def temporary_steps(spark: SparkSession) -> Iterator[None]:
    """Step tables and folders made inside are removed at the end, also after an error.

    What is built inside must be written out or read inside: a DataFrame that is still to be computed
    loses its steps.
    """
    _open_steps.append([])
    try:
        yield
    finally:
        for path in _open_steps.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame, *parts: str) -> DataFrame:
    """Cut lineage through a table in the shared checkpoint folder.

    A lost executor costs no recomputation, and later steps read only the columns they need; with
    ``parts`` (columns of few values) a filter on these reads only the files it asks for.
    """
    path = scratch_path(df.sparkSession, "step")
    writer = df.write.partitionBy(*parts) if parts else df.write
    writer.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return read.select(*df.columns) if parts else read


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which a null key equals a null key; key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def side_by_side(*parts: DataFrame) -> DataFrame:
    """Put one-row tables with different columns next to each other, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def dealt_in_order(df: DataFrame, by: list[Column], rows_per_task: int) -> DataFrame:
    """``df`` with ``__p``, the number of its stretch along ``by``, written so that it stays.

    Stretches are the partitions of a range partitioning on all of ``by``, so one value of the leading
    columns, however common, is cut along the next ones; their number follows from the number of rows.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count()
    parts = max(-(-rows // rows_per_task), min(most, -(-rows // LEAST_ROWS)), 1)
    dealt = df.repartitionByRange(parts, *by)
    return checkpointed(dealt.withColumn("__p", F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, Column],
    totals: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inclusive running sum of each ``sums`` column along ``order`` inside ``keys``, in two levels.

    Rows are dealt into stretches of about ``rows_per_task`` rows along (keys, order). The totals of a
    key's stretches, one row each, give every stretch what comes before it; that carry is one more row
    at the head of the stretch, so a single window adds it without a join. With ``totals`` the whole-key sum is
    added as ``<name>_total``. No task holds more than a stretch, whichever key or order value is common.
    """
    columns = df.columns
    values = {f"__v_{n}": c for n, c in sums.items()}
    dealt = dealt_in_order(df.withColumns(values), [*[F.col(k) for k in keys], *order], rows_per_task)
    stretches = dealt.groupBy(*keys, "__p").agg(*[F.sum(v).alias(v) for v in values])
    by_key = W.partitionBy(*keys)
    before = by_key.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    carry = stretches.select(
        *keys,
        "__p",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values],
        *[F.sum(v).over(by_key).alias(f"__t_{v}") for v in values if totals],
        F.lit(0).alias("__row"),
    )
    both = dealt.withColumn("__row", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    stretch = W.partitionBy(*keys, "__p")
    local = stretch.orderBy("__row", *order).rowsBetween(W.unboundedPreceding, 0)
    out = both.select(
        *columns,
        "__row",
        *[F.coalesce(F.sum(f"__v_{n}").over(local), F.lit(0)).alias(f"__s_{n}") for n in sums],
        *[F.first(f"__t___v_{n}").over(local).alias(f"__s_{n}_total") for n in sums if totals],
    ).where("__row = 1")
    made = [n for s in sums for n in ([s, f"{s}_total"] if totals else [s])]
    return out.select(*[c for c in columns if c not in made], *[F.col(f"__s_{n}").alias(n) for n in made])


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Row number inside ``keys`` along a total order, with hot keys split over tasks."""
    return running_sums(df, keys, order, {name: F.lit(1)})


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    extra: dict[str, Column] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact type-7 quantiles of the non-null ``value`` per key, with count ``n``.

    Rows are first collapsed to (key, value, count); ranks come from running counts. ``extra``
    aggregates see the collapsed rows as columns ``value`` and ``__c`` (multiplicity).
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__c")
    )
    # counting, dealing and ranks all read the collapsed rows, not the input
    counted = checkpointed(counted)
    v = F.col(value)
    ranked = running_sums(counted, keys, [v], {"__cum": F.col("__c")}, True, rows_per_task)
    first = F.col("__cum") - F.col("__c")
    aggs, finals = [F.max("__cum_total").alias("n")], {}
    for name, p in probs.items():
        h = (F.col("__cum_total") - 1) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("__cum_total") - 1)
        for tag, rank in (("lo", lo), ("hi", hi)):
            held = (first <= rank) & (rank < F.col("__cum"))
            aggs.append(F.max(F.when(held, v)).alias(f"__{tag}_{name}"))
        h = (F.col("n") - 1) * F.lit(float(p))
        gap = F.col(f"__hi_{name}") - F.col(f"__lo_{name}")
        finals[name] = F.col(f"__lo_{name}") + (h - F.floor(h)) * gap
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    return (
        ranked.groupBy(*keys)
        .agg(*aggs)
        .select(*keys, "n", *[c.alias(n) for n, c in finals.items()], *(extra or {}))
    )


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key along ``order`` (all remaining columns break ties, nulls first).

    A row number of one: Spark prunes every map task to one row per key before anything is shuffled.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("__rn", place).where("__rn = 1").select(*df.columns)
