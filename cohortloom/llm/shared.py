"""Arrow plumbing, document keys and connected groups shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed

ROWS_OUT = 20_000
# bytes of a batch that Spark hands to a task's Python worker
BATCH_BYTES = "8m"


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, a hash of the text, the text and the named columns.

    Rows that agree in id and text are told apart by nothing and get the same decision; rows with one
    id and different texts, or with a null id, stay separate.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text")).alias("text_key"),
        "text",
        *columns,
    )


KEY = ["doc_id", "text_key"]


def same_document(left: DataFrame, right: DataFrame):
    """Join condition on id and text that lets null ids meet."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def join_documents(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on id and text, null ids included; keys come from the left."""
    names = {k: f"__{k}" for k in KEY}
    other = right.withColumnsRenamed(names)
    found = left.join(
        other,
        left["doc_id"].eqNullSafe(other["__doc_id"]) & (left["text_key"] == other["__text_key"]),
        how,
    )
    return found.drop(*names.values())


@cache
def _trim() -> Callable | None:
    """The C library's call that gives free memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def release() -> None:
    """Give back what earlier batches have used: a worker is kept for later tasks, with all it holds."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on bounds Arrow batches by bytes; results do not depend on it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator], schema: str) -> DataFrame:
    """Apply a function that turns one record batch into record batches or tables."""

    def run(batches):
        for batch in batches:
            for out in function(batch):
                if isinstance(out, pa.Table):
                    yield from out.to_batches(max_chunksize=ROWS_OUT)
                else:
                    yield out
            del batch
            release()

    return small_batches(df).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables in which every group of equal keys is complete, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        cut = batch.num_rows
        lo = 0
        # first row of the last group, by halving
        while lo < cut:
            mid = (lo + cut) // 2
            if all(batch.column(k)[mid] == v for k, v in zip(keys, last, strict=True)):
                cut = mid
            else:
                lo = mid + 1
        if cut == 0 and held and all(
            held[-1].column(k)[held[-1].num_rows - 1] == v for k, v in zip(keys, last, strict=True)
        ):
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, cut)]
        ready = [b for b in ready if b.num_rows]
        if ready:
            yield pa.Table.from_batches(ready)
        held = [batch.slice(cut)]
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, label): connected groups of an undirected edge table (a, b), labelled by their least node.

    Each round takes the least label among the neighbours and then the label of that label, and is
    written to the checkpoint folder; rounds grow with the logarithm of a group's diameter.
    """
    spark = edges.sparkSession
    both = checkpointed(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct()
    )
    labels = checkpointed(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label"))
    )
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("lb").alias("m"))
        )
        stepped = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nxt = checkpointed(
            stepped.join(jump, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
            )
        )
        changed = nxt.where("old <> label").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")


def empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
