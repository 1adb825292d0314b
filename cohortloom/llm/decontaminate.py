"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item of a few dozen shingles inside a document of thousands has a Jaccard similarity near zero,
so the two are not sketched alike. Items are partitioned by size (powers of two), and the partition sets
how many least shingle hashes an item keeps (all of them in the smaller partitions) and how many of
these a document must hold to be a candidate. The kept hashes are a uniform sample of the item's set, so a
document that contains a share c of the item holds about c of them, whatever its own size; the needed
number is the largest that an item at the threshold misses with a probability below ``MISS``. Candidates
are verified on the item's whole shingle set.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed
from . import text as T
from .shared import KEY, arrow_map, keyed

WIDTH = 5
THRESHOLD = 0.8
# hashes kept in the smallest partition that keeps a sample, and more per doubling of the size
SKETCH, MORE = 32, 8
MISS = 1e-6
# item shingles that may be sent to every task (8 bytes each); above it the search is a shuffle join
MOST_BROADCAST = 1 << 20

ITEMS = (
    "item_id long, text_key long, size int, partition int, needed int, sketch array<long>, "
    "shingles array<long>"
)
FOUND = "doc_id long, text_key long, item_id long, item_key long, n_item int, n_shared int"
HASHES = "doc_id long, text_key long, value long"


@cache
def partition_plan(partition: int, sketch: int, threshold: float) -> tuple[int, int]:
    """(kept hashes, needed hits) of items with ``2 ** partition`` shingles or more, fewer than twice that.

    Below twice ``sketch`` shingles all are kept, and the needed number follows from each item's size
    (given as 0 here). Above, hits of an item at the threshold are drawn without replacement; drawing with
    replacement is the wider case, so its tail bounds the misses.
    """
    most = 2 ** (partition + 1) - 1
    if most < 2 * sketch:
        return most, 0
    kept = sketch + MORE * (partition + 1 - math.ceil(math.log2(2 * sketch)))
    tail, needed = 0.0, 0
    while True:
        tail += math.comb(kept, needed) * threshold**needed * (1 - threshold) ** (kept - needed)
        if tail > MISS:
            return kept, max(1, needed)
        needed += 1


def item_sketches(items: DataFrame, width: int, sketch: int, threshold: float) -> DataFrame:
    """Distinct shingles, size partition, sketch and needed hits of every item that has a word."""
    own = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("text_key"), "text"
    )

    def of_batch(batch):
        for group in T.groups(batch.column("text")):
            values, texts = T.shingles(T.words(group), width)
            values, border = T.distinct_per_text(values, texts, group.hi - group.lo)
            has = np.flatnonzero(np.diff(border))
            # sorted values are in random order of the shingles they stand for
            sets = [T.signed(values[border[i] : border[i + 1]]) for i in has]
            take = pa.array(has + group.lo)
            size = np.array([len(s) for s in sets], np.int32)
            partition = np.log2(np.maximum(size, 1)).astype(np.int32)
            plans = [partition_plan(int(p), sketch, threshold) for p in partition]
            needed = [n or math.ceil(threshold * len(s) - 1e-9) for s, (_, n) in zip(sets, plans, strict=True)]
            yield pa.table(
                {
                    "item_id": batch.column("item_id").take(take),
                    "text_key": batch.column("text_key").take(take),
                    "size": size,
                    "partition": partition,
                    "needed": pa.array(needed, pa.int32()),
                    "sketch": pa.array([s[:k] for s, (k, _) in zip(sets, plans, strict=True)], pa.list_(pa.int64())),
                    "shingles": pa.array(sets, pa.list_(pa.int64())),
                }
            )

    return checkpointed(arrow_map(own, of_batch, ITEMS).dropDuplicates(["item_id", "text_key"]))


def _search_in_tasks(own: DataFrame, items: DataFrame, threshold: float, width: int) -> DataFrame:
    """Look the shared, size-checked item sketches up in every document's shingles."""
    rows = items.select("item_id", "text_key", "size", "needed", "sketch", "shingles").collect()
    size = np.array([r.size for r in rows], np.int64)
    sketch_item = np.repeat(np.arange(len(rows)), [len(r.sketch) for r in rows])
    sketch_value = np.array([v for r in rows for v in r.sketch], np.int64).view(np.uint64)
    order = np.argsort(sketch_value, kind="stable")
    sets = np.array([v for r in rows for v in r.shingles], np.int64).view(np.uint64)
    border = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    shared = own.sparkSession.sparkContext.broadcast(
        {
            "value": sketch_value[order],
            "item": sketch_item[order],
            "needed": np.array([r.needed for r in rows], np.int64),
            "ids": [r.item_id for r in rows],
            "keys": [r.text_key for r in rows],
            "sets": sets,
            "border": border,
        }
    )

    def of_batch(batch):
        known = shared.value
        value, item = known["value"], known["item"]
        unique, at = np.unique(value, return_index=True)
        times = np.diff(np.concatenate((at, [len(value)])))
        bits = np.zeros(1 << 16, bool)
        bits[(unique >> np.uint64(48)).astype(np.int64)] = True
        n_items = len(known["ids"])
        for group in T.groups(batch.column("text")):
            values, texts = T.shingles(T.words(group), width)
            maybe = np.flatnonzero(bits[(values >> np.uint64(48)).astype(np.int64)])
            place = np.searchsorted(unique, values[maybe])
            hit = unique[np.minimum(place, len(unique) - 1)] == values[maybe]
            place, text = place[hit], texts[maybe[hit]]
            if not len(place):
                continue
            # a shingle counts once per document
            pair = np.unique(text * len(unique) + place)
            text, place = pair // len(unique), pair % len(unique)
            repeat = times[place]
            first = np.cumsum(repeat) - repeat
            mine = at[np.repeat(place, repeat)] + np.arange(repeat.sum()) - np.repeat(first, repeat)
            pair, hits = np.unique(np.repeat(text, repeat) * n_items + item[mine], return_counts=True)
            pair = pair[hits >= known["needed"][pair % n_items]]
            out = {n: [] for n in ("row", "item", "n_item", "n_shared")}
            begin = np.searchsorted(texts, np.arange(group.hi - group.lo + 1))
            last, own_set = -1, None
            for p in pair.tolist():
                t, i = divmod(p, n_items)
                if t != last:
                    last, own_set = t, np.unique(values[begin[t] : begin[t + 1]])
                whole = known["sets"][known["border"][i] : known["border"][i + 1]]
                both = int(np.isin(whole, own_set, assume_unique=True).sum())
                if both >= threshold * len(whole) - 1e-9:
                    for name, x in zip(out, (t + group.lo, i, len(whole), both), strict=True):
                        out[name].append(x)
            take = pa.array(out["row"], pa.int64())
            yield pa.table(
                {
                    "doc_id": batch.column("doc_id").take(take),
                    "text_key": batch.column("text_key").take(take),
                    "item_id": pa.array([known["ids"][i] for i in out["item"]], pa.int64()),
                    "item_key": pa.array([known["keys"][i] for i in out["item"]], pa.int64()),
                    "n_item": pa.array(out["n_item"], pa.int32()),
                    "n_shared": pa.array(out["n_shared"], pa.int32()),
                }
            )

    return arrow_map(own, of_batch, FOUND)


def _search_by_join(own: DataFrame, items: DataFrame, threshold: float, width: int) -> DataFrame:
    """The same search with both sides shuffled: sketches to candidates, then whole sets of those."""

    def hashes(batch):
        for group in T.groups(batch.column("text")):
            values, texts = T.shingles(T.words(group), width)
            values, border = T.distinct_per_text(values, texts, group.hi - group.lo)
            take = pa.array(np.repeat(np.arange(group.lo, group.hi), np.diff(border)))
            yield pa.table(
                {
                    "doc_id": batch.column("doc_id").take(take),
                    "text_key": batch.column("text_key").take(take),
                    "value": T.signed(values),
                }
            )

    held = arrow_map(own.dropDuplicates(KEY), hashes, HASHES)
    item = ["item_id", F.col("text_key").alias("item_key"), "size"]
    names = ["doc_id", "text_key", "item_id", "item_key", "size"]
    candidates = (
        held.join(items.select(*item, "needed", F.explode("sketch").alias("value")), "value")
        .groupBy(*names, "needed")
        .agg(F.count(F.lit(1)).alias("hits"))
        .where("hits >= needed")
    )
    candidates = checkpointed(candidates.select(*names))
    whole = items.select("item_id", F.col("text_key").alias("item_key"), F.explode("shingles").alias("value"))
    same_item = ["ci", "ck"]
    pairs = candidates.withColumnsRenamed({"item_id": "ci", "item_key": "ck"})
    asked = pairs.join(
        whole, F.col("ci").eqNullSafe(F.col("item_id")) & (F.col("ck") == F.col("item_key"))
    ).drop(*same_item)
    other = held.withColumnsRenamed({"doc_id": "hd", "text_key": "hk", "value": "hv"})
    shared = asked.join(
        other,
        (F.col("value") == F.col("hv"))
        & (F.col("text_key") == F.col("hk"))
        & F.col("doc_id").eqNullSafe(F.col("hd")),
    )
    return (
        shared.groupBy(*names)
        .agg(F.count(F.lit(1)).cast("int").alias("n_shared"))
        .where(F.col("n_shared") >= threshold * F.col("size") - 1e-9)
        .select("doc_id", "text_key", "item_id", "item_key", F.col("size").alias("n_item"), "n_shared")
    )


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    sketch: int = SKETCH,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """(doc_id, text_key, item_id, n_item, n_shared, containment) of every item inside a document.

    An item is inside if at least ``threshold`` of its distinct ``width``-word shingles (words
    unchanged) occur anywhere in the document; an item with fewer words has one shingle of all its
    words, which only a text of the same words holds. Null and wordless texts and items match nothing.
    Rows of ``docs`` that agree in id and text give one row an item, and so do repeated items; other
    columns are ignored.
    """
    own = keyed(docs)
    known = item_sketches(items.select("item_id", "text"), width, sketch, threshold)
    total = known.agg(F.sum("size")).first()[0] or 0
    search = _search_in_tasks if 0 < total <= most_broadcast else _search_by_join
    found = search(own, known, threshold, width).dropDuplicates([*KEY, "item_id", "item_key"])
    return found.select(
        *KEY,
        "item_id",
        "n_item",
        "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    found = checkpointed(contained_items(docs, items, **options).select(*KEY).distinct())
    found = found.withColumnsRenamed({"doc_id": "__d", "text_key": "__k"})
    return docs.join(
        found,
        F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col("text")) == F.col("__k")),
        "left_anti",
    )
