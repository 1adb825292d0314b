"""Which windows of a fixed width occur twice anywhere: exact, without shuffling every window.

Inside every window the least hash of its ``seed``-symbol pieces (leftmost on ties) is its anchor, so
equal windows have equal anchors at equal places. Consecutive windows with one anchor form a run, and
only runs travel, a hundredth of the windows or fewer:

1. runs whose anchor hash occurs once hold no repeated window;
2. runs whose whole text occurs again (same anchor) are repeated from end to end;
3. the rest, cut down to one run per different text, is compared window by window by the caller.

Steps 1 and 2 are counts with partial aggregation, so a passage in a third of all documents arrives
as one row per map task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed
from . import text as T
from .shared import KEY, arrow_map

POSITION_BITS = 22
_POSITION = np.uint64((1 << POSITION_BITS) - 1)
PIECE = 1 << 20

# runs that make up more than one in so many of all runs; there are at most so many of them
HOT_SHARE = 1000

RUNS = "doc_id long, text_key long, start int, windows int, anchor long, run long"


def symbols_of(group: T.Group, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a group and the first symbol of each text: ``byte`` or ``word``."""
    if unit == "byte":
        return T.BYTE_SYMBOL[group.data], group.offsets
    found = T.words(group)
    return found.hash, found.first


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones, from block-wise running minima."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def _runs(symbols, first, width, seed):
    at = T.spans_inside(first, width)
    if not len(at):
        return None
    rolling = T.Rolling(symbols)
    hashes = rolling.windows(seed)
    ranked = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_minimum(ranked, width - seed + 1)[at] & _POSITION).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    start = at[cut]
    stop = at[np.concatenate((cut[1:], [len(at)])) - 1]
    windows = stop - start + 1
    whole = T.mix(rolling.of(start, stop + width) + windows.astype(np.uint64))
    owner = np.searchsorted(first, start, "right") - 1
    return owner, start - first[owner], windows, hashes[anchor[cut]], whole


def text_runs(symbols: np.ndarray, first: np.ndarray, width: int, seed: int):
    """(text, start, windows, anchor hash, run hash) of all runs of a group.

    A text longer than ``PIECE`` symbols is cut into pieces that overlap by ``width - 1``: no window
    is lost, a run on a border is merely shorter.
    """
    if len(symbols) <= 2 * PIECE:
        parts = [_runs(symbols, first, width, seed)]
    else:
        parts = []
        for text in range(len(first) - 1):
            for lo in range(int(first[text]), int(first[text + 1]), PIECE):
                hi = min(lo + PIECE + width - 1, int(first[text + 1]))
                part = _runs(symbols[lo:hi], np.array([0, hi - lo]), width, seed)
                if part is not None:
                    shift = lo - int(first[text])
                    parts.append((part[0] + text, part[1] + shift, *part[2:]))
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def all_runs(docs: DataFrame, unit: str, width: int, seed: int) -> DataFrame:
    """Every run of every text, written once."""

    def of_batch(batch):
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        for group in T.groups(batch.column("text"), 1 << 20):
            found = text_runs(*symbols_of(group, unit), width, seed)
            if found is None:
                continue
            owner, start, windows, anchor, run = found
            rows = pa.array(owner + group.lo)
            yield pa.table(
                {
                    "doc_id": ids.take(rows),
                    "text_key": keys.take(rows),
                    "start": start.astype(np.int32),
                    "windows": windows.astype(np.int32),
                    "anchor": T.signed(anchor),
                    "run": T.signed(run),
                }
            )

    return checkpointed(arrow_map(docs, of_batch, RUNS))


class Survey(NamedTuple):
    """``repeated``: runs that occur again as a whole; ``rest``: one run per different text of an
    anchor that has several, with the number ``n`` of equal runs and ``texts`` of the anchor."""

    repeated: DataFrame
    rest: DataFrame


def survey(docs: DataFrame, unit: str, width: int, seed: int) -> Survey:
    runs = all_runs(docs, unit, width, seed)
    # written first: a join against a table of its own can be split where an anchor is hot
    shared = checkpointed(runs.groupBy("anchor").count().where("count > 1").select("anchor"))
    runs = checkpointed(runs.join(shared, "anchor", "left_semi"))
    first = F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("first")
    classes = checkpointed(runs.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), first))
    several = checkpointed(
        classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    )
    rest = classes.join(several, "anchor").select("anchor", "n", "texts", "first.*")
    twice = classes.where("n > 1").select(
        "anchor",
        "run",
        "n",
        F.col("first.doc_id").alias("d0"),
        F.col("first.text_key").alias("k0"),
        F.col("first.start").alias("s0"),
    )
    # a run copied everywhere would be one key in one task; the few such are looked up where their rows lie
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = checkpointed(twice.where(F.col("n") * HOT_SHARE > total))
    cold = runs.join(F.broadcast(hot.select("anchor", "run")), ["anchor", "run"], "left_anti")
    found = runs.join(F.broadcast(hot), ["anchor", "run"]).unionByName(
        cold.join(twice.where(F.col("n") * HOT_SHARE <= total), ["anchor", "run"])
    )
    repeated = found.select(
        *KEY,
        "start",
        "windows",
        (
            F.col("doc_id").eqNullSafe(F.col("d0"))
            & (F.col("text_key") == F.col("k0"))
            & (F.col("start") == F.col("s0"))
        ).alias("is_first"),
    )
    return Survey(repeated, checkpointed(rest))


def by_document(rest: DataFrame) -> DataFrame:
    """Runs to look into, gathered per document (bounded by the document's length)."""
    return rest.groupBy(*KEY).agg(
        F.collect_list(F.struct("start", "windows", "anchor", "n", "texts")).alias("runs")
    )


def struct_columns(lists: pa.Array, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each element of a list<struct> column, and its fields as numpy arrays."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    return rows, {n: flat.field(n).to_numpy(zero_copy_only=False) for n in names}


def repeated_by_count(windows: DataFrame, keep_first: bool, width: int) -> DataFrame:
    """Removal spans from rows (doc_id, text_key, at, anchor, window, n), by counting window hashes.

    ``n`` is how many equal runs the row stands for. With ``keep_first`` the earliest place stays.
    """
    place = F.struct("doc_id", "text_key", "at")
    seen = windows.groupBy("anchor", "window").agg(
        F.count(F.lit(1)).alias("places"), F.min(place).alias("first")
    )
    seen = checkpointed(seen.where("places > 1").drop("places"))
    mine = windows if keep_first else windows.where("n = 1")
    hits = mine.join(seen, ["anchor", "window"])
    if keep_first:
        same = (
            F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & (F.col("text_key") == F.col("first.text_key"))
            & (F.col("at") == F.col("first.at"))
        )
        hits = hits.where(~same)
    return hits.select(*KEY, F.col("at").alias("lo"), (F.col("at") + width).alias("hi"))


def whole_runs(found: Survey, keep_first: bool, width: int) -> DataFrame:
    rows = found.repeated.where("not is_first") if keep_first else found.repeated
    return rows.select(
        *KEY, F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1 + width).alias("hi")
    )


def spans_by_document(spans: DataFrame) -> DataFrame:
    """All spans of a document in one list (bounded by the document's length)."""
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by half-open spans; touching ones join."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[fresh], hi[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(lo) - 1]))]
