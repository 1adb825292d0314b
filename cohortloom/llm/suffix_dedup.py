"""Suffix-array dedup: longest-previous-factor arrays over the texts that may repeat.

Runs of windows that certainly repeat or certainly do not are settled by ``repeats``. What stays open
meets by anchor: the suffixes of these stretches are put in order by prefix doubling, and previous and
next smaller positions along that order give each position its longest earlier match (and, read the
other way round, its longest later match), capped at ``width`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed
from . import text as T
from .repeats import (
    by_document,
    merged,
    repeated_by_count,
    spans_by_document,
    struct_columns,
    survey,
    whole_runs,
)
from .shared import KEY, arrow_map, join_documents, keyed, release, small_batches, whole_groups
from .substring_dedup import WINDOWS, expand

WIDTH = 400
SEED = 160
# an anchor with more different surroundings than this is settled by counting window hashes instead
MOST_TEXTS = 1024
TASK_BYTES = 1 << 20

STRETCHES = (
    "doc_id long, text_key long, start int, windows int, anchor long, n long, texts long, "
    "stretch binary"
)
SPANS = "doc_id long, text_key long, lo int, hi int"


class SuffixOrder:
    """Order of the suffixes of a byte array by their first ``width`` bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, width: int):
        """``at``: the suffixes to order; each must have ``width`` bytes left."""
        n = len(data)
        padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
        step = min(8, width)
        key = np.zeros(n, np.uint64)
        for j in range(step):
            key = (key << np.uint64(8)) | padded[j : n + j]
        self.levels = [(step, self._dense(key))]
        while 2 * step <= width:
            rank = self.levels[-1][1]
            step *= 2
            self.levels.append((step, self._dense(self._pair(rank, rank, step // 2))))
        rank = self.levels[-1][1]
        last = rank[at].astype(np.uint64) * np.uint64(n + 1) + rank[at + width - step].astype(np.uint64)
        self.order = np.lexsort((at, last))
        self.at, self.width = at[self.order], width
        self.size = n

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        return rank

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        n = len(left)
        key = left.astype(np.uint64) * np.uint64(n + 1)
        key[: n - shift] += right[shift:].astype(np.uint64) + np.uint64(1)
        return key

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, at most ``width``."""
        done = np.zeros(len(a), np.int64)
        # the largest level may fit more than once; smaller ones at most once each
        step, rank = self.levels[-1]
        for _ in range(self.width // step):
            done += step * (rank[np.minimum(a + done, self.size - 1)]
                            == rank[np.minimum(b + done, self.size - 1)]) * (done + step <= self.width)
        for step, rank in reversed(self.levels[:-1]):
            fits = done + step <= self.width
            same = rank[np.minimum(a + done, self.size - 1)] == rank[np.minimum(b + done, self.size - 1)]
            done += step * (fits & same)
        # the last level looks back so that it ends exactly at ``width``
        step, rank = self.levels[-1]
        tail = self.width - step
        whole = (rank[a] == rank[b]) & (rank[a + tail] == rank[b + tail])
        return np.where(whole, self.width, done)


def previous_smaller(age: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each element, or -1, by pointer jumping."""
    before = np.arange(-1, len(age) - 1)
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[age[before[open_]] > age[open_]]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def longest_earlier(order: SuffixOrder, age: np.ndarray) -> np.ndarray:
    """Longest match of each suffix (in suffix order) with one of smaller ``age``."""
    n = len(age)
    back = previous_smaller(age)
    ahead = n - 1 - previous_smaller(age[::-1])[::-1]
    best = np.zeros(n, np.int64)
    for other in (back, ahead):
        has = np.flatnonzero((other >= 0) & (other < n))
        length = order.common(order.at[has], order.at[other[has]])
        best[has] = np.maximum(best[has], length)
    return best


def repeated_starts(stretches: list[bytes], width: int, keep_first: bool) -> list[np.ndarray]:
    """Window starts per stretch that occur in another one (or earlier), stretches oldest first."""
    sizes = np.array([len(s) for s in stretches])
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(stretches), np.uint8)
    which, at = expand(begin, sizes - width + 1)
    order = SuffixOrder(data, at, width)
    age = order.order  # ``at`` grows with age
    best = longest_earlier(order, age)
    if not keep_first:
        best = np.maximum(best, longest_earlier(order, -age))
    hit = np.zeros(len(at), bool)
    hit[order.order] = best >= width
    cut = np.searchsorted(which, np.arange(len(stretches) + 1))
    return [np.flatnonzero(hit[cut[i] : cut[i + 1]]) for i in range(len(stretches))]


def _stretches(docs: DataFrame, width: int) -> DataFrame:
    names = ["start", "windows", "anchor", "n", "texts"]

    def of_batch(batch):
        rows, runs = struct_columns(batch.column("runs"), names)
        texts = batch.column("text")
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        for row in range(batch.num_rows):
            mine = np.flatnonzero(rows == row)
            data = (texts[row].as_py() or "").encode()
            cut = [data[s : s + w - 1 + width] for s, w in
                   zip(runs["start"][mine].tolist(), runs["windows"][mine].tolist(), strict=True)]
            take = pa.array(np.full(len(mine), row))
            yield pa.record_batch(
                {
                    "doc_id": ids.take(take),
                    "text_key": keys.take(take),
                    **{n: runs[n][mine] for n in names},
                    "stretch": pa.array(cut, pa.binary()),
                }
            )

    return arrow_map(docs, of_batch, STRETCHES)


def _packed(anchors: np.ndarray, sizes: np.ndarray):
    """Ranges of rows that hold whole anchors and about ``TASK_BYTES`` bytes."""
    border = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]))
    total = np.concatenate(([0], np.cumsum(sizes)))
    lo = 0
    while lo < len(anchors):
        fit = border[np.searchsorted(total[border], total[lo] + TASK_BYTES, "right") - 1]
        hi = int(fit) if fit > lo else int(border[np.searchsorted(border, lo, "right")])
        yield lo, hi
        lo = hi


def _settle(stretches: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """Suffix order per anchor; every task sorts about ``TASK_BYTES`` at a time."""

    def run(batches):
        for table in whole_groups(batches, ["anchor"]):
            anchors = table["anchor"].to_numpy()
            for lo, hi in _packed(anchors, np.array([len(b.as_py()) for b in table["stretch"]])):
                part = table.slice(lo, hi - lo).combine_chunks()
                known = ~np.asarray(part["doc_id"].is_null())
                ids = part["doc_id"].fill_null(0).to_numpy()
                start = part["start"].to_numpy()
                age = np.lexsort((start, part["text_key"].to_numpy(), ids, known))
                texts = part["stretch"].to_pylist()
                hits = repeated_starts([texts[i] for i in age], width, keep_first)
                single = part["n"].to_numpy() == 1
                row, first, last = [], [], []
                for i, starts in zip(age.tolist(), hits, strict=True):
                    if len(starts) and (keep_first or single[i]):
                        a, b = merged(starts + start[i], starts + start[i] + width)
                        row += [i] * len(a)
                        first.append(a)
                        last.append(b)
                if row:
                    take = pa.array(row)
                    yield pa.record_batch(
                        {
                            "doc_id": part["doc_id"].combine_chunks().take(take),
                            "text_key": part["text_key"].combine_chunks().take(take),
                            "lo": np.concatenate(first).astype(np.int32),
                            "hi": np.concatenate(last).astype(np.int32),
                        }
                    )
            del table
            release()

    dealt = stretches.repartition("anchor").sortWithinPartitions("anchor")
    return small_batches(dealt).mapInArrow(run, SPANS)


def _window_rows(stretches: DataFrame, width: int) -> DataFrame:
    def of_batch(batch):
        for group in T.groups(_as_text(batch.column("stretch")), 1 << 19):
            sizes = np.diff(group.offsets)
            which, begin = expand(group.offsets[:-1], sizes - width + 1)
            hashes = T.mix(T.Rolling(T.BYTE_SYMBOL[group.data]).of(begin, begin + width))
            take = pa.array(which + group.lo)
            start = batch.column("start").to_numpy()[which + group.lo]
            yield pa.table(
                {
                    "doc_id": batch.column("doc_id").take(take),
                    "text_key": batch.column("text_key").take(take),
                    "at": (begin - group.offsets[which] + start).astype(np.int32),
                    "anchor": batch.column("anchor").take(take),
                    "window": T.signed(hashes),
                    "n": batch.column("n").take(take),
                }
            )

    return arrow_map(stretches, of_batch, WINDOWS)


def _as_text(column: pa.Array) -> pa.Array:
    """The same buffers under a text type; bytes need not be whole characters."""
    column = column.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(column), column.buffers(), offset=column.offset)


def removal_spans(
    own: DataFrame, width: int, keep_first: bool, seed: int, most_texts: int
) -> DataFrame:
    """(doc_id, text_key, spans) of the documents that lose bytes; ``own`` comes from ``keyed``."""
    found = survey(own.select(*KEY, "text"), "byte", width, seed)
    looked_at = join_documents(own.select(*KEY, "text"), by_document(found.rest), "inner")
    stretches = checkpointed(_stretches(looked_at, width).dropDuplicates([*KEY, "start", "anchor"]))
    few = _settle(stretches.where(F.col("texts") <= most_texts), width, keep_first)
    many = _window_rows(stretches.where(F.col("texts") > most_texts), width)
    spans = (
        whole_runs(found, keep_first, width)
        .unionByName(few)
        .unionByName(repeated_by_count(checkpointed(many), keep_first, width))
    )
    return spans_by_document(spans)


def remove_repeats(
    docs: DataFrame,
    width: int = WIDTH,
    keep_first: bool = True,
    seed: int = SEED,
    most_texts: int = MOST_TEXTS,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: doc_id, the named other columns, n_bytes, n_removed, spans, kept (binary).

    Texts are UTF-8 bytes (null: empty). A byte goes if a ``width``-byte string that covers it also
    starts earlier (``keep_first``; order: id with null first, then text hash, then place), or anywhere
    else, same document included. Rows equal in id and text share one place in that order, so with
    ``keep_first`` they keep or lose the same bytes. Texts shorter than ``width`` lose nothing.
    """
    own = keyed(docs, *columns)
    marked = join_documents(own, removal_spans(own, width, keep_first, seed, most_texts), "left")

    def of_batch(batch):
        rows, spans = struct_columns(batch.column("spans"), ["lo", "hi"])
        begin = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        texts = batch.column("text")
        n_bytes, n_removed, cut, kept = [], [], [], []
        for i in range(batch.num_rows):
            data = (texts[i].as_py() or "").encode()
            here = slice(begin[i], begin[i + 1])
            lo, hi = merged(spans["lo"][here], spans["hi"][here])
            left, at = [], 0
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                left.append(data[at:a])
                at = b
            left.append(data[at:])
            left = b"".join(left)
            n_bytes.append(len(data))
            n_removed.append(len(data) - len(left))
            cut.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            kept.append(left)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                **{c: batch.column(c) for c in columns},
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(cut, pa.list_(pa.struct({"lo": pa.int32(), "hi": pa.int32()}))),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    kinds = dict(own.dtypes)
    extra = "".join(f"{c} {kinds[c]}, " for c in columns)
    schema = (
        f"doc_id long, {extra}n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, "
        "kept binary"
    )
    return arrow_map(marked, of_batch, schema)


def whole_words(raw: bytes, lo: int, hi: int) -> int:
    """Words of ``raw`` that lie in ``raw[lo:hi]`` from end to end."""
    words = len(raw[lo:hi].split())
    cut_open = lo > 0 and not T.IS_SPACE[raw[lo - 1]] and not T.IS_SPACE[raw[lo]]
    cut_close = hi < len(raw) and not T.IS_SPACE[raw[hi]] and not T.IS_SPACE[raw[hi - 1]]
    return max(0, words - cut_open - cut_close)


def clean(docs: DataFrame, width: int = WIDTH, least_words: int = 0, **options) -> DataFrame:
    """``docs`` with later copies of ``width``-byte strings cut out of the texts, first ones kept.

    Of the maximal stretches so covered only those with ``least_words`` whole words or more are cut.
    A character that a cut leaves incomplete goes too. ``n_chars``, where there is one, follows the
    new text; texts that lose nothing, nulls included, stay as they are. No row goes.
    """
    columns = docs.columns
    own = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__k": F.xxhash64(F.col("text"))})
    slim = keyed(docs)
    spans = removal_spans(
        slim, width, True, options.get("seed", SEED), options.get("most_texts", MOST_TEXTS)
    ).withColumnsRenamed({"doc_id": "__sd", "text_key": "__sk", "spans": "__spans"})
    marked = own.join(
        spans, F.col("__d").eqNullSafe(F.col("__sd")) & (F.col("__k") == F.col("__sk")), "left"
    ).select(*columns, "__spans")

    def of_batch(batch):
        rows, spans = struct_columns(batch.column("__spans"), ["lo", "hi"])
        begin = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        touched = np.flatnonzero(np.diff(begin))
        data = {c: batch.column(c) for c in columns}
        if len(touched):
            texts = data["text"].to_pylist()
            sizes = data["n_chars"].to_pylist() if "n_chars" in data else None
            for i in touched.tolist():
                raw = texts[i].encode()
                here = slice(begin[i], begin[i + 1])
                left, at = [], 0
                for a, b in zip(*(x.tolist() for x in merged(spans["lo"][here], spans["hi"][here])), strict=True):
                    if not least_words or whole_words(raw, a, b) >= least_words:
                        left.append(raw[at:a].decode(errors="ignore"))
                        at = b
                left.append(raw[at:].decode(errors="ignore"))
                texts[i] = "".join(left)
                if sizes is not None:
                    sizes[i] = len(texts[i])
            data["text"] = pa.array(texts, pa.string())
            if sizes is not None:
                data["n_chars"] = pa.array(sizes, data["n_chars"].type)
        yield pa.record_batch(data)

    return arrow_map(marked, of_batch, docs.schema)
