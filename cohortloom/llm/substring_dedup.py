"""Substring dedup: Rabin-Karp hashes of every token window, counted in Spark.

Every ``width``-word window is hashed; anchors (see ``repeats``) tell which can occur twice, the
hashes of those that stay open are counted, and repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

import re

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
from .shared import arrow_map, join_documents, keyed

WIDTH = 35
SEED = 12
WINDOWS = "doc_id long, text_key long, at int, anchor long, window long, n long"
RESULT = (
    "doc_id long, n_words long, n_removed long, spans array<struct<lo:int,hi:int>>, kept_text string"
)


def expand(start, count):
    """Every element of the ranges ``start .. start + count``: the range it is from, and its value."""
    which = np.repeat(np.arange(len(start)), count)
    first = np.cumsum(count) - count
    return which, np.arange(len(which)) - first[which] + start[which]


def window_rows(docs: DataFrame, width: int) -> DataFrame:
    """Hash of each window of the listed ``runs`` of each document."""

    def of_batch(batch):
        rows, runs = struct_columns(batch.column("runs"), ["start", "windows", "anchor", "n"])
        for group in T.groups(batch.column("text")):
            found = T.words(group)
            mine = np.flatnonzero((rows >= group.lo) & (rows < group.hi))
            which, at = expand(runs["start"][mine].astype(np.int64), runs["windows"][mine])
            if not len(at):
                continue
            run = mine[which]
            begin = found.first[rows[run] - group.lo] + at
            hashes = T.mix(T.Rolling(found.hash).of(begin, begin + width))
            take = pa.array(rows[run])
            yield pa.table(
                {
                    "doc_id": batch.column("doc_id").take(take),
                    "text_key": batch.column("text_key").take(take),
                    "at": at.astype(np.int32),
                    "anchor": runs["anchor"][run],
                    "window": T.signed(hashes),
                    "n": runs["n"][run],
                }
            )

    return arrow_map(docs, of_batch, WINDOWS)


def removal_spans(own: DataFrame, width: int, keep_first: bool, seed: int) -> DataFrame:
    """(doc_id, text_key, spans) of the documents that lose words; ``own`` comes from ``keyed``."""
    found = survey(own, "word", width, seed)
    looked_at = join_documents(own, by_document(found.rest), "inner")
    windows = checkpointed(window_rows(looked_at, width))
    spans = whole_runs(found, keep_first, width).unionByName(
        repeated_by_count(windows, keep_first, width)
    )
    return spans_by_document(spans)


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): words, removed words, removed word spans, kept text.

    A word goes if a window of ``width`` words that covers it has a word sequence that starts anywhere
    else, in the same document too; all copies go. Kept words are joined by one space. Null and empty
    texts, and texts shorter than a window, lose nothing. Repeated rows are copies of each other. Other
    columns of ``docs`` are ignored.
    """
    own = keyed(docs)
    marked = join_documents(own, removal_spans(own, width, False, seed), "left")

    def of_batch(batch):
        rows, spans = struct_columns(batch.column("spans"), ["lo", "hi"])
        texts = batch.column("text")
        begin = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        n_words, n_removed, cut, kept = [], [], [], []
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or "").encode().split()
            here = slice(begin[i], begin[i + 1])
            lo, hi = merged(spans["lo"][here], spans["hi"][here])
            left, at = [], 0
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                left += words[at:a]
                at = b
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            cut.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            kept.append(b" ".join(left).decode())
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(cut, pa.list_(pa.struct({"lo": pa.int32(), "hi": pa.int32()}))),
                "kept_text": pa.array(kept, pa.string()),
            }
        )

    return arrow_map(marked, of_batch, RESULT)


def clean(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``docs`` with later copies of ``width``-word sequences cut out of the texts, first ones kept.

    The order is that of ``suffix_dedup``: id with null first, then text hash, then place. White space
    around a cut stays. ``n_chars``, where there is one, follows the new text; texts that lose nothing,
    nulls included, stay as they are. No row goes.
    """
    columns = docs.columns
    own = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__k": F.xxhash64(F.col("text"))})
    spans = removal_spans(keyed(docs), width, True, seed).withColumnsRenamed(
        {"doc_id": "__sd", "text_key": "__sk", "spans": "__spans"}
    )
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
                words = [m.span() for m in re.finditer(rb"\S+", raw)]
                here = slice(begin[i], begin[i + 1])
                left, at = [], 0
                for a, b in zip(*(x.tolist() for x in merged(spans["lo"][here], spans["hi"][here])), strict=True):
                    left.append(raw[at : words[a][0]])
                    at = words[b - 1][1]
                left.append(raw[at:])
                texts[i] = b"".join(left).decode()
                if sizes is not None:
                    sizes[i] = len(texts[i])
            data["text"] = pa.array(texts, pa.string())
            if sizes is not None:
                data["n_chars"] = pa.array(sizes, data["n_chars"].type)
        yield pa.record_batch(data)

    return arrow_map(marked, of_batch, docs.schema)
