"""Quality rules: per-text counts, and lines that too many documents of one host carry.

Lines are normalised (words joined by one space, A-Z lower-cased) and hashed; per host (the ``source``
column) the distinct documents that hold a line are counted, lines above the limit are removed, and a
document that loses too large a share of its words is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed
from . import text as T
from .shared import KEY, arrow_map

# production parameters
LEAST_DOCUMENTS = 5  # so few documents share a line by chance
HOST_SHARE = 0.1
MOST_DOCUMENTS = 10_000  # more than these share no line but boilerplate, however large the host
LEAST_LEFT = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = (
    "doc_id long, text_key long, source string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"
)


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marks)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(found: T.Words) -> np.ndarray:
    """Per text, words in 3-word windows that occur at least twice in it."""
    n_texts = len(found.first) - 1
    at = T.spans_inside(found.first, 3)
    owner = np.searchsorted(found.first, at, "right") - 1
    value = T.Rolling(found.hash).of(at, at + 3)
    key = T.mix(value ^ T.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    begin = at[counts[place] > 1]
    covered = np.zeros(len(found.hash) + 3, bool)
    for k in range(3):
        covered[begin + k] = True
    return _per_text(covered[: len(found.hash)], found.first) if n_texts else np.zeros(0, np.int64)


def _line_of(group: T.Group, found: T.Words) -> np.ndarray:
    """Number of the line each word is on; a new text starts a new line."""
    breaks = np.zeros(len(group.data) + 1, np.int64)
    breaks[np.flatnonzero(group.data == 0x0A) + 1] = 1
    np.add.at(breaks, group.offsets[:-1], 1)
    return np.cumsum(breaks)[found.start]


def _lines(group: T.Group, found: T.Words, folded: np.ndarray):
    """(text, normalised hash, words) of every line with a word, and the exact hash of its bytes."""
    line = _line_of(group, found)
    if not len(line):
        return line, found.hash, line, found.hash
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    stop = np.concatenate((first[1:], [len(line)]))
    owner = np.searchsorted(found.first, first, "right") - 1
    normal = T.mix(T.Rolling(folded).of(first, stop) + (stop - first).astype(np.uint64))
    # exact line: from the break before to the break after it
    breaks = np.flatnonzero(group.data == 0x0A)
    at = found.start[first]
    before = np.searchsorted(breaks, at)
    lo = np.where(before > 0, breaks[before - 1] + 1, 0) if len(breaks) else np.zeros(len(at), np.int64)
    hi = breaks[np.minimum(before, len(breaks) - 1)] if len(breaks) else np.full(len(at), len(group.data))
    hi = np.where(before < len(breaks), hi, len(group.data))
    lo, hi = np.maximum(lo, group.offsets[owner]), np.minimum(hi, group.offsets[owner + 1])
    exact = T.mix(T.Rolling(T.BYTE_SYMBOL[group.data]).of(lo, hi) + (hi - lo).astype(np.uint64))
    return owner, normal, stop - first, exact


def measured(own: DataFrame) -> DataFrame:
    """Base counts and distinct normalised lines (with their total words) of every text."""

    def of_batch(batch):
        for group in T.groups(batch.column("text"), 1 << 20):
            n = group.hi - group.lo
            found, folded = T.words(group), T.words(group, fold=True).hash
            solid = ~T.IS_SPACE[group.data] & ((group.data & 0xC0) != 0x80)
            owner, normal, words, exact = _lines(group, found, folded)
            dup = T.mix(exact ^ T.mix(owner.astype(np.uint64) + np.uint64(1)))
            _, first = np.unique(dup, return_index=True)
            n_dup = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)
            order = np.lexsort((normal, owner))
            owner, normal, words = owner[order], normal[order], words[order]
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (normal[1:] != normal[:-1])
            begin = np.flatnonzero(fresh)
            words = np.add.reduceat(words, begin) if len(begin) else words
            border = np.searchsorted(owner[begin], np.arange(n + 1)).astype(np.int32)
            lines = pa.StructArray.from_arrays(
                [pa.array(T.signed(normal[begin])), pa.array(words.astype(np.int32))], ["line", "words"]
            )
            part = batch.slice(group.lo, n)
            yield pa.table(
                {
                    "doc_id": part.column("doc_id"),
                    "text_key": part.column("text_key"),
                    "source": part.column("source"),
                    "n_words": np.diff(found.first),
                    "word_chars": _per_text(solid, group.offsets),
                    "n_symbols": _per_text(_SYMBOL[group.data], group.offsets),
                    "n_dup_lines": n_dup,
                    "n_repeat_words": _repeat_words(found),
                    "lines": pa.ListArray.from_arrays(pa.array(border), lines),
                }
            )

    return arrow_map(own, of_batch, STATS)


def frequent_lines(stats: DataFrame, least_documents: int, host_share: float, most_documents: int) -> DataFrame:
    """(source, line) above the limits: more than ``host_share`` of the host's distinct documents, and more
    than chance gives (``least_documents``); or more than ``most_documents``, whatever the share. Rows
    equal in text are one document: copies of a whole document are for a deduplicator, not boilerplate."""
    host = F.col("source")
    # exact copies and repeated rows count once
    texts = stats.groupBy("source", "text_key").agg(F.first("lines").alias("lines"))
    texts = checkpointed(texts)
    totals = texts.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    counts = (
        texts.select(host, F.explode("lines.line").alias("line"))
        .groupBy("source", "line")
        .agg(F.count(F.lit(1)).alias("holders"))
        .where(F.col("holders") > least_documents)
    )
    totals = totals.withColumnRenamed("source", "host")
    above = counts.join(totals, F.col("source").eqNullSafe(F.col("host")))
    share = F.col("holders") > host_share * F.col("documents")
    return above.where(share | (F.col("holders") > most_documents)).select("source", "line")


def judged(
    docs: DataFrame,
    least_documents: int = LEAST_DOCUMENTS,
    host_share: float = HOST_SHARE,
    least_left: float = LEAST_LEFT,
    most_documents: int = MOST_DOCUMENTS,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source, ...): base counts, base_failed, removed lines, kept.

    Null texts count as none. A null source is a host of its own. ``removed`` holds the hashes of the
    document's lines above the limit, ``n_removed_words`` their words. A document is depleted, and not
    kept, if fewer than ``least_left`` of its words remain. Repeated rows get the same row each.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text")).alias("text_key"),
        "text",
        F.col("source").cast("string").alias("source"),
    )
    stats = checkpointed(measured(own))
    above = checkpointed(frequent_lines(stats, least_documents, host_share, most_documents))
    above = above.withColumnsRenamed({"source": "host", "line": "frequent"})
    held = stats.select(*KEY, "source", F.explode("lines").alias("l"))
    lost = (
        held.join(above, (F.col("l.line") == F.col("frequent")) & F.col("source").eqNullSafe(F.col("host")))
        .groupBy(*KEY, "source", "frequent")
        .agg(F.max("l.words").alias("words"))
        .groupBy(*KEY, "source")
        .agg(F.collect_list("frequent").alias("removed"), F.sum("words").alias("n_removed_words"))
        .withColumnRenamed("source", "host")
    )
    lost = lost.withColumnsRenamed({k: f"lost_{k}" for k in KEY})
    out = stats.drop("lines").join(
        lost,
        F.col("doc_id").eqNullSafe(F.col("lost_doc_id"))
        & (F.col("text_key") == F.col("lost_text_key"))
        & F.col("source").eqNullSafe(F.col("host")),
        "left",
    )
    gone = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words")
    )
    return out.select(
        *KEY,
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.col("removed"),
        gone.cast("long").alias("n_removed_words"),
        (~failed & (F.col("n_words") - gone >= least_left * F.col("n_words"))).alias("kept"),
    )


def _without(text: str | None, removed: set[int]) -> str | None:
    """The text without the lines whose normalised hash is in ``removed``."""
    lines = text.split("\n")
    column = pa.array(lines)
    (group,) = T.groups(column, limit=1 << 62)
    found = T.words(group, fold=True)
    n = np.diff(found.first)
    hashes = T.signed(
        T.mix(T.Rolling(found.hash).of(found.first[:-1], found.first[1:]) + n.astype(np.uint64))
    )
    return "\n".join(
        line for line, h, k in zip(lines, hashes.tolist(), n.tolist(), strict=True)
        if not k or h not in removed
    )


def clean(docs: DataFrame, **options) -> DataFrame:
    """The kept documents without their frequent lines, in the columns of ``docs``.

    ``n_chars``, where there is one, follows the new text. Rejected documents go; repeated rows stay
    repeated.
    """
    found = judged(docs, **options).where("kept").select(
        F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("source").alias("__s"), F.col("removed").alias("__r")
    )
    # rows equal in id, text and host have equal verdicts
    found = checkpointed(found.groupBy("__d", "__k", "__s").agg(F.first("__r").alias("__r")))
    columns = docs.columns
    rows = docs.join(
        found,
        F.col("doc_id").cast("long").eqNullSafe(F.col("__d"))
        & (F.xxhash64(F.col("text")) == F.col("__k"))
        & F.col("source").cast("string").eqNullSafe(F.col("__s")),
    ).select(*columns, "__r")

    def of_batch(batch):
        texts = batch.column("text").to_pylist()
        removed = batch.column("__r").to_pylist()
        new = [_without(t, set(r)) if r else t for t, r in zip(texts, removed, strict=True)]
        data = {c: batch.column(c) for c in columns}
        data["text"] = pa.array(new, pa.string())
        if "n_chars" in data:
            sizes = [None if t is None else len(t) for t in new]
            kept = batch.column("n_chars").to_pylist()
            same = [k if not r else s for k, s, r in zip(kept, sizes, removed, strict=True)]
            data["n_chars"] = pa.array(same, batch.column("n_chars").type)
        yield pa.record_batch(data)

    return arrow_map(rows, of_batch, rows.drop("__r").schema)
