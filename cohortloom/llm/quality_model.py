"""Quality classifier by positive-unlabelled learning: non-negative risk, estimated class prior.

A text becomes one small code per statistic (which interval its value falls into). The model is linear
in the indicators of these codes, and the loss is the squared one, so the risk of any model is a
function of how often codes occur together: among the trusted positives, and among all texts as
unlabelled web text. Spark counts both tables once over everything; the number of cells is fixed. The
class prior comes from the share of unlabelled texts where positives are (the least ratio of the tails
of a first classifier's scores). The risk is then minimised on the counted cells, with the negative
part held at zero or above.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed
from . import text as T
from .shared import arrow_map

RIDGE = 1.0
STEPS, PACE = 200, 0.1
FOLDS, HELD_OUT = 5, 0
GRAIN = 500

_SHARES = (0.0, 0.001, 0.004, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6)
_SIZES = (0.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0, 25.0, 100.0)
_COUNTS = (0.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 640.0, 2560.0, 10240.0)
# statistic -> upper ends of its intervals; what is above the last is one more
STATISTICS = {
    "words": _COUNTS,
    "word_bytes": _SIZES,
    "longest_word": _SIZES,
    "words_a_line": _COUNTS,
    "upper": _SHARES,
    "digits": _SHARES,
    "not_ascii": _SHARES,
    "stops": _SHARES,
    "commas": _SHARES,
    "exclaimed": _SHARES,
    "asked": _SHARES,
    "quotes": _SHARES,
    "brackets": _SHARES,
    "joins": _SHARES,
    "signs": _SHARES,
    "bars": _SHARES,
    "control": _SHARES,
    "wordless": _SHARES,
    "capital_words": _SHARES,
    "stutter": _SHARES,
    "repeated_pairs": _SHARES,
    "repeated_lines": _SHARES,
}
WIDTH = 1 + max(len(e) for e in STATISTICS.values())
CODES = len(STATISTICS) * WIDTH

_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": "0123456789",
    "stops": ".",
    "commas": ",;:",
    "exclaimed": "!",
    "asked": "?",
    "quotes": "'\"`",
    "brackets": "()[]{}",
    "joins": "-_/\\",
    "signs": "#$%&*+<=>@^~",
    "bars": "|",
}
_CLASS_OF = np.zeros(256, np.uint8)
for _i, _c in enumerate(_CLASSES.values()):
    _CLASS_OF[[ord(c) for c in _c]] = _i + 1
_CLASS_OF[128:] = len(_CLASSES) + 1
_CLASS_OF[[c for c in range(32) if c not in (9, 10, 13)] + [127]] = len(_CLASSES) + 2
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LINE_BREAK = np.zeros(256, bool)
_LINE_BREAK[10] = True


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n) if len(owner) else np.zeros(n)


def _repeats(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text the share of its values that equal an earlier one."""
    total = np.bincount(owner, minlength=n)
    _, border = T.distinct_per_text(values, owner, n)
    return (total - np.diff(border)) / np.maximum(total, 1)


def statistics(group: T.Group) -> np.ndarray:
    """Texts x statistics; a text without a word has zeros for everything about words."""
    n = group.hi - group.lo
    found = T.words(group)
    owner, size = found.owner(), (found.end - found.start).astype(float)
    words = np.diff(found.first)
    chars = np.diff(np.concatenate(([0], np.cumsum(~_CONTINUES[group.data])))[group.offsets])
    whole = np.maximum(chars, 1)
    text_of = np.repeat(np.arange(n), np.diff(group.offsets))
    # continuation bytes belong to the character they continue
    lead = ~_CONTINUES[group.data]
    counts = np.bincount(
        text_of[lead] * 16 + _CLASS_OF[group.data[lead]], minlength=n * 16
    ).reshape(n, 16)
    out = {name: counts[:, i + 1] / whole for i, name in enumerate(_CLASSES)}
    out["not_ascii"] = counts[:, len(_CLASSES) + 1] / whole
    out["control"] = counts[:, len(_CLASSES) + 2] / whole
    some = np.maximum(words, 1)
    letters = np.concatenate(([0], np.cumsum(_LETTER[group.data])))
    out["words"] = words.astype(float)
    out["word_bytes"] = _sums(size, owner, n) / some
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    out["longest_word"] = longest
    out["wordless"] = _sums((letters[found.end] == letters[found.start]).astype(float), owner, n) / some
    first = group.data[found.start] if len(owner) else np.zeros(0, np.uint8)
    out["capital_words"] = _sums(((first >= 65) & (first <= 90)).astype(float), owner, n) / some
    same = np.zeros(len(owner))
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (owner[1:] == owner[:-1])
    out["stutter"] = _sums(same, owner, n) / some
    pairs, pair_of = T.shingles(found, 2)
    out["repeated_pairs"] = _repeats(pairs, pair_of, n)
    lines = T.words(group, between=_LINE_BREAK)
    out["repeated_lines"] = _repeats(lines.hash, lines.owner(), n)
    out["words_a_line"] = words / np.maximum(np.diff(lines.first), 1)
    return np.stack([out[name] for name in STATISTICS], axis=1)


def encode(values: np.ndarray) -> np.ndarray:
    """Texts x statistics, each value as the number of the interval it falls into."""
    return np.stack(
        [np.searchsorted(ends, values[:, k], "left") for k, ends in enumerate(STATISTICS.values())], axis=1
    ).astype(np.uint8)


def coded(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``codes`` (one byte per statistic) of every row."""
    kept = docs.select(*columns, "text")
    fields = ", ".join(f"{c} {t}" for c, t in kept.dtypes if c != "text")

    def of_batch(batch):
        made = [encode(statistics(g)) for g in T.groups(batch.column("text"))]
        if made:
            flat = np.concatenate(made)
            data = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat.tobytes())]
            ).cast(pa.binary())
            yield pa.table({**{c: batch.column(c) for c in columns}, "codes": data})

    return arrow_map(kept, of_batch, f"{fields}, codes binary")


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8)
    return flat.reshape(-1, len(STATISTICS)).astype(np.int64) + np.arange(len(STATISTICS)) * WIDTH


def _indicators(batch: pa.RecordBatch) -> np.ndarray:
    hot = np.zeros((batch.num_rows, CODES), np.float32)
    np.put_along_axis(hot, _codes(batch), 1, axis=1)
    return hot


def together(rows: DataFrame) -> DataFrame:
    """(cell, everything, positive): how many rows hold two codes together, smaller code first.

    A task adds up its batches first, so what it sends has a fixed bound.
    """

    def run(batches):
        total = np.zeros((2, CODES, CODES))
        for batch in batches:
            hot = _indicators(batch)
            total[0] += hot.T @ hot
            hot = hot[batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)]
            total[1] += hot.T @ hot
        cells = np.flatnonzero(np.triu(total[0]))
        if len(cells):
            yield pa.record_batch(
                {
                    "cell": cells,
                    "everything": total[0].ravel()[cells].astype(np.int64),
                    "positive": total[1].ravel()[cells].astype(np.int64),
                }
            )

    found = rows.select("codes", "positive").mapInArrow(run, "cell long, everything long, positive long")
    return found.groupBy("cell").agg(F.sum("everything").alias("everything"), F.sum("positive").alias("positive"))


class Model(NamedTuple):
    """Weights per code, the estimated share of positives, and the trusted positives it was learnt from."""

    weights: np.ndarray
    prior: float
    positives: int


def scored(rows: DataFrame, weights: np.ndarray, *columns: str) -> DataFrame:
    """``columns`` and ``score``, the model's probability of a positive, between 0 and 1."""
    kept = rows.select(*columns, "codes")
    fields = ", ".join(f"{c} {t}" for c, t in kept.dtypes if c != "codes")

    def of_batch(batch):
        if batch.num_rows:
            value = (1 + weights[_codes(batch)].sum(axis=1)) / 2
            yield pa.table({**{c: batch.column(c) for c in columns}, "score": np.clip(value, 0.0, 1.0)})

    return arrow_map(kept, of_batch, f"{fields}, score double")


def class_prior(tails: list[tuple[float, int, int]]) -> float:
    """Share of positives from (score, unlabelled rows, positives): least ratio of the upper tails.

    Above any score the unlabelled tail holds the positives' tail times the prior and more; the
    ratio is least where negatives end. A sampling bound keeps thin tails from deciding.
    """
    tails = sorted(tails, reverse=True)
    unlabelled = np.cumsum([u for _, u, _ in tails])
    positive = np.cumsum([p for _, _, p in tails])
    doubt = 1.01 * sum(math.sqrt(math.log(40) / 2 / n[-1]) for n in (unlabelled, positive))
    share_u, share_p = unlabelled / unlabelled[-1], np.maximum(positive / positive[-1], 1e-12)
    at = int(np.argmin((share_u + doubt) / share_p))
    return float(min(1.0, share_u[at] / share_p[at]))


def _steps() -> np.ndarray:
    """Codes x features: a constant, and for every statistic "above this interval's end" marks.

    Neighbouring intervals share all marks but one, so few positives still shape a smooth model.
    """
    marks = [np.ones((CODES, 1))]
    marks[0][WIDTH:] = 0  # every row has one code of the first statistic
    for k in range(len(STATISTICS)):
        own = np.zeros((CODES, WIDTH - 1))
        own[k * WIDTH : (k + 1) * WIDTH] = np.tril(np.ones((WIDTH, WIDTH)))[:, 1:]
        marks.append(own)
    return np.concatenate(marks, axis=1)


def _discriminator(both_u: np.ndarray, both_p: np.ndarray, ridge: float) -> np.ndarray:
    """Least-squares weights that tell positives (1) from unlabelled texts (-1), both weighing the same."""
    return np.linalg.solve(both_u + both_p + ridge * np.eye(len(both_u)), both_p[0] - both_u[0])


def minimise(both_u: np.ndarray, both_p: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """Weights of least non-negative risk under the squared loss (1 - y g)^2 / 4.

    ``both`` are second moments of the features; the first feature is the constant, so its row has the
    means. The risk of negatives, unlabelled minus prior times positive, is held at zero: where it falls
    below, the step goes back up along it. Steps are scaled by the curvature of the unlabelled part.
    """
    mean_u, mean_p = both_u[0], both_p[0]
    scale = PACE * np.linalg.inv(both_u / 2 + 2 * ridge * np.eye(len(both_u)))
    w = np.zeros(len(both_u))
    for _ in range(STEPS):
        fall_u = (1 + 2 * mean_u @ w + w @ both_u @ w) / 4
        fall_p = (1 + 2 * mean_p @ w + w @ both_p @ w) / 4
        rise_n = (mean_u + both_u @ w) / 2 - prior * (mean_p + both_p @ w) / 2
        if fall_u - prior * fall_p < 0:
            w = w + scale @ rise_n
            continue
        rise_p = -prior * (mean_p - both_p @ w) / 2
        w = w - scale @ (rise_p + rise_n + 2 * ridge * w)
    return w


def learn(rows: DataFrame) -> Model:
    """Model from ``codes`` and ``positive`` (a trusted positive); every row counts as unlabelled.

    Without rows or without positives the weights are zero and every score is a half.
    """
    cells = together(rows).collect()  # at most CODES * (CODES + 1) / 2 cells
    counts = np.zeros((2, CODES * CODES))
    for cell, everything, positive in cells:
        counts[:, cell] = everything, positive
    counts = counts.reshape(2, CODES, CODES)
    counts += np.triu(counts, 1).transpose(0, 2, 1)
    everything, positives = (int(c.diagonal()[:WIDTH].sum()) for c in counts)
    if not positives:
        return Model(np.zeros(CODES), 0.5, 0)
    basis = _steps()
    both_u, both_p = basis.T @ counts[0] @ basis / everything, basis.T @ counts[1] @ basis / positives
    ridge = RIDGE / positives
    first = scored(rows, basis @ _discriminator(both_u, both_p, ridge), "positive")
    tails = (
        first.groupBy(F.round(F.col("score") * GRAIN).alias("at"))
        .agg(F.count(F.lit(1)).alias("u"), F.sum(F.col("positive").cast("long")).alias("p"))
        .collect()  # at most GRAIN + 1 rows
    )
    prior = class_prior([tuple(r) for r in tails])
    return Model(basis @ minimise(both_u, both_p, prior, ridge), prior, positives)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept away from learning; a null id has no label to keep."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Trusted positives are documents whose labels outside the held-out fold all say quality 1; labels of
    quality 0 are not used. Every text, labelled or not, is unlabelled web text to the risk. Scores see
    the text alone: null and empty texts are texts without words, equal texts have equal scores, and
    texts of any length count whole. Repeated rows and rows that share an id each get a row. An empty
    table gives no rows; without positives every score is a half. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = checkpointed(coded(rows, "doc_id"))
    trusted = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("least"))
        .where("least = 1")
        .select("doc_id", F.lit(True).alias("positive"))
    )
    marked = checkpointed(
        rows.join(trusted, "doc_id", "left").select(
            "codes", F.coalesce("positive", F.lit(False)).alias("positive")
        )
    )
    model = learn(marked)
    found = scored(rows, model.weights, "doc_id")
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
