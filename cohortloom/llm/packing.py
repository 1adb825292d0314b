"""Best-fit packing by sums of squares: token ids of documents into sequences of a fixed length.

Documents become pieces of at most ``length`` tokens; only longer documents are cut. Pieces of equal
rank meet in groups of about ``GROUP`` (pieces that fill a sequence need no group), each group is
packed by the sum-of-squares rule, and only lengths and places travel, never tokens.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed
from .shared import arrow_map, keyed

LENGTH = 2048
END = 0
GROUP = 20_000
# entries of the newer half of a worker's tables
MOST_WORDS = 50_000
MOST_PARTS = 250_000
_SPACE = re.compile(r"[\x20\x09-\x0D]+")

PIECES = "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long, row long"
PLACED = (
    "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long, "
    "sequence_id long, offset long"
)


def tokenizer_path() -> str:
    """File of the public word-level BPE, as the tokenizer package names it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# what only the whole tokenizer reads right: characters beyond composed Latin-1 letters and visible ASCII,
# and special tokens
_ODD = re.compile(r"[^\x09-\x0D\x20-~À-ÖØ-öø-ÿ]|<\|")
# the tokenizer's own split of lower-cased text, for the other characters
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
# the byte-level alphabet: visible Latin-1 characters stand for themselves, the rest follow from 256
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class _Known(dict):
    """Bounded table of made values: full, it becomes the older half, from which what is asked comes back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class TokenBytes:
    """Text -> little-endian 32-bit ids, from tables of letter runs, digits and marks filled on demand.

    The tokenizer drops white space and never joins across it or across a split, so a text's ids are
    those of its parts in turn; the parts of a corpus repeat themselves far more than its texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        self.parts = _Known(self._of_part, MOST_PARTS)
        self.words = _Known(self._of_word, MOST_WORDS)

    def _of_part(self, part: str) -> bytes:
        coded = part if part.isascii() else part.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.tokenize(coded)]).tobytes()

    def _of_word(self, word: str) -> bytes:
        if _ODD.search(word):
            return array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        return self._plain(word)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _ODD.search(text):
            return self._plain(text)
        # ASCII white space only: it is white space to the tokenizer whatever stands around it
        return b"".join(map(self.words.__getitem__, filter(None, _SPACE.split(text))))


@cache
def token_bytes(path: str) -> TokenBytes:
    """One table per worker process."""
    return TokenBytes(path)


def cut_pieces(docs: DataFrame, length: int, path: str) -> DataFrame:
    """Pieces of every row of ``docs``; ``row`` tells repeated rows apart."""
    end = np.array([END], "<u4").tobytes()

    def of_batch(batch):
        table = token_bytes(path)
        out = {n: [] for n in ("at", "piece", "start", "length", "ids_crc32")}
        for i, text in enumerate(batch.column("text")):
            ids = table.of(text.as_py()) + end
            for piece, lo in enumerate(range(0, len(ids), 4 * length)):
                part = ids[lo : lo + 4 * length]
                for name, x in zip(out, (i, piece, lo // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(x)
        take = pa.array(out.pop("at"), pa.int64())
        yield pa.table(
            {
                "doc_id": batch.column("doc_id").take(take),
                "text_key": batch.column("text_key").take(take),
                "piece": pa.array(out["piece"], pa.int32()),
                "start": pa.array(out["start"], pa.int64()),
                "length": pa.array(out["length"], pa.int64()),
                "ids_crc32": pa.array(out["ids_crc32"], pa.int64()),
                "row": batch.column("row").take(take),
            }
        )

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    return arrow_map(rows, of_batch, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) per piece: each goes where the squared counts of open bins per gap end smallest.

    Ties take the smallest gap, so a full bin is preferred. Bins are stacks per gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    place = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    bins = 0
    for i, size in enumerate(lengths.tolist()):
        # an open bin of gap g becomes one of gap g - size: the change of the sum, halved
        change = count[: capacity - size + 1] - count[size:]
        change[0] = -count[size]
        change = 2 * change + 2
        change[0] -= 1
        change[count[size:] == 0] = np.iinfo(np.int64).max
        # a new bin starts with gap ``capacity``; it is not open before
        change[-1] = 2 * count[capacity - size] + 1 if size < capacity else 0
        gap = size + int(np.argmin(change))
        if gap == capacity:
            which, bins = bins, bins + 1
        else:
            which = stacks[gap].pop()
            count[gap] -= 1
        place[i], offset[i] = which, capacity - gap
        if gap > size:
            stacks[gap - size].append(which)
            count[gap - size] += 1
    return place, offset


def packed(
    docs: DataFrame, length: int = LENGTH, path: str | None = None, group: int = GROUP
) -> DataFrame:
    """One row per piece: doc_id, text_key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one end id; null and empty texts are the end id alone. Sequences
    have no gaps from 0 on. Sequence ids are unique, not dense. Repeated rows are packed once each;
    other columns of ``docs`` are ignored.
    """
    pieces = checkpointed(cut_pieces(keyed(docs), length, path or tokenizer_path()))
    open_ = pieces.where(F.col("length") < length)
    groups = max(1, round(open_.count() / group))
    full = pieces.where(F.col("length") == length)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        # long pieces first, so that short ones fill what is left
        rows = rows.sort_values(["length", "row", "piece"], ascending=[False, True, True])
        place, offset = sum_of_squares(rows["length"].to_numpy(), length)
        # negative ids: those of full pieces are not
        rows["sequence_id"] = -1 - (place * groups + rows["group"].to_numpy())
        rows["offset"] = offset
        return rows[[c.split()[0] for c in PLACED.split(", ")]]

    dealt = open_.withColumn(
        "group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long")
    )
    small = dealt.groupBy("group").applyInPandas(pack, PLACED)
    alone = full.select(
        "doc_id",
        "text_key",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return small.unionByName(alone)
