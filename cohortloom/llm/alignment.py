"""Cross-tokenizer alignment: groups, links and corpus-wide best partners of two tokenizers' tokens.

Two token streams of one text overlap by byte ranges. Every token points to its farthest-right
overlapping token of the other stream; doubling these pointers (``succ = succ[succ]``) leads each token to
the last token of its connected group. Equal groups of a chunk of texts are kept once: a chunk's row
holds the links of its different groups and, per document, the sequence of groups. Only a chunk's
different id pairs travel to be counted over the corpus, and only their counts come back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed
from . import text as T
from .shared import release, small_batches

CHUNK_BYTES = 2 << 20
_LOW = np.int64(0xFFFFFFFF)

CHUNKS = (
    "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, shas array<string>, kinds binary, links binary, pairs binary"
)
ASKED = "chunk long, pair long, n long"
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def byte_bpe_path() -> str:
    """File of the byte-level tokenizer (A)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe_path() -> str:
    """File of the piece tokenizer (B)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: visible Latin-1 stands for itself, the rest follow 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """One tokenizer: ids of a text, and the bytes and byte length of every id."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.length = np.array([len(p) for p in pieces], np.int64)


@cache
def side_a(path: str) -> Side:
    """Byte-level BPE: its vocabulary run by a rank-based encoder, which gives the same ids faster."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    alphabet = _byte_alphabet()
    special = {t["content"] for t in model.get("added_tokens", ())}
    vocabulary = model["model"]["vocab"]
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    own = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda text: own.encode_ordinary(" " + text), pieces)


@cache
def side_b(path: str) -> Side:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(own.get_piece_size()):
        piece = own.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if own.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(own.encode, pieces)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[k], start[k] + 1, ...`` (``count[k]`` of them) for every k, end to end."""
    end = np.cumsum(count)
    return np.repeat(start - end + count, count) + np.arange(end[-1] if len(end) else 0)


class Alignment:
    """Overlaps and groups of two token streams that cover the same bytes.

    ``succ`` holds, for all A tokens and then all B tokens, the terminal token of the group.
    """

    def __init__(self, length_a: np.ndarray, length_b: np.ndarray):
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
        start_a, start_b = end_a - length_a, end_b - length_b
        n = len(end_a)
        self.first_b = np.searchsorted(end_b, start_a, "right")
        last_b = np.searchsorted(start_b, end_a, "left") - 1
        last_a = np.searchsorted(start_a, end_b, "left") - 1
        self.overlaps = last_b - self.first_b + 1
        # the B token that ends with a group is its terminal and points to itself
        here = np.arange(n, n + len(end_b))
        succ = np.concatenate((n + last_b, np.where(end_a[last_a] > end_b, last_a, here) if n else here))
        while True:
            further = succ[succ]
            if (further == succ).all():
                break
            succ = further
        self.succ = succ
        rank = np.cumsum(succ[n:] == here) - 1
        self.group_a, self.group_b = rank[succ[:n] - n], rank[succ[n:] - n]
        groups = int(rank[-1]) + 1 if len(rank) else 0
        self.count_a = np.bincount(self.group_a, minlength=groups)
        self.count_b = np.bincount(self.group_b, minlength=groups)

    def links(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) of every overlap of the given A tokens."""
        count = self.overlaps[tokens]
        return np.repeat(tokens, count), ragged(self.first_b[tokens], count)


@cache
def _spelled(size: int) -> pa.Array:
    """``i,``, ``i|``, ``i;`` and ``i`` for every id: an id and what follows it in a digest."""
    return pa.array([f"{i}{mark}" for i in range(size) for mark in (",", "|", ";", "")])


def _digests(a, b, found: Alignment, borders_a, borders_b, size: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per document; an empty string without tokens."""
    before_b = np.cumsum(found.count_b) - found.count_b
    upto_a = np.cumsum(found.count_a)
    kind_a = np.zeros(len(a), np.int64)
    kind_a[upto_a - 1] = 1
    kind_b = np.zeros(len(b), np.int64)
    kind_b[np.cumsum(found.count_b) - 1] = 2
    kind_b[borders_b[1:][np.diff(borders_b) > 0] - 1] = 3
    spelled = np.zeros(len(a) + len(b), np.int64)
    spelled[np.arange(len(a)) + before_b[found.group_a]] = a * 4 + kind_a
    spelled[np.arange(len(b)) + upto_a[found.group_b]] = b * 4 + kind_b
    words = _spelled(size).take(pa.array(spelled))
    lists = pa.ListArray.from_arrays(pa.array((borders_a + borders_b).astype(np.int32)), words)
    joined = pc.binary_join(lists, "")
    return [
        hashlib.sha256(joined[i].as_buffer()).hexdigest() if borders_a[i] < borders_a[i + 1] else ""
        for i in range(len(joined))
    ]


def _pack(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(values.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: str, count: int) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), kind)


def _chunk(texts: list[str | None], a: Side, b: Side) -> dict:
    """Everything about a chunk of texts that needs no corpus counts."""
    ids_a, ids_b = [], []
    for text in texts:
        own_a, own_b = (a.encode(text), b.encode(text)) if text else ([], [])
        if own_a or own_b:
            whole = b" " + text.encode()
            same = b"".join(map(a.pieces.__getitem__, own_a)) == whole
            if not same or b"".join(map(b.pieces.__getitem__, own_b)) != whole:
                own_a, own_b = [], []
        ids_a.append(np.array(own_a, np.int64))
        ids_b.append(np.array(own_b, np.int64))
    borders_a = np.cumsum([0, *map(len, ids_a)])
    borders_b = np.cumsum([0, *map(len, ids_b)])
    ids_a, ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
    found = Alignment(a.length[ids_a], b.length[ids_b])
    first_a = np.cumsum(found.count_a) - found.count_a
    first_b = np.cumsum(found.count_b) - found.count_b

    # a group is its A ids and its B ids: equal hashes of both stand for equal groups
    def stretch(ids, first, count):
        return T.mix(T.Rolling(T.mix(ids.astype(np.uint64) + np.uint64(1))).of(first, first + count) + count.astype(np.uint64))

    name = T.mix(stretch(ids_a, first_a, found.count_a)) ^ stretch(ids_b, first_b, found.count_b)
    _, at, kind = np.unique(name, return_index=True, return_inverse=True)
    tokens = ragged(first_a[at], found.count_a[at])
    left, right = found.links(tokens)
    linked = np.concatenate(([0], np.cumsum(found.overlaps)))
    per_kind = linked[first_a[at] + found.count_a[at]] - linked[first_a[at]]
    grouped = np.searchsorted(first_a, borders_a)
    return {
        "n_a": np.diff(borders_a),
        "n_b": np.diff(borders_b),
        "n_groups": np.diff(grouped),
        "n_links": np.diff(linked[borders_a]),
        "shas": _digests(ids_a, ids_b, found, borders_a, borders_b, max(len(a.pieces), len(b.pieces))),
        "kinds": _pack(kind, "<u4"),
        "links": _pack(per_kind, "<u4"),
        "pairs": _pack(ids_a[left] << 32 | ids_b[right], "<i8"),
    }


def _chunks(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int) -> DataFrame:
    """One row per chunk of whole texts; a longer text is a chunk of its own."""

    def run(batches: Iterator[pa.RecordBatch]):
        a, b = side_a(path_a), side_b(path_b)
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for group in T.groups(batch.column("text"), chunk_bytes):
                part = batch.slice(group.lo, group.hi - group.lo)
                made = _chunk(part.column("text").to_pylist(), a, b)
                row = {"chunk": pa.array([name], pa.int64()), "doc_ids": [part.column("doc_id").to_pylist()]}
                row |= {k: [v if isinstance(v, bytes) else list(v)] for k, v in made.items()}
                name += 1
                yield pa.RecordBatch.from_pydict(row, schema=_CHUNK_SCHEMA)
                release()

    return small_batches(docs).mapInArrow(run, CHUNKS)


_CHUNK_SCHEMA = pa.schema(
    [
        ("chunk", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        *[(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")],
        ("shas", pa.list_(pa.string())),
        *[(c, pa.binary()) for c in ("kinds", "links", "pairs")],
    ]
)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups per document, kind of each group, links per kind, pair of each of those links."""
    groups = np.array(row["n_groups"], np.int64)
    kinds = _unpack(row["kinds"], "<u4", int(groups.sum()))
    links = _unpack(row["links"], "<u4", int(kinds.max()) + 1 if len(kinds) else 0).astype(np.int64)
    return groups, kinds, links, _unpack(row["pairs"], "<i8", int(links.sum()))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        release()


def _asked(chunks: DataFrame) -> DataFrame:
    """Different id pairs of every chunk and how many of its links hold them."""

    def run(batches):
        for row in _rows(batches):
            _, kinds, links, pairs = _read(row)
            times = np.repeat(np.bincount(kinds, minlength=len(links)), links)
            order = np.argsort(pairs, kind="stable")
            pairs, times = pairs[order], times[order]
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            if len(first):
                made = {
                    "chunk": np.full(len(first), row["chunk"], np.int64),
                    "pair": pairs[first],
                    "n": np.add.reduceat(times, first),
                }
                yield from pa.table(made).to_batches(max_chunksize=50_000)

    return chunks.select("chunk", "n_groups", "kinds", "links", "pairs").mapInArrow(run, ASKED)


def _summed(chunks: DataFrame) -> DataFrame:
    """Documents of chunks that carry the counts of their pairs."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                told = one.column("told")
                told = told.values.slice(told.offsets[0].as_py(), told.offsets[1].as_py() - told.offsets[0].as_py())
                pair, count, best = (told.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                row = one.drop_columns(["told"]).to_pylist()[0]
                groups, kinds, links, pairs = _read(row)
                order = np.argsort(pair)
                at = order[np.searchsorted(pair, pairs, sorter=order)] if len(pairs) else pairs
                border = np.concatenate(([0], np.cumsum(links)))
                of_doc = np.concatenate(([0], np.cumsum(groups)))
                out = {"doc_id": row["doc_ids"], **{k: row[k] for k in ("n_a", "n_b", "n_groups", "n_links")}}
                for name, value in (("n_best", best), ("count_sum", count)):
                    total = np.concatenate(([0], np.cumsum(value[at].astype(np.int64))))
                    per_kind = total[border[1:]] - total[border[:-1]]
                    total = np.concatenate(([0], np.cumsum(per_kind[kinds])))
                    out[name] = total[of_doc[1:]] - total[of_doc[:-1]]
                out["groups_sha256"] = row["shas"]
                yield pa.table({k: pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in out.items()}).to_batches()[0]

    return chunks.mapInArrow(run, ALIGNED)


def aligned(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text (and adds the space); special tokens' strings are plain
    text. Groups are the stretches between byte offsets where tokens of both end; links are the pairs of
    an A and a B token whose byte ranges overlap. ``n_best`` counts the links whose id pair occurs
    as often in the corpus as any pair of its B id (ties included), ``count_sum`` adds up the
    occurrences of the links' pairs. ``groups_sha256`` is the hash of ``a1,a2|b1;a3|b2``.

    Null and empty texts, and texts that one of the tokenizers does not reproduce byte by byte, have no
    tokens: zeros and an empty string. Repeated rows count each by itself; a null ``doc_id`` is kept. An
    empty table gives no rows. Other columns of ``docs`` are ignored. Texts of any length are encoded whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = checkpointed(_chunks(rows, path_a or byte_bpe_path(), path_b or piece_bpe_path(), chunk_bytes))
    asked = checkpointed(_asked(chunks))
    counts = checkpointed(asked.groupBy("pair").agg(F.sum("n").alias("count")))
    partner = F.col("pair").bitwiseAND(F.lit(int(_LOW))).alias("b")
    most = counts.groupBy(partner).agg(F.max("count").alias("most"))
    counts = counts.select("pair", "count", partner).join(most, "b")
    counts = counts.select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    told = (
        asked.select("chunk", "pair")
        .join(counts, "pair")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("pair", "count", "best")).alias("told"))
    )
    nothing = F.expr("cast(array() as array<struct<pair: bigint, count: bigint, best: int>>)")
    return _summed(
        chunks.join(told, "chunk", "left").select(
            *chunks.columns, F.coalesce("told", nothing).alias("told")
        )
    )
