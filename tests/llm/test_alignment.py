"""Cross-tokenizer alignment against plain loops over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortloom.llm import alignment

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A = Tokenizer.from_file(alignment.byte_bpe_path())
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_bpe_path())
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
DECODED = {chr(b): b for b in VISIBLE}
DECODED |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


def tokens_a(text):
    ids = A.encode(" " + text, add_special_tokens=False).ids
    return [(i, bytes(DECODED[c] for c in A.id_to_token(i))) for i in ids]


def tokens_b(text):
    out = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        out.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    return out


def places(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of every text."""
    docs, counts = [], Counter()
    for text in texts:
        a, b = (tokens_a(text), tokens_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        a, b = places(a), places(b)
        links = [(x, y) for x, lo, hi in a for y, low, high in b if lo < high and low < hi] if len(a) < 400 else None
        if links is None:
            links, j = [], 0
            for x, lo, hi in a:
                while b[j][2] <= lo:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < hi:
                    links.append((x, b[k][0]))
                    k += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ";".join(
            ",".join(str(i) for i, s, e in a if lo < e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo < e <= hi)
            for lo, hi in zip([0, *ends], ends, strict=False)
        ) if len(a) < 3000 else None
        docs.append((len(a), len(b), len(ends), links, groups))
        counts.update(links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for n_a, n_b, n_groups, links, groups in docs:
        sha = None if groups is None else hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


def compare(spark, rows, schema=SCHEMA, **options):
    got = Counter(tuple(r) for r in alignment.aligned(spark.createDataFrame(rows, schema), **options).collect())
    want = [(r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows]), strict=True)]
    loose = Counter(w[:-1] for w in want)
    assert Counter(g[:-1] for g in got.elements()) == loose
    exact = Counter(w for w in want if w[-1] is not None)
    assert not exact - got
    return got


ODD = [
    "▁ is a piece's space", "<s> <|endoftext|> <0x41> <unk>", "漢字かな交じり文 🙂🙂‍🙂", "tab\there\n\n  two  spaces ",
    "\x00\x01\x7f", "é é ﬁ ½ 　​", " ", "a", "x" * 5000, "don't DON'T 12345 3.14", "̈́ Å Å", "नमस्ते दुनिया",
]


@pytest.mark.parametrize("chunk_bytes", [1, 4000, alignment.CHUNK_BYTES])
def test_awkward(spark, chunk_bytes):
    rows = brute.awkward_documents()
    rows += [(500 + i, t, None, None, None) for i, t in enumerate(ODD)]
    got = compare(spark, rows, chunk_bytes=chunk_bytes)
    zero = [g for g in got if g[0] in (0, 1, 500)]
    assert len(zero) == 3 and all(g[1:] == (0, 0, 0, 0, 0, 0, "") for g in zero)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(spark, [tuple(r) for r in df.collect()], df.schema)


def test_same_ids_as_the_tokenizer():
    """The rank-based encoder has the ids of the tokenizer file."""
    rng = np.random.default_rng(8)
    alphabet = [*"abcXYZ019_'-.,!<|>\"#&éñ́İſ漢🙂\x85\xa0\x1f\t\n  ", "<|endoftext|>", "'s", "'LL", " the"]
    side = alignment.side_a(alignment.byte_bpe_path())
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(2000)] + ["ab" * 30_000, " " * 3000]
    for text in texts:
        assert side.encode(text) == A.encode(" " + text, add_special_tokens=False).ids, text[:80]


def test_pointers_lead_to_common_cuts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        streams = []
        for _ in range(2):
            cuts = np.unique(np.append(rng.integers(1, total + 1, rng.integers(1, total + 1)), total))
            streams.append(np.diff(cuts, prepend=0))
        a, b = streams
        found = alignment.Alignment(a, b)
        common = sorted(set(np.cumsum(a)) & set(np.cumsum(b)))
        assert found.group_a.tolist() == np.searchsorted(common, np.cumsum(a)).tolist()
        assert found.group_b.tolist() == np.searchsorted(common, np.cumsum(b)).tolist()


def test_empty_and_clashing(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "some words", 5, "x"), (1, "some words", 5, "x"), (None, None, None, None)]
    compare(spark, rows, "doc_id long, text string, chunk long, pairs string")
