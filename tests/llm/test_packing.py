"""Packing: the pieces are the texts' own ids, and the sequences hold them without gaps."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
from tokenizers import Tokenizer

from cohortloom.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


TOKENIZER = Tokenizer.from_file(packing.tokenizer_path())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_have_the_tokenizers_ids():
    table = packing.TokenBytes(packing.tokenizer_path())
    rng = np.random.default_rng(6)
    alphabet = list("abcXYZ019_'-.,!<|>\"#&ÀÖ×Øß÷ÿµªº éñ\u0301İſ\u00adΣ漢\x85\xa0\x1f\t\n") + ["<|endoftext|>", "'s", "'LL", "'Re", "''", "'D"]
    for _ in range(6000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 14)))
        assert table.of(text) == np.array(ids_of(text)[:-1], "<u4").tobytes(), repr(text)


def test_tables_stay_bounded_and_right(monkeypatch):
    monkeypatch.setattr(packing, "MOST_PARTS", 7)
    monkeypatch.setattr(packing, "MOST_WORDS", 3)
    table = packing.TokenBytes(packing.tokenizer_path())
    rng = np.random.default_rng(2)
    for _ in range(300):
        text = " ".join(rng.choice(["alpha", "Beta", "漢字", "x1", "don't", "we'll", "--", "é", "a’b"], 9))
        assert table.of(text) == np.array(ids_of(text)[:-1], "<u4").tobytes(), repr(text)
        assert len(table.parts) <= 8 and len(table.words) <= 4 and len(table.parts.older) <= 8


def check(rows, got, length):
    want = Counter()
    for r in rows:
        ids = np.array(ids_of(r[1]), "<u4")
        for k in range(0, len(ids), length):
            part = ids[k : k + length]
            want[r[0], k // length, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences), -(-sum(r.length for r in got) // length)


def test_awkward(spark):
    rows = brute.awkward_documents()
    odd = "Ünïcode\x85 nbsp\xa0x \u2028 'quoted' it's 1234 ₂ <|endoftext|> ǅ Σας ΣΑΣ e\u0301 \u0301 \x1c\x1d 汉字 🙂🙂 don'T_we"
    rows += [(900, odd, None, None, None), (901, odd.replace(" ", "\n\n"), None, None, None)]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA), length=256).collect()
    used, least = check(rows, got, 256)
    assert used <= least * 1.05 + 1


def test_whole_table_is_nearly_tight(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, least = check([tuple(r) for r in df.collect()], packing.packed(df).collect(), 2048)
    assert used <= least * 1.03 + 1
    many = packing.packed(df, group=100).collect()
    check([tuple(r) for r in df.collect()], many, 2048)


def test_sum_of_squares_rule():
    """Against the rule spelled out: the squared counts of open bins per gap, after each choice."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 21, 200)
    place, offset = packing.sum_of_squares(lengths, 20)
    gaps = {}
    for size, b, at in zip(lengths.tolist(), place.tolist(), offset.tolist(), strict=True):
        open_ = Counter(g for g in gaps.values() if g)
        def after(gap, size=size, open_=open_):
            n = open_.copy()
            if gap < 20:
                n[gap] -= 1
            if gap > size:
                n[gap - size] += 1
            return sum(v * v for v in n.values())
        options = {g: after(g) for g in {*open_, 20} if g >= size}
        gap = gaps.get(b, 20)
        assert 20 - gap == at
        assert options[gap] == min(options.values())
        gaps[b] = gap - size


def test_empty_and_clashing(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, 1, 2), (None, None, 1, 2), (3, "x", 1, 2)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, row int, group int")).collect()
    assert sorted(r.length for r in got) == [1, 1, 2] and len({r.sequence_id for r in got}) == 1
