"""Plain Python versions of the operators, and texts that are awkward on purpose."""

import hashlib
import random
from collections import Counter

SPACES = " \t\n\x0b\x0c\r"


def awkward_documents():
    """(doc_id, text, lang, source, n_chars): nulls, empties, copies, periodic and long texts."""
    rng = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta,", "Eta.", "theta", "iota", "kappa"]
    long_ = " ".join(rng.choice(names) + str(rng.randrange(400)) for _ in range(900))
    shared = " ".join(rng.choice(names) + str(rng.randrange(900)) for _ in range(90))
    texts = [None, "", "  \n\t ", "one", "a b c d", long_, long_, long_[:3000] + " extra " + long_[2500:]]
    for i in range(40):
        words = [rng.choice(names) + str(rng.randrange(1000)) for _ in range(rng.randrange(3, 160))]
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = shared.split()[: rng.randrange(20, 90)]
        sep = rng.choice([" ", " ", "\n", "  ", "\x1c ", "  "])
        texts.append(sep.join(words))
    texts += ["x" * 3000, "ab" * 700 + "c", "line of text\n" * 120, "é" * 900, texts[20], texts[20]]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[12], None, None, None), (None, "lonely words here", "en", None, 3)]
    rows += [(10, "same id, other text " * 30, "en", "src0", 1)]
    return rows


def split(text):
    return (text or "").encode().split()


def covered(sequences, width, keep_first=False):
    """Per sequence the set of covered places, by listing every window."""
    seen = {}
    for i, s in enumerate(sequences):
        for j in range(len(s) - width + 1):
            seen.setdefault(tuple(s[j : j + width]) if isinstance(s, list) else s[j : j + width], []).append((i, j))
    out = [set() for _ in sequences]
    for places in seen.values():
        for i, j in places[1:] if keep_first else places if len(places) > 1 else []:
            out[i].update(range(j, j + width))
    return out


def substring(rows, width):
    seqs = [split(r[1]) for r in rows]
    out = []
    for r, s, c in zip(rows, seqs, covered(seqs, width), strict=True):
        kept = b" ".join(w for i, w in enumerate(s) if i not in c)
        out.append((r[0], len(s), len(c), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def suffix(rows, width):
    seqs = [(r[1] or "").encode() for r in rows]
    out = []
    for r, s, c in zip(rows, seqs, covered(seqs, width), strict=True):
        kept = bytes(b for i, b in enumerate(s) if i not in c)
        spans = sum(1 for i in c if i - 1 not in c)
        out.append((r[0], len(s), len(c), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def shingle_set(text, width=5):
    w = split(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))
