"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are configuration, at most ``MOST_TEMPLATE_WORDS`` words in all, so their inverted index
(fingerprint -> template and place) goes to every task. All word 3-grams of a text are looked up in
it: text is never winnowed, so a copied stretch of ``GRAM + WINDOW - 1`` template words always meets a
fingerprint. Templates of up to ``SHORT`` words keep all their grams. Hits with nearly the same start
are one candidate place, aligned within a band around it, of which alone a table is kept; so whole licenses of
thousands of words can be templates (``license_texts.from_folder``). Where spans of several templates overlap, the
one with the most matched words is reported.
"""

from __future__ import annotations

from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .license_texts import TEMPLATES
from .repeats import sliding_minimum
from .shared import arrow_map, keyed

GRAM = 3
WINDOW = 4
SHORT = 32
BAND = 16
LONG = 100  # the band grows to one word in so many of a long template
# share of a template's fingerprints that a candidate place holds at least; a fifth of the words changed
# leaves about a sixth of them
NEEDED = 0.02
LEAST_COVERAGE = 0.8
MOST_TEMPLATE_WORDS = 1 << 20

RESULT = (
    "doc_id long, text_key long, license string, n_template_words int, n_matched int, coverage double, "
    "first_word int, last_word int, start long, end long"
)


class Index(NamedTuple):
    """Templates as word hashes, and their winnowed fingerprints in sorted order."""

    names: list[str]
    words: list[np.ndarray]
    hash: np.ndarray
    template: np.ndarray
    place: np.ndarray
    held: np.ndarray


def _words(group: T.Group) -> T.Words:
    return T.words(group, fold=True, between=T.IS_MARK)


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram hash of every ``window`` consecutive ones (rightmost on ties)."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, int)
    least = sliding_minimum(grams, window)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(least)) + window - 1 - np.argmax((views == least[:, None])[:, ::-1], axis=1))


def gram_of(n_words: int, gram: int) -> int:
    """Words per gram; one changed word may leave no three in a row of a template of five."""
    return max(1, min(gram, n_words if n_words > 5 else 2, n_words))


def build_index(templates: dict[str, str], gram: int = GRAM, window: int = WINDOW) -> Index:
    names = sorted(templates)
    (group,) = T.groups(pa.array([templates[n] for n in names]), limit=1 << 62)
    found = _words(group)
    if len(found.hash) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} words need an index of their own")
    own = [found.hash[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    hashes, template, place = [], [], []
    for i, w in enumerate(own):
        grams = T.Rolling(w).windows(gram_of(len(w), gram))
        at = winnowed(grams, window) if len(w) > SHORT else np.arange(len(grams))
        hashes.append(grams[at])
        template.append(np.full(len(at), i))
        place.append(at)
    hashes = np.concatenate(hashes)
    order = np.argsort(hashes, kind="stable")
    template, place = np.concatenate(template), np.concatenate(place)
    held = np.bincount(template, minlength=len(names))
    return Index(names, own, hashes[order], template[order], place[order], held)


def aligned(template: np.ndarray, words: np.ndarray, first: int, last: int, band: int):
    """Longest common subsequence of the template and ``words`` with starts in ``first - band ..
    last + band``: (matched words, place of the first and of the last matched word), or None.

    Only the band is computed and kept: template words times the width of the band.
    """
    m, width = len(template), last - first + 2 * band + 2
    # cell (i, d): the first i template words against the words before i + shift + d
    shift = first - band
    table = np.zeros((m + 1, width), np.int32)
    padded = np.concatenate((np.zeros(1, words.dtype), words, np.zeros(1, words.dtype)))
    for i in range(m):
        # cell (i + 1, d) ends with the word before i + 1 + shift + d; a match continues cell (i, d)
        at = np.arange(i + shift, i + shift + width)
        there = (at >= 0) & (at < len(words))
        match = there & (padded[np.clip(at, -1, len(words)) + 1] == template[i])
        match[-1] = False  # the last column only closes the band
        row = np.where(match, table[i] + 1, 0)
        # the template word left out: the same words are one column further to the right a row before
        row[:-1] = np.maximum(row[:-1], table[i, 1:])
        # the last word left out: one column to the left
        np.maximum.accumulate(row, out=table[i + 1])
    best = int(table[m].max())
    if not best:
        return None
    i, d = m, int(np.argmax(table[m] == best))
    start = end = None
    while i and table[i, d]:
        if d and table[i, d] == table[i, d - 1]:
            d -= 1
        elif d + 1 < width and table[i, d] == table[i - 1, d + 1]:
            i, d = i - 1, d + 1
        else:
            i -= 1
            start = i + shift + d
            end = start if end is None else end
    return best, start, end


def _places(starts: np.ndarray, band: int):
    """Ranges of sorted candidate starts; a range is at most ``4 * band`` wide."""
    lo = 0
    for k in range(1, len(starts) + 1):
        if k == len(starts) or starts[k] - starts[k - 1] > band or starts[k] - starts[lo] > 4 * band:
            yield int(starts[lo]), int(starts[k - 1])
            lo = k


def text_matches(index: Index, words: np.ndarray, hits: list[tuple[int, np.ndarray]], least: float):
    """(template, matched, first word, last word) of one text; per template spans do not overlap."""
    for template, starts in hits:
        own = index.words[template]
        band = max(1, min(max(BAND, len(own) // LONG), len(own) // 2))
        found = []
        starts = np.sort(starts)
        for first, last in _places(np.unique(starts), band):
            # a long template's places hold many fingerprints or fall short of any coverage
            held = np.searchsorted(starts, last, "right") - np.searchsorted(starts, first, "left")
            if held < NEEDED * index.held[template]:
                continue
            best = aligned(own, words, first, last, band)
            if best is not None and best[0] >= least * len(own) - 1e-9:
                found.append(best)
        taken: list[tuple[int, int]] = []
        for matched, a, b in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
            if all(b < x or a > y for x, y in taken):
                taken.append((a, b))
                yield template, matched, a, b


def best_covering(found: list[tuple[int, int, int, int]], index: Index, n_words: int):
    """Matches of one text less those that have half of their span inside better ones of other templates.

    More matched words are better, then a larger share of the template; matches equal in both all stay.
    """
    rank = lambda f: (-f[1], len(index.words[f[0]]))
    taken = np.zeros(n_words, bool)
    for _, same in groupby(sorted(found, key=rank), rank):
        stay = [f for f in same if 2 * taken[f[2] : f[3] + 1].sum() < f[3] + 1 - f[2]]
        for _, _, a, b in stay:
            taken[a : b + 1] = True
        yield from stay


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    gram: int = GRAM,
    window: int = WINDOW,
    least_coverage: float = LEAST_COVERAGE,
) -> DataFrame:
    """One row per place of a document where a template is found.

    Words are runs of ASCII letters and digits, case folded, and other characters beyond ASCII.
    ``coverage`` is the share of the template's words matched in order; places below
    ``least_coverage`` are left out, and so are places with half of their span inside those of templates with
    more matched words. ``first_word`` and ``last_word`` count these words, ``start`` and
    ``end`` are UTF-8 byte positions in the text. Null and empty texts match nothing; repeated rows
    match once each; other columns of ``docs`` are ignored.
    """
    index = build_index(templates if templates is not None else TEMPLATES, gram, window)
    unique, at = np.unique(index.hash, return_index=True)
    times = np.diff(np.concatenate((at, [len(index.hash)])))
    lengths = {gram_of(len(w), gram) for w in index.words if len(w)}

    def of_batch(batch):
        out = {c.split()[0]: [] for c in RESULT.split(", ")[2:]}
        rows = []
        for group in T.groups(batch.column("text")):
            found = _words(group)
            text, template, start = [], [], []
            for k in sorted(lengths):
                grams = T.Rolling(found.hash).windows(k)
                begin = T.spans_inside(found.first, k)
                if not len(begin) or not len(unique):
                    continue
                place = np.minimum(np.searchsorted(unique, grams[begin]), len(unique) - 1)
                hit = np.flatnonzero(unique[place] == grams[begin])
                place, begin = place[hit], begin[hit]
                which = np.repeat(np.arange(len(hit)), times[place])
                first = np.cumsum(times[place]) - times[place]
                entry = at[place[which]] + np.arange(len(which)) - first[which]
                owner = np.searchsorted(found.first, begin[which], "right") - 1
                text.append(owner)
                template.append(index.template[entry])
                start.append(begin[which] - found.first[owner] - index.place[entry])
            if not text:
                continue
            text, template, start = (np.concatenate(x) for x in (text, template, start))
            order = np.lexsort((start, template, text))
            text, template, start = text[order], template[order], start[order]
            cut = np.flatnonzero(np.diff(text) != 0) + 1
            cut = np.concatenate(([0], cut, [len(text)]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                t = int(text[lo])
                base = int(found.first[t])
                words = found.hash[base : found.first[t + 1]]
                part = np.flatnonzero(np.diff(template[lo:hi]) != 0) + lo + 1
                hits = [
                    (int(template[x]), start[x:y])
                    for x, y in zip([lo, *part.tolist()], [*part.tolist(), hi], strict=True)
                ]
                matches = list(text_matches(index, words, hits, least_coverage))
                for name, matched, a, b in best_covering(matches, index, len(words)):
                    total = len(index.words[name])
                    rows.append(group.lo + t)
                    begin_byte = int(found.start[base + a] - group.offsets[t])
                    end_byte = int(found.end[base + b] - group.offsets[t])
                    for c, x in zip(
                        out, (index.names[name], total, matched, matched / total, a, b, begin_byte, end_byte), strict=True
                    ):
                        out[c].append(x)
        take = pa.array(rows, pa.int64())
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.table(
            {
                "doc_id": batch.column("doc_id").take(take),
                "text_key": batch.column("text_key").take(take),
                **{c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)},
            }
        )

    return arrow_map(keyed(docs), of_batch, RESULT)
