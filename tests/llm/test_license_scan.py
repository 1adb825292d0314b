"""License scans against a plain longest common subsequence."""

import os
import re

import brute
import numpy as np
import pyarrow as pa
import pytest

from cohortloom.llm import license_scan, license_texts
from cohortloom.llm import text as T
from cohortloom.llm.license_texts import TEMPLATES

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode().lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def found(df, **options):
    return license_scan.scan(df, **options).collect()


def test_whole_templates_and_edits(spark):
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join(f"word{rng.integers(5000)}" for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        rows.append((i, f"{filler(30)}\n{text.upper()}\n{filler(400)}"))
        want.add((i, name))
        edited = text.split()
        for at in range(7, len(edited), 15):
            edited[at] = "something else"
        rows.append((100 + i, f"{filler(10)} {' // '.join(edited)} {filler(10)}"))
        if len(edited) > 20:
            want.add((100 + i, name))
    rows += [(500, None), (501, ""), (502, filler(1000)), (503, "MIT License"), (None, rows[0][1])]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert want <= {(r.doc_id, r.license) for r in got}
    texts = dict(rows)
    for r in got:
        whole = words(TEMPLATES[r.license])
        assert r.n_template_words == len(whole) and abs(r.coverage - r.n_matched / len(whole)) < 1e-9
        part = texts[r.doc_id].encode()[r.start : r.end]
        assert words(part.decode()) == words(texts[r.doc_id])[r.first_word : r.last_word + 1]
        assert lcs(whole, words(part.decode())) == r.n_matched
    assert not {r.doc_id for r in got} & {500, 501, 502, 503}
    assert None in {r.doc_id for r in got}


def test_every_repetition_is_reported(spark):
    line = TEMPLATES["mit-notice"]
    got = found(spark.createDataFrame([(1, "\n".join([line] * 7)), (1, "\n".join([line] * 7))], SCHEMA))
    assert sorted(r.first_word for r in got if r.license == "mit-notice") == sorted([5 * k for k in range(7)] * 2)


def test_documents_with_license_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in found(docs)}
    lines = {n: t for n, t in TEMPLATES.items() if "\n" not in t}
    want = {
        (r.doc_id, n) for r in docs.collect() for n, t in lines.items() if t in (r.text or "")
    }
    assert want and want <= got


def test_winnowing_keeps_every_window():
    grams = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    at = set(license_scan.winnowed(grams, 4).tolist())
    assert all(at & set(range(i, i + 4)) for i in range(297))


def test_versions_and_changed_words(spark):
    rows = {
        1: "This work is licensed under the GNU General Public License, version 2.",
        2: "Licensed under CC BY 4.0",
        3: "Licensed under CC BY-NC 3.0",
        4: "Released under a MIT License.",
        5: TEMPLATES["apache-2.0-header"],
        6: "Licensed under the Mozilla Public License, Version 2.0.",
    }
    got = {(r.doc_id, r.license) for r in found(spark.createDataFrame(list(rows.items()), SCHEMA))}
    assert got == {
        (1, "gpl-2.0-notice"), (2, "cc-by-4.0-short"), (3, "cc-by-nc-3.0-notice"), (4, "mit-notice"),
        (5, "apache-2.0-header"), (6, "mpl-2.0-notice"),
    }


def test_banded_alignment_against_the_whole_table():
    """Within the band the alignment is the longest common subsequence, and its span holds it."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        m = int(rng.integers(2, 30))
        template = rng.integers(1, 9, m).astype(np.uint64)
        copy = [int(x) for x in template if rng.random() > 0.15]
        for _ in range(int(rng.integers(0, 3))):
            copy.insert(int(rng.integers(0, len(copy) + 1)), 77)
        ahead, after = rng.integers(20, 30, rng.integers(0, 12)), rng.integers(20, 30, rng.integers(0, 12))
        words = np.concatenate((ahead, copy, after)).astype(np.uint64)
        got = license_scan.aligned(template, words, len(ahead), len(ahead), m)
        want = lcs(template.tolist(), words.tolist())
        assert (got[0] if got else 0) == want
        if got:
            assert lcs(template.tolist(), words[got[1] : got[2] + 1].tolist()) == want
            assert words[got[1]] in template and words[got[2]] in template


LICENSES = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(LICENSES), reason="no license texts on this machine")
def test_whole_licenses(spark):
    full = license_texts.from_folder(LICENSES)
    templates = {n: full[n] for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-3", "MPL-2.0")}
    filler = " ".join(f"w{i}" for i in range(4000))
    edited = full["GPL-3"].split()
    for at in range(11, len(edited), 60):
        edited[at] = "changed"
    del edited[2000:2012]
    rows = {1: full["Apache-2.0"], 2: f"{filler} {full['GPL-3']} {filler}", 3: " ".join(edited), 4: filler,
            5: full["GPL-2"].upper(), 6: full["LGPL-3"] + filler + full["MPL-2.0"]}
    got = found(spark.createDataFrame(list(rows.items()), SCHEMA), templates={**TEMPLATES, **templates})
    best = {(r.doc_id, r.license): r.coverage for r in got if r.license in templates}
    assert set(best) == {(1, "Apache-2.0"), (2, "GPL-3"), (3, "GPL-3"), (5, "GPL-2"), (6, "LGPL-3"), (6, "MPL-2.0")}
    assert min(best.values()) >= 0.95


def test_empty_and_clashing(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, TEMPLATES["mit-notice"], 3, "x")]
    assert len(found(spark.createDataFrame(rows, SCHEMA + ", start int, license string"))) == 1
    assert found(spark.createDataFrame([(1, "a b")], SCHEMA), templates={"none": ""}) == []
    assert brute.split(None) == [] and len(T.words(next(T.groups(pa.array(["a-b"]))), between=T.IS_MARK).hash) == 2
