"""Quality rules against a plain version."""

import re
from collections import Counter, defaultdict

import brute

from cohortloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, least, share, left=0.5, most=10_000):
    def norm(line):
        return " ".join(WORD.findall(line)).translate({i: i + 32 for i in range(65, 91)})

    texts = defaultdict(set)
    for r in rows:
        texts[r[3]].add(r[1])
    above = {}
    for host, own in texts.items():
        held = Counter(x for t in own for x in {norm(line) for line in (t or "").split("\n")} - {""})
        above[host] = {x for x, n in held.items() if n > least and (n > share * len(own) or n > most)}
    out = []
    for doc, text, _, host, _ in rows:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {x for x, n in Counter(triples).items() if n > 1}
        covered = {i + k for i, x in enumerate(triples) if x in often for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        gone = sum(len(WORD.findall(x)) for x in lines if norm(x) in above[host])
        out.append(
            (
                doc,
                len(words),
                sum(map(len, words)),
                sum(c in "#*$%&|<>" for c in text or ""),
                len(lines) - len(set(lines)),
                len(covered),
                failed,
                not failed and len(words) - gone >= left * len(words),
            )
        )
    return Counter(out)


def spark_rows(df, **options):
    out = quality.judged(df, **options).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    return Counter(tuple(r) for r in out.collect())


def fixture():
    rows = brute.awkward_documents()
    for i in range(60):
        own = " ".join(f"own{i}w{j}" for j in range(12))
        often = " ".join(f"menu{j}" for j in range(40))
        rows.append((500 + i, f"{own}\n MENU0 {often[6:]}\n# <b> | {own}z", "en", "src0", None))
        rows.append((700 + i, f"{' '.join(f'q{i}w{j}' for j in range(60))}\nmenu0 {often[6:]}\r\n\n", "en", None, 7))
    return rows


def test_awkward(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, 20, 0.1)
    assert spark_rows(df, least_documents=20) == want
    assert sum(not r[-1] and not r[-2] for r in want) >= 50


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    assert spark_rows(df) == plain(rows, 5, 0.1)


def test_hosts_of_any_size(spark):
    """One rule for a host of 20 and one of 20,000 documents: share above chance, or very many documents."""
    def page(i, line):
        return f"{' '.join(f'd{i}w{j}' for j in range(52))}\n{line} " + "menu " * 90

    rows = [(i, page(i, "in six" if i < 6 else f"x{i}"), "en", "small", 0) for i in range(20)]
    rows += [(i + 50, page(i + 50, "in five" if i < 5 else f"x{i}"), "en", "other", 0) for i in range(20)]
    share = {i: "tenth" if i < 2_001 else "many" if i < 3_600 else "less" if i < 5_100 else f"x{i}" for i in range(20_000)}
    rows += [(i + 100, page(i + 100, share[i]), "en", "large", 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    options = {"least_documents": 5, "most_documents": 1_500}
    got = quality.judged(df, **options).where("n_removed_words > 0").select("doc_id", "kept").collect()
    want = {*range(6), *(i + 100 for i in range(3_600))}
    assert {r.doc_id for r in got} == want and not any(r.kept for r in got)


def test_clean_removes_lines(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    out = quality.clean(df, least_documents=20)
    assert out.schema.names == df.schema.names
    got = out.collect()
    assert not any("menu1 " in (r.text or "") for r in got)
    kept = [r for r in got if r.doc_id is not None and r.doc_id >= 700]
    assert len(kept) == 60 and all(r.n_chars == len(r.text) and r.text.endswith("w59\n\n") for r in kept)
    want = +Counter({k[0]: n for k, n in plain(rows, 20, 0.1).items() if k[-1]})
    assert {r.doc_id for r in got} == set(want)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA + ", line string, removed int, host int")
    assert spark_rows(empty) == Counter() and quality.clean(empty).count() == 0
