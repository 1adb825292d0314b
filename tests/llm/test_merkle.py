"""Merkle manifest against trees built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    fields = (row[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 16 * 16
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 16])))
        i //= 16
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = own, climb([leaf(r) for r in own])
    top = climb([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, levels = trees[s]
        for i, row in enumerate(own):
            steps = path(levels, i) + path(top, k)
            now = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"]:
                now["text"] = row["text"].translate(str.maketrans(UPPER, UPPER.lower()))
            node = leaf(now)
            for before, after in steps:
                node = digest(before, node, after)
            proof = digest(*(a + b for a, b in steps))
            out.append((row["doc_id"], levels[0][i], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(tampered, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    return merkle.manifest(df, changes={"text": text})


def made(n, sources, seed=3):
    rng = random.Random(seed)
    texts = [None, "", "Abc é", "X" * 50, "Plain text"]
    return [
        (
            rng.randrange(2 * n) if rng.random() < 0.95 else None,
            rng.choice(texts) if rng.random() < 0.5 else f"Q{rng.random()}",
            rng.choice(["en", None]),
            sources[min(int(rng.expovariate(2) * len(sources)), len(sources) - 1)],
            rng.choice([None, 3]),
        )
        for _ in range(n)
    ]


CASES = {
    "one row": made(1, ["a"]),
    "a run and one more": [(i, "Text", "en", "a", 1) for i in range(17)],
    "a block and one more": [(i, "Text", "en", "a", 1) for i in range(257)],
    "hot source, repeated rows": made(4200, ["a"]) + made(300, [None, "", "b", "é", "z"]) * 2,
    "more sources than a block": made(900, [None, *(f"s{i}" for i in range(600))]),
}


@pytest.mark.parametrize("case", CASES)
def test_against_node_by_node(spark, case):
    rows = CASES[case]
    got = sorted((tuple(r) for r in found(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute([dict(zip(NAMES, r, strict=True)) for r in rows])


def test_every_change_is_seen(spark):
    df = spark.createDataFrame(made(200, ["a", "b"]), SCHEMA)
    assert merkle.manifest(df).where("not verified").count() == 0
    for column, value in {"lang": F.lit("xx"), "n_chars": F.lit(9), "source": F.lit("c")}.items():
        assert merkle.manifest(df, changes={column: value}).where("verified").count() == 0


def test_order_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(made(700, ["a", "b", None]), SCHEMA)
    roots = {r.root for n in (1, 7, 40) for r in merkle.manifest(df.repartition(n)).select("root").distinct().collect()}
    assert len(roots) == 1


def test_empty_and_clashing(spark):
    assert found(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "T", "en", "a", 1, "x", 2, "y"), (2, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", grp string, node long, leaf string")
    got = sorted((tuple(r) for r in found(df).collect()), key=str)
    assert got == brute([dict(zip(NAMES, r[:5], strict=True)) for r in rows])


def test_no_python_and_no_proofs_in_shuffles(spark):
    plan = found(spark.createDataFrame(made(50, ["a"]), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
