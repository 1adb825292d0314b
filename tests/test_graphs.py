"""Reach, cycles and roles on many graphs at once, against plain walks."""

import random

import pytest

from cohortloom.operators import dag as G

SCHEMA = "graph_id long, src long, dst long"


def reach(edges):
    """node -> nodes reached by one step or more."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found[a] = seen
    return found


def made():
    rng = random.Random(11)
    graphs = {
        0: [(i, i + 1) for i in range(20)],
        1: [(i, (i + 1) % 9) for i in range(9)],
        2: [(5, 5)],
        3: [(i, (i * 3 + 1) % 10) for i in range(10)],
        4: [(9 - i, 8 - i) for i in range(9)] + [(2, 7), (0, 4)],
        5: [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 0), (5, 7), (7, 8)],
        6: [(0, i) for i in range(1, 8)] + [(i, 8) for i in range(1, 8)] + [(8, 9), (9, 10)],
    }
    for g in range(7, 70):
        n = rng.randrange(2, 13)
        m = rng.randrange(1, 2 * n)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        if g % 3 == 0:
            edges = [(min(e), max(e)) for e in edges if e[0] != e[1]] or [(0, 1)]
        names = rng.sample(range(100), n)
        graphs[g] = [(names[a], names[b]) for a, b in edges]
    return graphs


GRAPHS = made()


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(g, a, b) for g, es in GRAPHS.items() for a, b in es]
    return spark.createDataFrame(rows + rows[:50], SCHEMA)


def test_acyclicity(edges):
    got = {r.graph_id: r.acyclic for r in G.acyclicity(edges).collect()}
    assert got == {g: all(a not in r for a, r in reach(es).items()) for g, es in GRAPHS.items()}


def test_components_of_cycles(edges):
    got = {(r.graph_id, r.src, r.dst): r.component for r in G.cyclic_core(edges).collect()}
    want = {}
    for g, es in GRAPHS.items():
        to = reach(es)
        for a, b in es:
            if a in to[b]:
                want[g, a, b] = min(x for x in to if x in to[a] and a in to[x])
    assert got == want


def test_pairs_of_asked_nodes(spark, edges):
    """The index gives the pairs that all pairs give, on graphs with and without cycles."""
    asked = {(g, es[k][0]) for g, es in GRAPHS.items() for k in range(0, len(es), 3)} | {(1, 12345), (999, 1)}
    nodes = spark.createDataFrame(sorted(asked) + sorted(asked)[:3], "graph_id long, node long")
    got = sorted(map(tuple, G.closure(edges, nodes).select(*G.EDGE).collect()))
    want = set()
    for g, es in GRAPHS.items():
        want |= {(g, a, b) for a, r in reach(es).items() for b in r if (g, a) in asked or (g, b) in asked}
    assert got == sorted(want)
    assert sorted(set(map(tuple, G.closure(edges).select(*G.EDGE).collect()))) == sorted(
        (g, a, b) for g, es in GRAPHS.items() for a, r in reach(es).items() for b in r
    )


def test_marks_walk_their_own_moves(spark):
    rng = random.Random(3)
    moves, starts, want = set(), set(), set()
    for g, es in GRAPHS.items():
        for mark in ("p", "q"):
            own = {e for e in es if rng.random() < 0.8}
            begin = {rng.choice(es)[0] for _ in range(2)}
            moves |= {(g, mark, a, b) for a, b in own}
            starts |= {(g, mark, n) for n in begin}
            to = reach(own)
            want |= {(g, n, mark) for s in begin for n in {s} | to.get(s, set())}
    got = G.spread_marks(
        spark.createDataFrame(sorted(moves), "graph_id long, mark string, node long, nxt long"),
        spark.createDataFrame(sorted(starts), "graph_id long, mark string, node long"),
    )
    assert sorted(map(tuple, got.select("graph_id", "node", "mark").collect())) == sorted(want)


@pytest.fixture
def written(monkeypatch):
    made, write = [], G.checkpointed

    def counted(df):
        made.append(1)
        return write(df)

    monkeypatch.setattr(G, "checkpointed", counted)
    return made


def test_a_long_chain_takes_few_rounds(spark, written):
    """2,000 nodes in a row: doubling, not a layer a round."""
    n = 2_000
    chain = spark.range(n - 1).selectExpr("1L AS graph_id", "id AS src", "id + 1 AS dst")
    assert G.acyclicity(chain).first().acyclic and len(written) <= 20
    written.clear()
    ask = spark.createDataFrame([(1, 900, 1500)], "graph_id long, exposure long, outcome long")
    roles = G.variable_roles(chain, ask).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in roles} == {"exposure": 1, "outcome": 1, "mediator": 599, "other": 1399}
    assert len(written) <= 40
    written.clear()
    index = G.reach_index(chain)
    assert index.places.count() == n and index.exits.count() == 0 and len(written) <= 20
    node = spark.createDataFrame([(1, 700)], "graph_id long, node long")
    assert G.closure(chain, node).count() == n - 1


def test_nothing_to_walk(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert G.acyclicity(none).count() == 0 and G.cyclic_core(none).count() == 0
    assert G.closure(none, spark.createDataFrame([(1, 2)], "graph_id long, node long")).count() == 0
