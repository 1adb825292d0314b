import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import dag as G
from cohortloom.operators import effects as E
from cohortloom.operators import evalue as V
from cohortloom.plans.confounding import adjustment_covariates


@pytest.mark.parametrize(
    "crude, a, b, want",
    [
        (3.0, 2.0, 2.1, "positive confounding"),
        (3.0, 5.0, 4.8, "negative confounding"),
        (3.0, 0.5, 0.7, "qualitative confounding"),
        (3.0, 5.0, 2.0, "quantitative interaction"),
        (3.0, 5.0, 1.01, "qualitative interaction"),
        (3.0, 5.0, 0.6, "qualitative interaction"),
        (0.4, 0.5, 0.55, "positive confounding"),
        (2.0, 1.9, 2.1, "no clear change"),
        (8.0, 1.2, 6.0, "leans to confounding"),
        (2.0, 0.5, 1.4, "leans to confounding"),
    ],
)
def test_patterns(spark, crude, a, b, want):
    label = E.classify(F.lit(crude), F.lit(min(a, b)), F.lit(max(a, b)))
    assert spark.range(1).select(label).first()[0] == want


def people(spark, cells):
    """cells: (z, x, y, count)."""
    df = spark.createDataFrame(cells, "z int, x int, y int, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "i")


def test_pooled_ratio_by_hand(spark):
    df = people(spark, [(0, 1, 1, 10), (0, 1, 0, 90), (0, 0, 1, 5), (0, 0, 0, 95),
                        (1, 1, 1, 30), (1, 1, 0, 20), (1, 0, 1, 30), (1, 0, 0, 70)])
    row = E.mantel_haenszel(df, "z").first()
    top = 10 * 100 / 200 + 30 * 100 / 150
    assert row.rr_adj == pytest.approx(top / (5 * 100 / 200 + 30 * 50 / 150))
    assert row.or_adj == pytest.approx((10 * 95 / 200 + 30 * 70 / 150) / (90 * 5 / 200 + 20 * 30 / 150))
    assert row.rr == pytest.approx((40 / 150) / (35 / 200))


def test_empty_cells_leave_ratios_null(spark):
    row = E.measures(people(spark, [(0, 1, 1, 3), (0, 1, 0, 4)]), []).first()
    assert row.rr is None and row.odds_ratio is None and row.rd is None


def test_standardised_ratio_removes_confounding(spark):
    """No effect within levels of u, but a crude ratio above 1."""
    df = people(spark, [(0, 1, 1, 10), (0, 1, 0, 90), (0, 0, 1, 40), (0, 0, 0, 360),
                        (1, 1, 1, 200), (1, 1, 0, 200), (1, 0, 1, 50), (1, 0, 0, 50)])
    df = df.withColumn("c", F.lit("one"))
    row = V.bias_analysis(df, "c", "z").first()
    assert row.rr_true == pytest.approx(1.0) and row.rr > 1.5
    assert row.rr_ud == pytest.approx(5.0) and row.rr_eu == pytest.approx(4.0)
    assert row.rr / row.rr_true <= row.bound + 1e-9


def test_interaction_model_recovers_known_coefficients(spark):
    rng = np.random.default_rng(5)
    z, x = rng.normal(size=20000), rng.integers(0, 2, 20000)
    p = 1 / (1 + np.exp(-(-1 + 0.5 * x + 0.3 * z + 0.8 * x * z)))
    y = (rng.random(20000) < p).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), z.tolist())), "x int, y int, z double")
    fit = {r.term: r for r in E.interaction_model(df, "z").collect()}
    assert fit["xz"].estimate == pytest.approx(0.8, abs=0.15) and fit["xz"].p_value < 1e-6
    assert fit["x"].estimate == pytest.approx(0.5, abs=0.15)


def test_interaction_model_says_when_it_has_no_estimate(spark):
    schema = "x int, y int, z double"
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2)), int(rng.integers(2)), float(rng.normal())) for _ in range(300)]
    good = E.interaction_model(spark.createDataFrame(rows, schema), "z").collect()
    assert all(r.converged and r.std_error > 0 for r in good)
    # the same fit whatever the number of equal rows per count
    twice = E.interaction_model(spark.createDataFrame(rows * 2, schema), "z").collect()
    assert [r.estimate for r in twice] == pytest.approx([r.estimate for r in good], rel=0.02)
    separated = [(x, int(z > 0), z) for x, _, z in rows]
    never_exposed = [(0, y, z) for _, y, z in rows]
    flat = [(x, y, 1.0) for x, y, _ in rows]
    for bad in (separated, never_exposed, flat, [], [(None, 1, 1.0)]):
        got = E.interaction_model(spark.createDataFrame(bad, schema), "z").collect()
        assert len(got) == 4 and not any(r.converged or r.estimate is not None for r in got)


EDGES = ["X-Z", "Z-Y", "U-X", "U-Y", "A-Y", "R-Y", "D-Y", "J-Y", "S-Y", "B-Z", "I-Z", "I-X", "I-Y",
         "D-S", "D-J", "R-Z"]


def graph(spark, edges, gid=1):
    return spark.createDataFrame([(gid, *e.split("-")) for e in edges], "graph_id int, src string, dst string")


def test_worked_graph_roles(spark):
    edges = graph(spark, EDGES)
    ask = spark.createDataFrame([(1, "X", "Y")], "graph_id int, exposure string, outcome string")
    roles = {r.node: r.role for r in G.variable_roles(edges, ask).collect()}
    want = {"X": "exposure", "Y": "outcome", "Z": "mediator", "U": "confounder", "I": "confounder"}
    want.update({n: "competing exposure" for n in "ARDJSB"})
    assert roles == want
    assert sorted(r.node for r in adjustment_covariates(edges, ask).collect()) == ["I", "U"]


def test_proxy_confounder_and_cause_through_exposure(spark):
    edges = graph(spark, ["C-X", "C-P", "P-Y", "X-Y", "V-X", "X-M", "M-Y", "Y-O"])
    ask = spark.createDataFrame([(1, "X", "Y")], "graph_id int, exposure string, outcome string")
    roles = {r.node: r.role for r in G.variable_roles(edges, ask).collect()}
    assert roles["C"] == "confounder" and roles["P"] == "proxy confounder"
    assert roles["M"] == "mediator" and roles["V"] == "other" and roles["O"] == "other"


def test_closure_and_cycles_against_brute_force(spark):
    chain = [f"n{i}-n{i + 1}" for i in range(13)]
    edges = graph(spark, chain).unionByName(graph(spark, ["a-b", "b-c", "c-a", "c-d", "z-a"], 2))
    pairs = {(r.graph_id, r.src, r.dst) for r in G.closure(edges).collect()}
    assert len([p for p in pairs if p[0] == 1]) == 13 * 14 // 2
    loop = {(2, s, t) for s in "abc" for t in "abcd"} | {(2, "z", t) for t in "abcd"}
    assert {p for p in pairs if p[0] == 2} == loop
    got = {r.graph_id: (r.n_edges, r.acyclic) for r in G.acyclicity(edges).collect()}
    assert got == {1: (13, True), 2: (5, False)}
    core = {(r.src, r.dst) for r in G.cyclic_core(edges).collect()}
    assert core == {("a", "b"), ("b", "c"), ("c", "a")}


def test_neighbours_list_both_ends(spark):
    rows = G.neighbours(graph(spark, ["a-b", "a-b", "b-c"])).collect()
    assert sorted((r.node, r.relation, r.other) for r in rows) == [
        ("a", "child", "b"), ("b", "child", "c"), ("b", "parent", "a"), ("c", "parent", "b")]
