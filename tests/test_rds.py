import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import rds as R

SCHEMA = "id long, recruiter_id long, network_size long, y int, sample_order long"


def make_sample(seed=1, population=3000, prevalence=0.3, activity=1.8, homophily=3.0, want=900, n=None):
    """Successive recruitment without replacement on a two-group population."""
    rng = np.random.default_rng(seed)
    y = (rng.random(population) < prevalence).astype(int)
    d = 1 + rng.poisson(np.where(y == 1, 5 * activity, 5))
    free = np.ones(population, bool)
    rows, queue = [], []
    for s in rng.choice(population, 10, replace=False, p=d / d.sum()):
        free[s] = False
        rows.append((int(s), None))
        queue.append(int(s))
    while queue and len(rows) < want:
        who = queue.pop(0)
        for _ in range(3):
            w = np.where(free, d * np.where(y == y[who], homophily, 1.0), 0)
            if w.sum() == 0 or len(rows) >= want:
                break
            pick = int(rng.choice(population, p=w / w.sum()))
            free[pick] = False
            rows.append((pick, who))
            queue.append(pick)
    return [(i, r, int(d[i]), int(y[i]), t) for t, (i, r) in enumerate(rows)], float(y.mean())


@pytest.fixture(scope="module")
def sample(spark):
    rows, truth = make_sample()
    return spark.createDataFrame(rows, SCHEMA).cache(), pd.DataFrame(
        rows, columns=["id", "recruiter_id", "network_size", "y", "sample_order"]), truth


def value(df):
    return df.first()["estimate"]


def test_coupons(spark):
    df = spark.createDataFrame(
        [(1, 100, 200, 300), (2, 200, 100, None), (3, 300, 300, 301), (4, 999, None, None)],
        "id long, own_coupon long, coupon_1 long, coupon_2 long")
    got = {r.id: r.recruiter_id for r in R.recruiter_from_coupons(df, ["coupon_1", "coupon_2"]).collect()}
    assert got == {1: "2", 2: "1", 3: "1", 4: "seed"}


def test_waves_with_cycles_and_broken_chains(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 40)]
    rows += [(100, 101), (101, 100), (102, 100), (200, 777), (201, 200)]
    df = spark.createDataFrame([(i, r, 1, 0, i) for i, r in rows], SCHEMA)
    got = {r.id: (r.seed_id, r.wave) for r in R.with_waves(df).collect()}
    assert all(got[i] == (0, i) for i in range(40))
    assert all(got[i] == (None, None) for i in (100, 101, 102, 200, 201))
    assert R.circular(df).count() == 5


def test_resolved_respondents_are_written_once(spark, monkeypatch):
    """A chain of 600 and 3,000 recruits of seeds: every round writes only what was still open."""
    written, write = [], R.checkpointed

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(R, "checkpointed", counted)
    rows = [(0, None, 1, 0, 0)] + [(i, i - 1, 1, 0, i) for i in range(1, 600)]
    rows += [(i, 0, 1, 0, i) for i in range(1000, 4000)]
    got = {r.id: r.wave for r in R.with_waves(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == i for i in range(600)) and all(got[i] == 1 for i in range(1000, 4000))
    assert written[0] == 3600 and written[1] == 3599 and written[2] < 600
    assert all(b < a for a, b in zip(written[1:], written[2:]))


def test_rate_from_steps_in_spark(spark, monkeypatch):
    """The same rate as on a collected histogram, from a full count to nearly nobody sampled."""
    monkeypatch.setattr(R, "MAX_CELLS", 1)  # nothing may be collected
    rng = np.random.default_rng(6)
    degree = np.concatenate((rng.integers(1, 40, 300), [1, 5000, 90_000]))
    df = spark.createDataFrame([(i, None, int(d), 0, i) for i, d in enumerate(degree)], SCHEMA)
    values, counts = np.unique(degree, return_counts=True)
    for size in (304, 310, 400, 1_000, 1e6, 1e30):
        want = R._solve_rate(values.astype(float), counts.astype(float), size)
        assert R.ss_rate(df, size) == pytest.approx(want, rel=1e-9)
    w = 1 / -np.expm1(-degree * R.ss_rate(df, 303))
    assert np.allclose(w, 1, atol=1e-12)
    with pytest.raises(ValueError):
        R.ss_rate(df, 200)


def test_validity(spark):
    rows = [(1, None, 3, 0, 1), (2, 2, 0, 0, 2), (3, 9, None, 0, 3), (4, 1, 2, 0, 0), (4, 1, 2, 0, 5)]
    bad = {r.rule: r.n_bad for r in R.validity_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert bad == {"missing id": 0, "bad network size": 2, "self recruitment": 1, "repeated id": 1,
                   "unknown recruiter": 1, "recruited before recruiter": 1, "no path to a seed": 2}


def test_estimators_against_pandas(sample):
    df, pdf, _ = sample
    w = 1 / pdf.network_size
    assert value(R.rds_ii(df)) == pytest.approx((w * pdf.y).sum() / w.sum())
    group = pdf.set_index("id")["y"]
    rec = pdf.dropna(subset=["recruiter_id"])
    g, h = group.loc[rec.recruiter_id].to_numpy(), rec.y.to_numpy()
    s01, s10 = (h[g == 0] == 1).mean(), (h[g == 1] == 0).mean()
    d0, d1 = (1 / (1 / pdf.network_size[pdf.y == v]).mean() for v in (0, 1))
    assert value(R.rds_i_binary(df)) == pytest.approx(s01 * d0 / (s01 * d0 + s10 * d1))
    many = {r.level: r.estimate for r in R.rds_i(df).collect()}
    assert many[1] == pytest.approx(value(R.rds_i_binary(df)))


def test_successive_sampling_limits(sample):
    df, pdf, _ = sample
    n = len(pdf)
    assert value(R.ss_estimate(df, 1e9)) == pytest.approx(value(R.rds_ii(df)), abs=1e-5)
    assert value(R.ss_estimate(df, n)) == pytest.approx(pdf.y.mean(), abs=1e-9)
    between = value(R.ss_estimate(df, 2 * n))
    assert value(R.rds_ii(df)) < between < pdf.y.mean()
    with pytest.raises(ValueError):
        R.ss_estimate(df, n - 1)


def test_homophily_graph_limits_and_truth(sample):
    df, pdf, truth = sample
    est = lambda size: {r.level: r.estimate for r in R.hcg_estimate(df, size).collect()}[1]
    assert est(1e8) == pytest.approx(value(R.rds_i_binary(df)), abs=1e-4)
    assert est(len(pdf)) == pytest.approx(pdf.y.mean(), abs=1e-3)
    error = abs(est(3000) - truth)
    assert error < 0.05 and error <= abs(value(R.rds_ii(df)) - truth) + 0.01


def test_weights_reproduce_estimates(sample):
    df, _, _ = sample
    out = R.weights(df, 3000.0)
    mean = lambda w: out.agg(F.sum(F.col(w) * F.col("y")) / F.sum(w)).first()[0]
    assert mean("w_rds_i") == pytest.approx(value(R.rds_i_binary(df)))
    assert mean("w_rds_ii") == pytest.approx(value(R.rds_ii(df)))
    assert mean("w_ss") == pytest.approx(value(R.ss_estimate(df, 3000.0)))
    hcg = R.hcg_weights(df, 3000.0).agg(F.sum(F.col("w_hcg") * F.col("y")) / F.sum("w_hcg")).first()[0]
    top = {r.level: r.estimate for r in R.hcg_estimate(df, 3000.0).collect()}[1]
    assert hcg == pytest.approx(top, abs=1e-4)


def test_convergence_ends_at_the_estimate(sample):
    df, pdf, _ = sample
    last = R.convergence(df).orderBy(F.desc("m")).first()
    assert last.m == len(pdf) and last.estimate == pytest.approx(value(R.rds_ii(df)))
    grid = R.convergence_grid(df, 3000.0, points=10).orderBy("cut_point").collect()
    assert len(grid) == 10 and grid[-1].m == len(pdf)
    assert grid[-1].rds_i == pytest.approx(value(R.rds_i_binary(df)))
    assert grid[-1].ss == pytest.approx(value(R.ss_estimate(df, 3000.0)))


def test_grids_follow_each_seed(sample):
    """The last cut point of a seed equals the estimators run on that seed's respondents alone."""
    df, _, _ = sample
    waves = R.with_waves(df).cache()
    grid = R.convergence_grid(waves, 3000.0, points=4, by=["seed_id"], timed=True)
    last = {r.seed_id: r for r in grid.where("cut_point = 4").collect()}
    assert len(last) == waves.where("wave = 0").count()
    big = max(last, key=lambda k: last[k].m)
    alone = waves.where(F.col("seed_id") == big)
    assert last[big].m == alone.count()
    assert last[big].ss == pytest.approx(value(R.ss_estimate(alone, 3000.0)))
    assert last[big].rds_i == pytest.approx(value(R.rds_i_binary(alone)))
    whole = R.hcg_fit(alone, 3000.0, slices=4)
    assert last[big].hcg == pytest.approx(whole.sizes[1] / 3000.0)


def test_homophily_and_activity_directions(sample):
    df, _, _ = sample
    assert R.recruitment_homophily(df).first()[0] > 1.1
    pop = {r.weight_type: r.homophily for r in R.population_homophily(df, 3000.0).collect()}
    assert all(h > 1.1 for h in pop.values())
    act = {r.weight_type: r.differential_activity for r in R.weighted_degrees(df, 3000.0).collect()}
    assert all(1.3 < a < 2.3 for a in act.values())


def test_bootstrap_is_seeded_and_independent_of_partitioning(spark, sample):
    df, _, truth = sample
    runs = []
    for parts in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = R.bootstrap(df, replicates=60, seed=4, chain=200).orderBy("estimator").collect()
        runs.append([(r.estimator, round(r.se, 10)) for r in rows])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1]
    assert all(0.005 < se < 0.1 for _, se in runs[0])
    other = R.bootstrap(df, replicates=60, seed=5, chain=200).orderBy("estimator").collect()
    assert [round(r.se, 10) for r in other] != [se for _, se in runs[0]]
    whole = R.bootstrap(df, replicates=60, seed=4, size=3000.0, chain=200).orderBy("estimator").collect()
    assert whole[0].se < runs[0][0][1]
    assert [r.estimator for r in whole] == ["RDS-I", "RDS-II", "SS"]


def test_hot_recruiter(spark):
    """One recruiter holds a third of the sample; counts stay exact."""
    rnd = random.Random(2)
    rows = [(0, None, 5, 1, 0), (1, None, 5, 0, 1)]
    for i in range(2, 1200):
        rows.append((i, 0 if i % 3 == 0 else rnd.randrange(1, i), 1 + i % 7, i % 2, i))
    df = spark.createDataFrame(rows, SCHEMA)
    y = {r[0]: r[3] for r in rows}
    want = pd.Series([(y[r[1]], r[3]) for r in rows if r[1] is not None]).value_counts()
    got = {(r.g, r.h): r.r for r in R.recruitment_counts(df).collect()}
    assert got == {k: int(v) for k, v in want.items()}
    depth = {0: 0, 1: 0}
    for i, who, *_ in rows[2:]:
        depth[i] = depth[who] + 1
    assert {r.id: r.wave for r in R.with_waves(df).collect()} == depth


def test_suitability_reads_the_study(sample):
    df, _, _ = sample
    rows = {(r.condition, r.estimator): (r.present, r.verdict) for r in R.suitability(df, None).collect()}
    assert rows[("population size unknown", "SS")] == (True, "no")
    assert rows[("large sampling fraction", "RDS-I")] == (False, "ok")
    assert rows[("high differential activity", "RDS-II")][1] == "no"
    assert len(rows) == 32


def spoiled(rows):
    """The sample with rows no estimator can use: null outcome, null, zero and negative degree."""
    top = max(r[0] for r in rows) + 1
    bad = [(5, None), (None, 1), (0, 1), (-3, 0)]
    return rows + [(top + i, rows[i][0], d, y, 10_000 + i) for i, (d, y) in enumerate(bad)]


@pytest.mark.parametrize(
    "estimate",
    [
        lambda df: R.rds_i(df),
        lambda df: R.rds_i_binary(df),
        lambda df: R.rds_ii(df),
        lambda df: R.rds_ii_levels(df),
        lambda df: R.ss_estimate(df, 3000),
        lambda df: R.hcg_estimate(df, 3000),
        lambda df: R.bootstrap(df, replicates=5, size=3000),
        lambda df: R.weights(df, 3000).where("w_ss is not null").orderBy("id").select("w_rds_i", "w_rds_ii", "w_ss"),
        lambda df: R.convergence_grid(df, 3000, points=3),
    ],
)
def test_unusable_rows_change_nothing(spark, estimate):
    rows, _ = make_sample(want=200)
    got = estimate(spark.createDataFrame(spoiled(rows), SCHEMA)).collect()
    want = estimate(spark.createDataFrame(rows, SCHEMA)).collect()
    as_rows = lambda rs: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rs], key=str)
    assert as_rows(got) == as_rows(want)


def test_unusable_rows_are_counted(spark):
    rows, _ = make_sample(want=50)
    got = R.left_out(spark.createDataFrame(spoiled(rows), SCHEMA)).first()
    assert (got.n, got.no_outcome, got.no_degree, got.bad_degree, got.left_out) == (54, 1, 1, 2, 4)


def test_bootstrap_by_level_agrees_with_the_two_group_form(sample):
    df = sample[0]
    two = {r.estimator: r for r in R.bootstrap(df, replicates=30, size=3000.0, chain=200).collect()}
    levels = R.bootstrap_levels(df, replicates=30, size=3000.0, chain=200).collect()
    assert len(levels) == 6
    for r in levels:
        want = two[r.estimator]
        assert r.se == pytest.approx(want.se, rel=1e-6)
        assert r.estimate == pytest.approx(want.estimate if r.level == 1 else 1 - want.estimate, rel=1e-9)


def test_bootstrap_of_three_levels(spark, sample):
    rows = [(i, r, d, ["a", "b", "c"][(y * 2 + i % 2) % 3], t) for i, r, d, y, t in sample[0].collect()]
    df = spark.createDataFrame(rows, SCHEMA.replace("y int", "y string"))
    got = R.bootstrap_levels(df, replicates=40, size=3000.0).collect()
    again = R.bootstrap_levels(df.repartition(5), replicates=40, size=3000.0, chain=77).collect()
    key = lambda r: (r.estimator, r.level)
    for a, b in zip(sorted(got, key=key), sorted(again, key=key), strict=True):
        assert key(a) == key(b) and a.se == pytest.approx(b.se, rel=1e-9)
    assert len(got) == 9 and all(0 < r.se < 0.2 and r.low < r.estimate < r.high for r in got)
    for name in ("RDS-I", "RDS-II", "SS"):
        assert sum(r.estimate for r in got if r.estimator == name) == pytest.approx(1)


def test_bootstrap_does_not_depend_on_the_piece_length(spark):
    rows, _ = make_sample(want=300)
    df = spark.createDataFrame(rows, SCHEMA).cache()
    want = R.bootstrap(df, replicates=20, size=3000).orderBy("estimator").collect()
    for chain in (1, 7, 299, 300, 301):
        assert R.bootstrap(df, replicates=20, size=3000, chain=chain).orderBy("estimator").collect() == want


def test_rate_needs_positive_degrees():
    with pytest.raises(ValueError, match="positive"):
        R._solve_rate(np.array([0.0, 2.0]), np.array([1.0, 5.0]), 100)
    assert R._solve_rate(np.array([2.0]), np.array([5.0]), 1e30) > 0


def test_rds_i_at_every_m(spark):
    """The first m respondents on their own give the estimate of row m."""
    rows, _ = make_sample(want=60)
    rows[30] = (rows[30][0], rows[59][0], *rows[30][2:])  # a recruiter who joins later
    df = spark.createDataFrame(spoiled(rows), SCHEMA)
    got = {r.m: r.estimate for r in R.convergence_rds_i(df).collect()}
    assert sorted(got) == list(range(1, 61))
    for m in (2, 31, 45, 60):
        want = R.rds_i_binary(spark.createDataFrame(rows[:m], SCHEMA)).first().estimate
        assert got[m] == (want if want is None else pytest.approx(want))
