"""Respondent-driven sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rds as R
from .prelude import big, r6
from .registry import query
from .relational import dist_sql

CAT = R.Frame(outcome="y_cat")


def size_of(v) -> float:
    """The tables name no population size; twice the sample keeps the finite case in play."""
    return 2.0 * v.table("customer").count()


@query("k1_recruiter_from_coupons", """
SELECT c.id, COALESCE(CAST(g.giver AS VARCHAR), 'seed') AS recruiter_id FROM coupons c LEFT JOIN (
 SELECT coupon, MIN(id) AS giver FROM (SELECT id, own_coupon, coupon_1 AS coupon FROM coupons UNION ALL SELECT id, own_coupon, coupon_2 FROM coupons
  UNION ALL SELECT id, own_coupon, coupon_3 FROM coupons) u WHERE coupon <> own_coupon GROUP BY 1) g ON c.own_coupon = g.coupon""")
def _(v):
    out = R.recruiter_from_coupons(v.coupons, ["coupon_1", "coupon_2", "coupon_3"])
    return out.select("id", "recruiter_id")


@query("k2_validity", f"""
SELECT 'missing id' AS rule, {big('COUNT(*) FILTER (id IS NULL)')} AS n_bad FROM rds
UNION ALL SELECT 'bad network size', {big('COUNT(*) FILTER (network_size IS NULL OR network_size <= 0)')} FROM rds
UNION ALL SELECT 'self recruitment', {big('COUNT(*) FILTER (id = recruiter_id)')} FROM rds
UNION ALL SELECT 'repeated id', {big('COUNT(*)')} FROM (SELECT id FROM rds GROUP BY 1 HAVING COUNT(*) > 1) a
UNION ALL SELECT 'unknown recruiter', {big('COUNT(*)')} FROM rds WHERE recruiter_id IS NOT NULL AND recruiter_id NOT IN (SELECT id FROM rds)
UNION ALL SELECT 'recruited before recruiter', {big('COUNT(*)')} FROM rds r JOIN rds o ON r.recruiter_id = o.id WHERE o.sample_order > r.sample_order
UNION ALL SELECT 'no path to a seed', {big('COUNT(*)')} FROM rds WHERE id NOT IN (SELECT id FROM waves WHERE seed_id IS NOT NULL)""")
def _(v):
    return R.validity_report(v.rds)


@query("k3_seed_and_wave", "SELECT id, seed_id, wave FROM waves")
def _(v):
    return R.with_waves(v.rds).select("id", "seed_id", "wave")


@query("k4_tree_edges", """
SELECT seed_id, wave, recruiter_id AS recruiter, id AS recruit, y AS stratum FROM waves WHERE recruiter_id IS NOT NULL""")
def _(v):
    return R.tree_edges(R.with_waves(v.rds))


@query("k5_degree_by_wave", f"SELECT wave, y, {dist_sql('network_size')} FROM waves GROUP BY 1, 2")
def _(v):
    return R.degree_by_wave(R.with_waves(v.rds), strata=["y"]).withColumns(
        {c: F.col(c).cast("double") for c in ("min", "max")}
    )


@query("k6_rds_i", f"SELECT 'RDS-I' AS estimator, {r6('s01 * hd0 / (s01 * hd0 + s10 * hd1)')} AS estimate FROM two")
def _(v):
    return R.rds_i_binary(v.rds)


_POWER = {
    "moves": """
SELECT o.y_cat AS g, r.y_cat AS h, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY o.y_cat) AS s FROM rds r JOIN rds o ON r.recruiter_id = o.id GROUP BY 1, 2""",
    "degs": "SELECT y_cat AS g, COUNT(*) / SUM(1.0 / network_size) AS hd FROM rds GROUP BY 1",
    "flow": """
SELECT 0 AS i, g, 1.0 / (SELECT COUNT(*) FROM degs) AS p FROM degs
UNION ALL SELECT i + 1, h, SUM(p * s) FROM flow JOIN moves ON flow.g = moves.g WHERE i < 200 GROUP BY i, h""",
}


@query("k6_rds_i_categories", f"""
SELECT f.g AS level, {r6('p / hd / SUM(p / hd) OVER ()')} AS estimate FROM flow f JOIN degs d ON f.g = d.g WHERE i = 200""", _POWER)
def _(v):
    return R.rds_i(v.rds, CAT)


@query("k7_rds_ii", f"""
SELECT 'binary' AS outcome, {r6('SUM(y * 1.0 / network_size) / SUM(1.0 / network_size)')} AS estimate FROM rds
UNION ALL SELECT 'continuous', {r6('SUM(y_cont / network_size) / SUM(1.0 / network_size)')} FROM rds""")
def _(v):
    one = lambda name, f: R.rds_ii(v.rds, f).select(F.lit(name).alias("outcome"), "estimate")
    return one("binary", R.Frame()).unionByName(one("continuous", R.Frame(outcome="y_cont")))


@query("k7_rds_ii_levels", f"""
SELECT y_cat AS level, {r6('SUM(1.0 / network_size) / SUM(SUM(1.0 / network_size)) OVER ()')} AS estimate FROM rds GROUP BY 1""")
def _(v):
    return R.rds_ii_levels(v.rds, CAT)


_SS_W = "(1 / (1 - EXP(-network_size * t)))"


@query("k8_successive_sampling", f"""
SELECT 'SS' AS estimator, {r6(f'SUM({_SS_W} * y) / SUM({_SS_W})')} AS estimate FROM rds, rate""")
def _(v):
    return R.ss_estimate(v.rds, size_of(v))


@query("k9_homophily_configuration_graph")
def _(v):
    return R.hcg_estimate(v.rds, size_of(v))


@query("k10_bootstrap_intervals")
def _(v):
    return R.bootstrap(v.rds, size=size_of(v))


@query("k10_bootstrap_by_level")
def _(v):
    return R.bootstrap_levels(v.rds, R.Frame(outcome="y_cat"), size=size_of(v))


@query("k11_weights", f"""
SELECT id, {r6('CASE WHEN y = 1 THEN p ELSE 1 - p END * n / CASE WHEN y = 1 THEN n1 ELSE n0 END')} AS w_rds_i, {r6('n / inv / network_size')} AS w_rds_ii, {r6(f'{_SS_W} * n / ss')} AS w_ss
FROM rds, (SELECT s01 * hd0 / (s01 * hd0 + s10 * hd1) AS p, n0, n1 FROM two) a,
 (SELECT CAST(COUNT(*) AS DOUBLE) AS n, SUM(1.0 / network_size) AS inv, SUM({_SS_W}) AS ss FROM rds, rate) b, rate""")
def _(v):
    return R.weights(v.rds, size_of(v)).select("id", "w_rds_i", "w_rds_ii", "w_ss")


@query("k11_weights_hcg")
def _(v):
    return R.hcg_weights(v.rds, size_of(v)).select("id", "w_hcg")


@query("k12_convergence_rds_ii", f"""
SELECT id, {big('ROW_NUMBER() OVER w')} AS m, {r6('SUM(y * 1.0 / network_size) OVER w / SUM(1.0 / network_size) OVER w')} AS estimate
FROM rds WINDOW w AS (ORDER BY sample_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(v):
    return R.convergence(v.rds)


def _every_m(source: str, by: str) -> str:
    """RDS-I at every m from running sums; a recruitment counts at the later of its ends."""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    run = lambda x: f"SUM({x}) OVER w"
    moved = {c: run(f"COALESCE(r{c}, 0)") for c in ("00", "01", "10", "11")}
    flow = {
        "01": f"({moved['01']} * 1.0 / NULLIF({moved['00']} + {moved['01']}, 0))",
        "10": f"({moved['10']} * 1.0 / NULLIF({moved['10']} + {moved['11']}, 0))",
    }
    deg = {
        g: f"({run(f'CASE WHEN y = {g} THEN 1 ELSE 0 END')} / NULLIF({run(f'CASE WHEN y = {g} THEN 1.0 / network_size ELSE 0 END')}, 0))"
        for g in (0, 1)
    }
    a, b = f"({flow['01']} * {deg[0]})", f"({flow['10']} * {deg[1]})"
    counts = ", ".join(f"COUNT(*) FILTER (g = {c[0]} AND h = {c[1]}) AS r{c}" for c in ("00", "01", "10", "11"))
    return f"""
SELECT {keys}id, {big('ROW_NUMBER() OVER w')} AS m, {r6(f'{a} / NULLIF({a} + {b}, 0)')} AS estimate
FROM {source} LEFT JOIN (SELECT at_id, {counts} FROM (
 SELECT CASE WHEN (o.sample_order, o.id) > (r.sample_order, r.id) THEN o.id ELSE r.id END AS at_id, o.y AS g, r.y AS h
 FROM {source} r JOIN {source} o ON r.recruiter_id = o.id) l GROUP BY 1) p ON p.at_id = id
WINDOW w AS ({part}ORDER BY sample_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("k12_convergence_rds_i", _every_m("rds", ""))
def _(v):
    return R.convergence_rds_i(v.rds)


@query("k13_bottleneck_rds_i", _every_m("waves", "seed_id"))
def _(v):
    return R.convergence_rds_i(R.with_waves(v.rds), by=["seed_id"])


_GRID = {
    "ranked": "SELECT *, CAST(CEIL(ROW_NUMBER() OVER (ORDER BY sample_order, id) * 20.0 / COUNT(*) OVER ()) AS INTEGER) AS slice FROM rds",
    "points": "SELECT UNNEST(RANGE(1, 21)) AS cut_point",
    "gdeg": """
SELECT cut_point, COUNT(*) AS m, COUNT(*) FILTER (y = 0) / SUM(CASE WHEN y = 0 THEN 1.0 / network_size END) AS hd0, COUNT(*) FILTER (y = 1) / SUM(CASE WHEN y = 1 THEN 1.0 / network_size END) AS hd1
FROM points p JOIN ranked r ON r.slice <= p.cut_point GROUP BY 1""",
    "grec": """
SELECT cut_point, CAST(COUNT(*) FILTER (o.y = 0 AND r.y = 1) AS DOUBLE) / NULLIF(COUNT(*) FILTER (o.y = 0), 0) AS s01, CAST(COUNT(*) FILTER (o.y = 1 AND r.y = 0) AS DOUBLE) / NULLIF(COUNT(*) FILTER (o.y = 1), 0) AS s10
FROM points p JOIN ranked r ON r.slice <= p.cut_point JOIN ranked o ON r.recruiter_id = o.id AND o.slice <= p.cut_point GROUP BY 1""",
    "ghist": "SELECT cut_point, network_size AS d, y, COUNT(*) AS n FROM points p JOIN ranked r ON r.slice <= p.cut_point GROUP BY 1, 2, 3",
    "gbis": """
SELECT cut_point, 0 AS i, LN(1e-18) AS lo, LN(1e3) AS hi FROM points
UNION ALL SELECT cut_point, i + 1, CASE WHEN s > total THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s > total THEN hi ELSE (lo + hi) / 2 END FROM (
 SELECT b.cut_point, i, lo, hi, SUM(h.n / (1 - EXP(-h.d * EXP((lo + hi) / 2)))) AS s, MAX(z.total) AS total FROM gbis b JOIN ghist h ON b.cut_point = h.cut_point, (SELECT 2 * COUNT(*) AS total FROM rds) z WHERE i < 100 GROUP BY 1, 2, 3, 4) q""",
    "gss": """
SELECT h.cut_point, SUM(h.n * y / (1 - EXP(-h.d * t))) / SUM(h.n / (1 - EXP(-h.d * t))) AS ss FROM ghist h JOIN (SELECT cut_point, EXP((lo + hi) / 2) AS t FROM gbis WHERE i = 100) b ON h.cut_point = b.cut_point GROUP BY 1""",
}


@query("k12_convergence_grid", f"""
SELECT CAST(d.cut_point AS INTEGER) AS cut_point, {big('d.m')} AS m, {r6('s01 * hd0 / NULLIF(s01 * hd0 + s10 * hd1, 0)')} AS rds_i, {r6('s.ss')} AS ss
FROM gdeg d JOIN gss s ON d.cut_point = s.cut_point LEFT JOIN grec r ON d.cut_point = r.cut_point""", _GRID)
def _(v):
    return R.convergence_grid(v.rds, size_of(v))


@query("k13_bottleneck", f"""
SELECT seed_id, id, {big('ROW_NUMBER() OVER w')} AS m, {r6('SUM(y * 1.0 / network_size) OVER w / SUM(1.0 / network_size) OVER w')} AS estimate
FROM waves WINDOW w AS (PARTITION BY seed_id ORDER BY sample_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(v):
    return R.convergence(R.with_waves(v.rds), by=["seed_id"])


@query("k12_convergence_grid_timed")
def _(v):
    return R.convergence_grid(v.rds, size_of(v), timed=True)


@query("k13_bottleneck_grid")
def _(v):
    return R.convergence_grid(R.with_waves(v.rds), size_of(v), by=["seed_id"], timed=True)


@query("k14_differential_activity_timed")
def _(v):
    return R.weighted_degrees(v.rds, size_of(v), timed=True)


@query("k16_population_homophily_timed")
def _(v):
    return R.population_homophily(v.rds, size_of(v), timed=True)


_ACT = {
    "RDS-I": "1.0",
    "RDS-II": "(1.0 / network_size)",
    "SS": _SS_W,
}


def _mean_degree(w: str, y: int) -> str:
    return f"SUM(CASE WHEN y = {y} THEN {w} * network_size END) / SUM(CASE WHEN y = {y} THEN {w} END)"


@query("k14_differential_activity", " UNION ALL ".join(
    f"SELECT '{t}' AS weight_type, {r6(_mean_degree(w, 0))} AS degree_0, {r6(_mean_degree(w, 1))} AS degree_1,"
    f" {r6(f'({_mean_degree(w, 1)}) / ({_mean_degree(w, 0)})')} AS differential_activity FROM rds, rate"
    for t, w in _ACT.items()))
def _(v):
    return R.weighted_degrees(v.rds, size_of(v))


@query("k15_recruitment_homophily", f"""
SELECT {r6('(r00 + r11) / (((r00 + r01) * (r00 + r10) + (r10 + r11) * (r01 + r11)) / (r00 + r01 + r10 + r11))')} AS homophily FROM two""")
def _(v):
    return R.recruitment_homophily(v.rds)


def _pop_homophily(name: str, p: str, d1: str, d0: str) -> str:
    a, b = f"({p} * {d1})", f"((1 - {p}) * {d0})"
    return f"SELECT '{name}' AS weight_type, {r6(f'({a} * {b} / ({a} + {b})) / (({a} * s10 + {b} * s01) / 2)')} AS homophily FROM two, pii, pss"


@query("k16_population_homophily", " UNION ALL ".join([
    _pop_homophily("RDS-I", "(s01 * hd0 / (s01 * hd0 + s10 * hd1))", "md1", "md0"),
    _pop_homophily("RDS-II", "p_ii", "hd1", "hd0"),
    _pop_homophily("SS", "p_ss", "ds1", "ds0")]),
    {"pii": "SELECT SUM(y * 1.0 / network_size) / SUM(1.0 / network_size) AS p_ii FROM rds",
     "pss": f"SELECT SUM({_SS_W} * y) / SUM({_SS_W}) AS p_ss, {_mean_degree(_SS_W, 1)} AS ds1, {_mean_degree(_SS_W, 0)} AS ds0 FROM rds, rate"})
def _(v):
    return R.population_homophily(v.rds, size_of(v))


@query("k17_sampling_fraction", f"SELECT {big('COUNT(*)')} AS n, {r6('COUNT(*) / (2.0 * COUNT(*))')} AS fraction FROM rds")
def _(v):
    return R.sampling_fraction(v.rds, size_of(v))


_SEEDS = "COUNT(*) FILTER (recruiter_id IS NULL) * 1.0 / SUM(COUNT(*) FILTER (recruiter_id IS NULL)) OVER ()"
_SHARE = "SUM(1.0 / network_size) / SUM(SUM(1.0 / network_size)) OVER ()"


@query("k18_seed_dependence", f"""
SELECT y_cat AS level, {r6(_SEEDS)} AS seed_share, {r6(_SHARE)} AS share, {r6(f'({_SEEDS}) - ({_SHARE})')} AS difference FROM rds GROUP BY 1""")
def _(v):
    return R.seed_dependence(v.rds, CAT)


@query("k19_estimator_comparison", f"""
SELECT 'RDS-I' AS estimator, {r6('s01 * hd0 / (s01 * hd0 + s10 * hd1)')} AS estimate FROM two
UNION ALL SELECT 'RDS-II', {r6('SUM(y * 1.0 / network_size) / SUM(1.0 / network_size)')} FROM rds
UNION ALL SELECT 'SS', {r6(f'SUM({_SS_W} * y) / SUM({_SS_W})')} FROM rds, rate""")
def _(v):
    return R.compare(v.rds, size_of(v))


@query("k19_estimator_comparison_timed")
def _(v):
    return R.compare(v.rds, size_of(v), timed=True)


_PRESENT = {
    "population size unknown": "FALSE",
    "large sampling fraction": "n > 0.5 * 2 * n",
    "short waves": "wave < 4",
    "recruitment time unknown": "FALSE",
    "high homophily": "hom > 1.5",
    "seed dependence": "sd > 0.1",
    "high differential activity": "act > 1.5 OR act < 1 / 1.5",
    "continuous outcome": "FALSE",
}


@query("k20_suitability", " UNION ALL ".join(
    f"SELECT '{c}' AS condition, '{e}' AS estimator, {_PRESENT[c]} AS present, CASE WHEN {_PRESENT[c]} THEN '{w}' ELSE 'ok' END AS verdict FROM study"
    for c, ws in R.SUITABILITY.items() for e, w in zip(R.ESTIMATORS, ws)),
    {"study": """
SELECT COUNT(*) AS n, MAX(wave) AS wave, AVG(CASE WHEN y = 1 THEN network_size END) / AVG(CASE WHEN y = 0 THEN network_size END) AS act,
 (SELECT (r00 + r11) / (((r00 + r01) * (r00 + r10) + (r10 + r11) * (r01 + r11)) / (r00 + r01 + r10 + r11)) FROM two) AS hom,
 (SELECT MAX(ABS(ss - sh)) FROM (SELECT COUNT(*) FILTER (recruiter_id IS NULL) * 1.0 / SUM(COUNT(*) FILTER (recruiter_id IS NULL)) OVER () AS ss,
   SUM(1.0 / network_size) / SUM(SUM(1.0 / network_size)) OVER () AS sh FROM rds GROUP BY y) q) AS sd FROM waves"""})
def _(v):
    return R.suitability(v.rds, size_of(v))
