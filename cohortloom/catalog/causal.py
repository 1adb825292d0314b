"""Effect measures, confounding, unmeasured confounding and causal graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import dag as G
from ..operators import effects as E
from ..operators import evalue as V
from ..plans import confounding as P
from .prelude import big, r6
from .registry import query

Z = "1.959963984540054"
_CELLS = (
    "CAST(COUNT(*) FILTER (x = 1 AND y = 1) AS DOUBLE) AS a, CAST(COUNT(*) FILTER (x = 1 AND y = 0) AS DOUBLE) AS b,"
    " CAST(COUNT(*) FILTER (x = 0 AND y = 1) AS DOUBLE) AS cc, CAST(COUNT(*) FILTER (x = 0 AND y = 0) AS DOUBLE) AS d"
)


def inv(x: str) -> str:
    return f"1 / NULLIF({x}, 0)"


_R1, _R0 = "(a / NULLIF(a + b, 0))", "(cc / NULLIF(cc + d, 0))"
_RR = f"({_R1} / NULLIF({_R0}, 0))"
_OR = "(a * d / NULLIF(b * cc, 0))"
_SE_RR = f"SQRT({inv('a')} - {inv('(a + b)')} + {inv('cc')} - {inv('(cc + d)')})"
_SE_OR = f"SQRT({inv('a')} + {inv('b')} + {inv('cc')} + {inv('d')})"
_SE_RD = f"SQRT({_R1} * (1 - {_R1}) / NULLIF(a + b, 0) + {_R0} * (1 - {_R0}) / NULLIF(cc + d, 0))"
_RISK = {
    "risk1": _R1,
    "risk0": _R0,
    "rr": _RR,
    "rr_low": f"{_RR} * EXP(-{Z} * {_SE_RR})",
    "rr_high": f"{_RR} * EXP({Z} * {_SE_RR})",
    "odds_ratio": _OR,
    "or_low": f"{_OR} * EXP(-{Z} * {_SE_OR})",
    "or_high": f"{_OR} * EXP({Z} * {_SE_OR})",
    "rd": f"({_R1} - {_R0})",
    "rd_low": f"{_R1} - {_R0} - {Z} * {_SE_RD}",
    "rd_high": f"{_R1} - {_R0} + {Z} * {_SE_RD}",
}
_RISK_SQL = ", ".join(f"{r6(x)} AS {k}" for k, x in _RISK.items())


# ---- L. effect measures


@query("l1_crude_measures", f"""
SELECT {big('a')} AS n11, {big('b')} AS n10, {big('cc')} AS n01, {big('d')} AS n00, {_RISK_SQL} FROM (SELECT {_CELLS} FROM effects) q""")
def _(v):
    return E.measures(v.effects, [])


@query("l2_stratum_measures", f"SELECT u, {_RISK_SQL} FROM (SELECT u, {_CELLS} FROM effects GROUP BY 1) q")
def _(v):
    return E.measures(v.effects, ["u"]).select("u", *_RISK)


_N = "NULLIF(a + b + cc + d, 0)"
_RR_MH = f"SUM(a * (cc + d) / {_N}) / NULLIF(SUM(cc * (a + b) / {_N}), 0)"
_OR_MH = f"SUM(a * d / {_N}) / NULLIF(SUM(b * cc / {_N}), 0)"


@query("l3_mantel_haenszel", f"SELECT {r6(_RR_MH)} AS rr_adj, {r6(_OR_MH)} AS or_adj, {big('COUNT(*)')} AS n_strata FROM (SELECT c, {_CELLS} FROM effects GROUP BY 1) q")
def _(v):
    return E.mantel_haenszel(v.effects, "c").select("rr_adj", "or_adj", "n_strata")


_SIDE = "(CASE WHEN {0} > 1.05 THEN 1 WHEN {0} < 1 / 1.05 THEN -1 ELSE 0 END)"


def _pattern(crude: str, low: str, high: str) -> str:
    between = f"({low} < {crude} AND {crude} < {high})"
    mean = f"SQRT({low} * {high})"
    qual = f"({_SIDE.format(low)} <> {_SIDE.format(high)} OR {_SIDE.format(low)} = 0)"
    return (
        f"CASE WHEN {crude} IS NULL OR {low} IS NULL OR {high} IS NULL THEN NULL WHEN {low} <= 0 OR {crude} <= 0 THEN 'undefined'"
        f" WHEN {between} AND NOT {high} / {low} <= 1.5 AND {qual} THEN 'qualitative interaction'"
        f" WHEN {between} AND NOT {high} / {low} <= 1.5 THEN 'quantitative interaction'"
        f" WHEN {between} OR {low} = {crude} OR {high} = {crude} THEN 'no clear change'"
        f" WHEN NOT {high} / {low} <= 1.5 OR {_SIDE.format(low)} * {_SIDE.format(high)} < 0 THEN 'leans to confounding'"
        f" WHEN ({mean} - 1) * ({crude} - 1) < 0 THEN 'qualitative confounding'"
        f" WHEN ABS(LN({mean})) < ABS(LN({crude})) THEN 'positive confounding' ELSE 'negative confounding' END"
    )


def _screen(covariates: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS covariate, CAST({c} AS VARCHAR) AS level, x, y FROM effects" for c in covariates)
    rr = "(SUM(a) / (SUM(a) + SUM(b))) / (SUM(cc) / (SUM(cc) + SUM(d)))"
    return f"""
SELECT covariate, {_RR_MH} AS rr_adj, {_OR_MH} AS or_adj, {rr} AS rr_crude, MIN({_RR}) AS rr_min, MAX({_RR}) AS rr_max, COUNT(*) AS n_strata
FROM (SELECT covariate, level, {_CELLS} FROM ({long}) u WHERE level IS NOT NULL GROUP BY 1, 2) q GROUP BY 1"""


@query("l4_confounding_class", f"""
SELECT covariate, {r6('rr_crude')} AS rr_crude, {r6('rr_min')} AS rr_min, {r6('rr_max')} AS rr_max, {_pattern('rr_crude', 'rr_min', 'rr_max')} AS pattern FROM ({_screen(['c', 'u'])}) s""")
def _(v):
    return E.screen_covariates(v.effects, ["c", "u"]).select(
        "covariate", "rr_crude", "rr_min", "rr_max", "pattern"
    )


@query("l5_interaction_class", f"""
SELECT covariate, {r6('rr_crude')} AS rr_crude, {r6('rr_min')} AS rr_min, {r6('rr_max')} AS rr_max, {_pattern('rr_crude', 'rr_min', 'rr_max')} AS pattern FROM ({_screen(['z'])}) s""")
def _(v):
    return E.screen_covariates(v.effects, ["z"]).select(
        "covariate", "rr_crude", "rr_min", "rr_max", "pattern"
    )


@query("l6_screen_covariates", f"""
SELECT covariate, {big('n_strata')} AS n_strata, {', '.join(f'{r6(c)} AS {c}' for c in ('rr_adj', 'or_adj', 'rr_crude', 'rr_min', 'rr_max'))}, {_pattern('rr_crude', 'rr_min', 'rr_max')} AS pattern FROM ({_screen(['z', 'u', 'c'])}) s""")
def _(v):
    return E.screen_covariates(v.effects, ["z", "u", "c"])


@query("l6_covariate_association", f"""
SELECT covariate, level, {r6('(a + b) / NULLIF(a + b + cc + d, 0)')} AS p_exposed, {r6(_R0)} AS risk_unexposed FROM (
 SELECT covariate, level, {_CELLS} FROM (SELECT 'z' AS covariate, CAST(z AS VARCHAR) AS level, x, y FROM effects UNION ALL SELECT 'u', u, x, y FROM effects) w GROUP BY 1, 2) q""")
def _(v):
    return E.covariate_association(v.effects, ["z", "u"])


# a Newton step written out: sums, a Cholesky factor of the curvature, forward and back substitution
_T = ["1", "x", "z", "x * z"]
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def _factor() -> list[str]:
    """Lower factor l and its inverse m of the curvature h, one column after the other."""
    out = []
    for i, j in _PAIRS:
        less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append(f"SQRT(h{i}{i}{less}) AS l{i}{i}" if i == j else f"(h{i}{j}{less}) / l{j}{j} AS l{i}{j}")
    for i, j in _PAIRS:
        if i == j:
            out.append(f"1 / l{i}{i} AS m{i}{i}")
        else:
            out.append("-(" + " + ".join(f"l{i}{k} * m{k}{j}" for k in range(j, i)) + f") / l{i}{i} AS m{i}{j}")
    # the order of the list is that of need: all m of a column from its diagonal down
    return out


_INVERSE = {
    (i, j): "(" + " + ".join(f"m{k}{i} * m{k}{j}" for k in range(max(i, j), 4)) + ")" for i in range(4) for j in range(4)
}
_ETA = "b0 + b1 * x + b2 * z + b3 * x * z"
_STEP = f"""
SELECT it + 1 AS it, {', '.join(f"b{i} + {' + '.join(f'{_INVERSE[i, j]} * g{j}' for j in range(4))} AS b{i}" for i in range(4))},
  {', '.join(f'SQRT({_INVERSE[i, i]}) AS s{i}' for i in range(4))}
FROM (SELECT *, {', '.join(_factor())} FROM (
  SELECT it, b0, b1, b2, b3, {', '.join(f'SUM((yes - n * p) * ({t})) AS g{i}' for i, t in enumerate(_T))},
    {', '.join(f'SUM(n * p * (1 - p) * ({_T[i]}) * ({_T[j]})) AS h{i}{j}' for i, j in _PAIRS)}
  FROM (SELECT *, 1 / (1 + EXP(-({_ETA}))) AS p FROM newton, counted) a GROUP BY it, b0, b1, b2, b3) b) c WHERE it < 12"""
# 2 (1 - Phi(|t|)) through the series of the error function, all of whose terms are positive
_TAIL = """
CASE WHEN ABS(b / s) > 8 THEN 0 WHEN b = 0 THEN 1 ELSE 1 - 2 / SQRT(PI()) * EXP(-b * b / s / s / 2) * LIST_SUM(LIST_TRANSFORM(RANGE(0, 200),
  lambda k: EXP(2 * k * LN(2) + (2 * k + 1) * LN(ABS(b / s) / SQRT(2)) - LGAMMA(2 * k + 2) + LGAMMA(k + 1)))) END"""
_NEWTON = {
    "counted": """
SELECT x, z, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(y) AS DOUBLE) AS yes FROM (
 SELECT CAST(x AS DOUBLE) AS x, y, (z_cont - AVG(z_cont) OVER ()) / STDDEV_SAMP(z_cont) OVER () AS z FROM effects WHERE z_cont IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL) q GROUP BY 1, 2""",
    "newton": "SELECT 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS s3 UNION ALL " + _STEP,
    "settled": "SELECT UNNEST(['intercept', 'x', 'z', 'xz']) AS term, UNNEST([b0, b1, b2, b3]) AS b, UNNEST([s0, s1, s2, s3]) AS s FROM newton WHERE it = 12",
}


@query("l7_interaction_model", f"""
SELECT term, {r6('b')} AS estimate, {r6('s')} AS std_error, {r6(_TAIL)} AS p_value, TRUE AS converged FROM settled""", _NEWTON)
def _(v):
    return E.interaction_model(v.effects, "z_cont")


# ---- M. unmeasured confounding


@query("m1_observed_rr", f"SELECT c, {r6(_RR)} AS rr_obs FROM (SELECT c, {_CELLS} FROM effects GROUP BY 1) q")
def _(v):
    return V.observed_rr(v.effects, "c")


_EU = {
    "eu": """
SELECT k.c, MAX(((a + b) / NULLIF(n1, 0)) / NULLIF((cc + d) / NULLIF(n0, 0), 0)) AS rr_eu FROM cells k JOIN (SELECT c, SUM(a + b) AS n1, SUM(cc + d) AS n0 FROM cells GROUP BY 1) t ON k.c = t.c GROUP BY 1""",
    "ud": f"""
SELECT c, GREATEST(MAX({_R1}) / NULLIF(MIN({_R1}), 0), MAX({_R0}) / NULLIF(MIN({_R0}), 0)) AS rr_ud FROM cells GROUP BY 1""",
    "std": f"""
SELECT c, CASE WHEN COUNT(*) = COUNT({_R1}) AND COUNT(*) = COUNT({_R0}) THEN SUM({_R1} * (a + b + cc + d)) / NULLIF(SUM({_R0} * (a + b + cc + d)), 0) END AS rr_true FROM cells GROUP BY 1""",
    "obs": f"SELECT c, {_RISK['rr']} AS rr, {_RISK['rr_low']} AS rr_low, {_RISK['rr_high']} AS rr_high FROM (SELECT c, {_CELLS} FROM effects GROUP BY 1) q",
}


@query("m2_exposure_confounder_rr", f"SELECT c, {r6('rr_eu')} AS rr_eu FROM eu", _EU)
def _(v):
    return V.exposure_confounder_rr(v.effects, "c", "u")


@query("m3_confounder_outcome_rr", f"SELECT c, {r6('rr_ud')} AS rr_ud FROM ud", _EU)
def _(v):
    return V.confounder_outcome_rr(v.effects, "c", "u")


@query("m4_standardised_rr", f"SELECT c, {r6('rr_true')} AS rr_true FROM std", _EU)
def _(v):
    return V.standardised_rr(v.effects, "c", "u")


_BOUND = "(rr_ud * rr_eu / NULLIF(rr_ud + rr_eu - 1, 0))"
_JOINED = "eu JOIN ud ON eu.c = ud.c JOIN std ON eu.c = std.c JOIN obs ON eu.c = obs.c"


@query("m5_bounding_factor", f"SELECT eu.c AS c, {r6('rr_ud')} AS rr_ud, {r6('rr_eu')} AS rr_eu, {r6(_BOUND)} AS bound FROM {_JOINED}", _EU)
def _(v):
    return V.bias_analysis(v.effects, "c", "u").select("c", "rr_ud", "rr_eu", "bound")


def _corrected(x: str) -> str:
    return f"CASE WHEN rr >= 1 THEN {x} / {_BOUND} WHEN rr < 1 THEN {x} * {_BOUND} END"


@query("m6_bias_corrected", f"""
SELECT eu.c AS c, {', '.join(f'{r6(_corrected(x))} AS {x}_corrected' for x in ('rr', 'rr_low', 'rr_high'))} FROM {_JOINED}""", _EU)
def _(v):
    return V.bias_analysis(v.effects, "c", "u").select(
        "c", "rr_corrected", "rr_low_corrected", "rr_high_corrected"
    )


def _ev(x: str) -> str:
    up = f"(CASE WHEN {x} >= 1 THEN {x} WHEN {x} > 0 THEN 1 / {x} END)"
    return f"({up} + SQRT({up} * ({up} - 1)))"


_LIMIT = f"CASE WHEN rr >= 1 THEN CASE WHEN rr_low <= 1 THEN 1.0 ELSE {_ev('rr_low')} END WHEN rr < 1 THEN CASE WHEN rr_high >= 1 THEN 1.0 ELSE {_ev('rr_high')} END END"


@query("m7_e_value_point", f"SELECT c, {r6(_ev('rr'))} AS e_value FROM obs", _EU)
def _(v):
    rr = V.observed_rr(v.effects, "c")
    return rr.select("c", M.e_value(F.col("rr_obs")).alias("e_value"))


@query("m8_e_value_limit", f"SELECT c, {r6(_LIMIT)} AS e_value_limit FROM obs", _EU)
def _(v):
    strata = E.measures(v.effects, ["c"])
    limit = M.e_value_limit(F.col("rr"), F.col("rr_low"), F.col("rr_high"))
    return strata.select("c", limit.alias("e_value_limit"))


_KINDS = {
    "or_rare": "est",
    "or_common": "SQRT(est)",
    "hr_common": "(1 - POW(0.5, SQRT(est))) / (1 - POW(0.5, 1 / SQRT(est)))",
    "smd": "EXP(0.91 * est)",
}


@query("m9_other_measures", " UNION ALL ".join(
    f"SELECT c, '{k}' AS kind, {r6(x)} AS rr_estimate, {r6(_ev(f'({x})'))} AS e_value FROM (SELECT c, {'LN' if k == 'smd' else ''}({_OR}) AS est FROM (SELECT c, {_CELLS} FROM effects GROUP BY 1) q) w"
    for k, x in _KINDS.items()))
def _(v):
    strata = E.measures(v.effects, ["c"]).select("c", "odds_ratio")
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    rows = strata.select("c", "odds_ratio", F.explode(kinds).alias("kind")).withColumn(
        "estimate", F.when(F.col("kind") == "smd", F.log("odds_ratio")).otherwise(F.col("odds_ratio"))
    )
    rows = rows.withColumns({"low": F.col("estimate"), "high": F.col("estimate")})
    return V.with_e_values(rows).select("c", "kind", "rr_estimate", "e_value")


@query("m10_contour", f"""
SELECT c, step, {r6('up + step * 0.5')} AS rr_eu, {r6('up * (up + step * 0.5 - 1) / (step * 0.5)')} AS rr_ud FROM (
 SELECT c, CASE WHEN rr >= 1 THEN rr WHEN rr > 0 THEN 1 / rr END AS up FROM obs) o, (SELECT CAST(UNNEST(RANGE(1, 41)) AS INTEGER) AS step) g WHERE up IS NOT NULL""", _EU)
def _(v):
    rr = V.observed_rr(v.effects, "c").withColumnRenamed("rr_obs", "rr")
    return V.contour(rr).select("c", "step", "rr_eu", "rr_ud")


@query("m11_batch_e_values", f"""
SELECT c, {r6('rr')} AS estimate, {r6('rr_low')} AS low, {r6('rr_high')} AS high, {r6(_ev('rr'))} AS e_value, {r6(_LIMIT)} AS e_value_limit FROM obs WHERE rr > 0""", _EU)
def _(v):
    return P.stratum_e_values(v.effects, "c").select(
        "c", "estimate", "low", "high", "e_value", "e_value_limit"
    )


# ---- N. causal graphs


@query("n1_parents_children", """
SELECT DISTINCT graph_id, src AS node, 'child' AS relation, dst AS other FROM dag_edges UNION SELECT graph_id, dst, 'parent', src FROM dag_edges""")
def _(v):
    return G.neighbours(v.dag_edges)


@query("n2_ancestors_descendants", "SELECT graph_id, src AS ancestor, dst AS descendant FROM reach")
def _(v):
    return G.closure(v.dag_edges).select(
        "graph_id", F.col("src").alias("ancestor"), F.col("dst").alias("descendant")
    )


@query("n2_of_asked_nodes", "SELECT graph_id, src AS ancestor, dst AS descendant FROM reach WHERE src IN (3, 15) OR dst IN (3, 15)")
def _(v):
    asked = v.dag_edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).where("node IN (3, 15)")
    return G.closure(v.dag_edges, asked).select(
        "graph_id", F.col("src").alias("ancestor"), F.col("dst").alias("descendant")
    )


_LOOPED = {
    "looped": "SELECT graph_id, src, dst FROM dag_edges UNION SELECT graph_id, dst, src FROM dag_edges WHERE graph_id % 5 = 0 AND src = 1 AND dst = 3",
    "paths": "SELECT graph_id, src, dst FROM looped UNION SELECT p.graph_id, p.src, e.dst FROM paths p JOIN looped e ON p.graph_id = e.graph_id AND p.dst = e.src",
}


@query("n3_acyclicity", f"""
SELECT e.graph_id, {big('COUNT(*)')} AS n_edges, e.graph_id NOT IN (SELECT graph_id FROM paths WHERE src = dst) AS acyclic FROM looped e GROUP BY 1""", _LOOPED)
def _(v):
    back = v.dag_edges.where("graph_id % 5 = 0 AND src = 1 AND dst = 3").select(
        "graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")
    )
    return G.acyclicity(v.dag_edges.unionByName(back).distinct())


# exposure 3, outcome 15 in every graph that has both
_ROLE = {
    "questions": "SELECT graph_id FROM dag_edges GROUP BY 1 HAVING MAX(CASE WHEN src = 3 OR dst = 3 THEN 1 ELSE 0 END) = 1 AND MAX(CASE WHEN dst = 15 THEN 1 ELSE 0 END) = 1",
    "nodes": "SELECT graph_id, src AS node FROM dag_edges WHERE graph_id IN (SELECT graph_id FROM questions) UNION SELECT graph_id, dst FROM dag_edges WHERE graph_id IN (SELECT graph_id FROM questions)",
    "offx": "SELECT graph_id, src, dst FROM dag_edges WHERE src <> 3 AND dst <> 3 UNION SELECT p.graph_id, p.src, e.dst FROM offx p JOIN dag_edges e ON p.graph_id = e.graph_id AND p.dst = e.src WHERE e.dst <> 3",
    "flagged": """
SELECT n.graph_id, n.node, EXISTS (SELECT 1 FROM reach r WHERE r.graph_id = n.graph_id AND r.src = n.node AND r.dst = 3) AS ax,
 EXISTS (SELECT 1 FROM reach r WHERE r.graph_id = n.graph_id AND r.src = n.node AND r.dst = 15) AS ay,
 EXISTS (SELECT 1 FROM offx r WHERE r.graph_id = n.graph_id AND r.src = n.node AND r.dst = 15) AS ao,
 EXISTS (SELECT 1 FROM reach r WHERE r.graph_id = n.graph_id AND r.src = 3 AND r.dst = n.node) AS dx FROM nodes n""",
    "roles": """
SELECT f.graph_id, f.node, CASE WHEN node = 3 THEN 'exposure' WHEN node = 15 THEN 'outcome' WHEN ax AND ao THEN 'confounder' WHEN dx AND ay THEN 'mediator'
 WHEN ay AND NOT ax AND EXISTS (SELECT 1 FROM flagged c JOIN offx r ON c.graph_id = r.graph_id AND c.node = r.src WHERE c.graph_id = f.graph_id AND r.dst = f.node AND c.ax AND c.ao AND c.node NOT IN (3, 15)) THEN 'proxy confounder'
 WHEN ao THEN 'competing exposure' ELSE 'other' END AS role FROM flagged f""",
}


def _questions(v):
    nodes = v.dag_edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"), "dst")
    return (
        nodes.groupBy("graph_id")
        .agg(F.max(F.col("node") == 3).alias("x"), F.max(F.col("dst") == 15).alias("y"))
        .where("x AND y")
        .select("graph_id", F.lit(3).cast("long").alias("exposure"), F.lit(15).cast("long").alias("outcome"))
    )


@query("n4_variable_roles", "SELECT graph_id, node, role FROM roles", _ROLE)
def _(v):
    return G.variable_roles(v.dag_edges, _questions(v))


@query("n5_role_report", """
SELECT r.graph_id, r.node, r.role, l.label FROM roles r LEFT JOIN (SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT) AS graph_id, p_partkey % 20 AS node, p_name AS label FROM part) l
ON r.graph_id = l.graph_id AND r.node = l.node""", _ROLE)
def _(v):
    labels = v.table("part").selectExpr(
        "p_partkey DIV 20 AS graph_id", "p_partkey % 20 AS node", "p_name AS label"
    )
    return G.role_report(G.variable_roles(v.dag_edges, _questions(v)), labels)


@query("q_screened_effects", f"""
SELECT covariate, {big('n_strata')} AS n_strata, {', '.join(f'{r6(c)} AS {c}' for c in ('rr_crude', 'rr_adj', 'rr_min', 'rr_max'))}, {_pattern('rr_crude', 'rr_min', 'rr_max')} AS pattern,
  {r6(_ev('rr_adj'))} AS e_value FROM ({_screen(['z', 'u', 'c'])}) s""")
def _(v):
    return P.screened_effects(v.effects, ["z", "u", "c"])
