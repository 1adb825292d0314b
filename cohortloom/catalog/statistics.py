"""Validation statistics, descriptive tables and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe as D
from ..operators import labs as L
from ..operators import quality as Q
from ..operators import validate as V
from ..plans import toxicity as P
from .prelude import ICD_CONDITIONS, big, r6
from .registry import SETTINGS, query, sources

KEYS = "subset, condition, test, against"
Z = "1.959963984540054"


def counts(v):
    table = P.validation_table(sources(v), SETTINGS)
    return V.pair_counts(table, V.standard_pairs(P.VALIDATED), P.subsets(SETTINGS))


# ---- I. validation and agreement


@query("i1_confusion_label", """
SELECT studyid, CASE WHEN anemia_g2_lab = 1 AND anemia_tox = 1 THEN 'TP' WHEN anemia_g2_lab = 1 THEN 'FP' WHEN anemia_tox = 1 THEN 'FN' ELSE 'TN' END AS lab_label,
  CASE WHEN anemia_flag_icd = 1 AND anemia_tox = 1 THEN 'TP' WHEN anemia_flag_icd = 1 THEN 'FP' WHEN anemia_tox = 1 THEN 'FN' ELSE 'TN' END AS icd_label FROM val""")
def _(v):
    table, ref = P.validation_table(sources(v), SETTINGS), F.col("anemia_tox")
    return table.select(
        "studyid",
        V.confusion_label(F.col("anemia_g2_lab"), ref).alias("lab_label"),
        V.confusion_label(F.col("anemia_flag_icd"), ref).alias("icd_label"),
    )


@query("i2_confusion_counts", f"SELECT {KEYS}, tp, fp, fn, tn FROM vcount")
def _(v):
    return counts(v)


_SE, _SP = "(tp / NULLIF(tp + fn, 0))", "(tn / NULLIF(tn + fp, 0))"
_ACC = {
    "sensitivity": _SE,
    "specificity": _SP,
    "ppv": "tp / NULLIF(tp + fp, 0)",
    "npv": "tn / NULLIF(tn + fn, 0)",
    "apparent_prev": "(tp + fp) / NULLIF(tp + fp + fn + tn, 0)",
    "true_prev": "(tp + fn) / NULLIF(tp + fp + fn + tn, 0)",
    "accuracy": "(tp + tn) / NULLIF(tp + fp + fn + tn, 0)",
    "youden": f"{_SE} + {_SP} - 1",
    "dor": "tp * tn / NULLIF(fp * fn, 0)",
    "lr_pos": f"{_SE} / NULLIF(1 - {_SP}, 0)",
    "lr_neg": f"(1 - {_SE}) / NULLIF({_SP}, 0)",
    "nnd": f"1 / NULLIF({_SE} + {_SP} - 1, 0)",
}
_D = "SELECT subset, condition, test, against, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn FROM vcount"


@query("i3_diagnostic_accuracy", f"SELECT {KEYS}, {', '.join(f'{r6(x)} AS {k}' for k, x in _ACC.items())} FROM ({_D}) q")
def _(v):
    return V.with_accuracy(counts(v)).select(*KEYS.split(", "), *_ACC)


def _wilson(name: str, k: str, n: str) -> str:
    n = f"NULLIF({n}, 0)"
    p = f"({k}) / {n}"
    scale = f"(1 + {Z} * {Z} / {n})"
    half = f"{Z} * SQRT({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n} * {n})) / {scale}"
    centre = f"({p} + {Z} * {Z} / (2 * {n})) / {scale}"
    low = f"CASE WHEN {n} IS NOT NULL THEN GREATEST({centre} - {half}, 0) ELSE 0 END"
    high = f"CASE WHEN {n} IS NOT NULL THEN LEAST({centre} + {half}, 1) ELSE 1 END"
    return f"{r6(low)} AS {name}_low, {r6(high)} AS {name}_high"


_ENDS = {
    "sensitivity": ("tp", "tp + fn"),
    "specificity": ("tn", "tn + fp"),
    "ppv": ("tp", "tp + fp"),
    "npv": ("tn", "tn + fn"),
    "accuracy": ("tp + tn", "(tp + fp + fn + tn)"),
}


def _ratio_interval(name: str, est: str, a: str, b: str) -> str:
    var = f"1 / NULLIF({a}, 0) - 1 / NULLIF(tp + fn, 0) + 1 / NULLIF({b}, 0) - 1 / NULLIF(fp + tn, 0)"
    half = f"{Z} * SQRT(CASE WHEN {var} >= 0 THEN {var} END)"
    return f"{r6(f'{est} * EXP(-({half}))')} AS {name}_low, {r6(f'{est} * EXP({half})')} AS {name}_high"


@query("i4_wilson_intervals", f"""
SELECT {KEYS}, {', '.join(_wilson(k, *e) for k, e in _ENDS.items())},
  {_ratio_interval('lr_pos', _ACC['lr_pos'], 'tp', 'fp')}, {_ratio_interval('lr_neg', _ACC['lr_neg'], 'fn', 'tn')} FROM ({_D}) q""")
def _(v):
    names = [*_ENDS, "lr_pos", "lr_neg"]
    return V.with_accuracy(counts(v)).select(
        *KEYS.split(", "), *[f"{k}_{side}" for k in names for side in ("low", "high")]
    )


# Clopper-Pearson limits by halving an interval: the binomial tail beyond the count is summed term by term
_BINOMIAL = "EXP(LGAMMA(n + 1) - LGAMMA(j + 1) - LGAMMA(n - j + 1) + j * LN((lo + hi) / 2) + (n - j) * LN(1 - (lo + hi) / 2))"
_ABOVE = f"LIST_SUM(LIST_TRANSFORM(RANGE(k, n + 1), lambda j: {_BINOMIAL}))"
_BELOW = f"LIST_SUM(LIST_TRANSFORM(RANGE(0, k + 1), lambda j: {_BINOMIAL}))"
_RAISE = f"CASE WHEN side = 'low' THEN {_ABOVE} < 0.025 ELSE {_BELOW} > 0.025 END"
_EXACT = {
    "asked": f"""
SELECT {KEYS}, UNNEST([{', '.join(f"'{m}'" for m in _ENDS)}]) AS share, UNNEST([{', '.join(big(k) for k, _ in _ENDS.values())}]) AS k,
  UNNEST([{', '.join(big(n) for _, n in _ENDS.values())}]) AS n FROM ({_D}) q""",
    "limits": f"""
SELECT {KEYS}, share, side, k, n, 0 AS it, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM asked, (VALUES ('low'), ('high')) s(side) WHERE n > 0 AND CASE side WHEN 'low' THEN k > 0 ELSE k < n END
UNION ALL SELECT {KEYS}, share, side, k, n, it + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END
FROM (SELECT *, {_RAISE} AS up FROM limits WHERE it < 45) w""",
    "limited": f"""
SELECT {KEYS}, share, MAX(lo) FILTER (side = 'low') AS low, MAX(lo) FILTER (side = 'high') AS high FROM limits WHERE it = 45 GROUP BY {KEYS}, share""",
}


def _exact(name: str) -> str:
    low, high = "CASE WHEN n > 0 THEN COALESCE(low, 0) END", "CASE WHEN n > 0 THEN COALESCE(high, 1) END"
    return ", ".join(f"{r6(f'MAX({x}) FILTER (a.share = {chr(39)}{name}{chr(39)})')} AS {name}_{s}" for s, x in (("low", low), ("high", high)))


@query("i4_exact_intervals", f"""
SELECT {', '.join('a.' + k for k in KEYS.split(', '))}, {', '.join(map(_exact, _ENDS))} FROM asked a LEFT JOIN limited b
ON a.subset = b.subset AND a.condition = b.condition AND a.test = b.test AND a.against = b.against AND a.share = b.share
GROUP BY {', '.join('a.' + k for k in KEYS.split(', '))}""", _EXACT)
def _(v):
    exact = V.with_accuracy(counts(v), interval="exact")
    return exact.select(*KEYS.split(", "), *[f"{k}_{s}" for k in _ENDS for s in ("low", "high")])


_P = "((tp + tn) / NULLIF(tp + fp + fn + tn, 0))"


@query("i5_percent_agreement", f"SELECT {KEYS}, {r6(f'100 * {_P}')} AS agree_pct FROM ({_D}) q")
def _(v):
    out = V.with_agreement(counts(v))
    return out.select(*KEYS.split(", "), "agree_pct")


_HALF = f"1.96 * SQRT({_P} * (1 - {_P}) / NULLIF(tp + fp + fn + tn, 0))"


@query("i6_agreement_interval", f"""
SELECT {KEYS}, {r6(f'100 * ({_P} - {_HALF})')} AS agree_low, {r6(f'100 * ({_P} + {_HALF})')} AS agree_high FROM ({_D}) q""")
def _(v):
    return V.with_agreement(counts(v)).select(*KEYS.split(", "), "agree_low", "agree_high")


_KAPPA_CTE = f"""
SELECT {KEYS}, n, po, a1 * b1 + (1 - a1) * (1 - b1) AS pe, a1 * b1 * (a1 + b1) + (1 - a1) * (1 - b1) * (2 - a1 - b1) AS crs FROM (
 SELECT {KEYS}, tp + fp + fn + tn AS n, (tp + tn) / NULLIF(tp + fp + fn + tn, 0) AS po, (tp + fp) / NULLIF(tp + fp + fn + tn, 0) AS a1, (tp + fn) / NULLIF(tp + fp + fn + tn, 0) AS b1 FROM ({_D}) q) w"""
_K = "((po - pe) / NULLIF(1 - pe, 0))"
_SE0 = "(SQRT(GREATEST(pe + pe * pe - crs, 0)) / NULLIF((1 - pe) * SQRT(n), 0))"


@query("i7_kappa", f"SELECT {KEYS}, {r6(_K)} AS kappa FROM ({_KAPPA_CTE}) k")
def _(v):
    return V.with_agreement(counts(v)).select(*KEYS.split(", "), "kappa")


@query("i7_kappa_many_categories", f"""
SELECT time_frame, {big('n')} AS n, {r6('100 * po')} AS agree_pct, {r6('100 * (po - 1.96 * SQRT(po * (1 - po) / n))')} AS agree_low, {r6('100 * (po + 1.96 * SQRT(po * (1 - po) / n))')} AS agree_high,
  {r6(_K)} AS kappa, {r6(_SE0)} AS kappa_se0, {r6(f'{_K} / NULLIF({_SE0}, 0)')} AS kappa_z, {r6(f'{_K} - {Z} * {_SE0}')} AS kappa_low, {r6(f'{_K} + {Z} * {_SE0}')} AS kappa_high
FROM (SELECT time_frame, n, hit / n AS po, pe / (n * n) AS pe, crs / (n * n * n) AS crs FROM (
  SELECT time_frame, CAST(SUM(ca) AS DOUBLE) AS n, CAST(SUM(hit) AS DOUBLE) AS hit, CAST(SUM(ca * cb) AS DOUBLE) AS pe, CAST(SUM(ca * cb * (ca + cb)) AS DOUBLE) AS crs FROM (
   SELECT time_frame, cat, SUM(ca) AS ca, SUM(cb) AS cb, SUM(hit) AS hit FROM (
    SELECT time_frame, ga AS cat, 1 AS ca, 0 AS cb, CASE WHEN ga = gb THEN 1 ELSE 0 END AS hit FROM graded
    UNION ALL SELECT time_frame, gb, 0, 1, 0 FROM graded) u GROUP BY 1, 2) m GROUP BY 1) t) k""",
    {"graded": """SELECT time_frame, anemia_g1_lab + anemia_g2_lab + anemia_g3_lab AS ga, thrombocytopenia_g1_lab + thrombocytopenia_g2_lab + thrombocytopenia_g3_lab AS gb
FROM labpf WHERE anemia_lab_rows > 0 AND thrombocytopenia_lab_rows > 0"""})
def _(v):
    flags = P.lab_person_flags(sources(v))
    grade = lambda c: sum((F.col(f"{c}_g{g}_lab") for g in (2, 3)), F.col(f"{c}_g1_lab"))
    rated = flags.select(
        "time_frame", grade("anemia").alias("ga"), grade("thrombocytopenia").alias("gb")
    )
    return V.kappa_table(rated, "ga", "gb", ["time_frame"])


_KAPPA_COLS = (
    f"{r6(_K)} AS kappa, {r6(_SE0)} AS kappa_se0, {r6(f'{_K} / NULLIF({_SE0}, 0)')} AS kappa_z,"
    f" {r6(f'{_K} - {Z} * {_SE0}')} AS kappa_low, {r6(f'{_K} + {Z} * {_SE0}')} AS kappa_high"
)


@query("i8_kappa_interval", f"SELECT {KEYS}, {_KAPPA_COLS} FROM ({_KAPPA_CTE}) k")
def _(v):
    cols = ["kappa", "kappa_se0", "kappa_z", "kappa_low", "kappa_high"]
    return V.with_agreement(counts(v)).select(*KEYS.split(", "), *cols)


@query("i9_sensitivity_subsets", f"""
SELECT {KEYS}, tp, fp, fn, tn, {r6('tp / NULLIF(CAST(tp + fn AS DOUBLE), 0)')} AS sensitivity, {r6('tn / NULLIF(CAST(tn + fp AS DOUBLE), 0)')} AS specificity FROM vcount WHERE subset <> 'all'""")
def _(v):
    out = V.with_accuracy(counts(v)).where("subset <> 'all'")
    return out.select(*KEYS.split(", "), "tp", "fp", "fn", "tn", "sensitivity", "specificity")


_BATCH = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "youden", "dor"]


@query("i10_batch_validation", f"""
SELECT a.subset, a.condition, a.test, a.against, {', '.join(f'{big(c)} AS {c}' for c in ('tp', 'fp', 'fn', 'tn'))},
  {', '.join(f'{r6(_ACC[k])} AS {k}' for k in _BATCH)}, {r6(f'100 * {_P}')} AS agree_pct, {_KAPPA_COLS}
FROM ({_D}) a JOIN ({_KAPPA_CTE}) k ON a.subset = k.subset AND a.condition = k.condition AND a.test = k.test AND a.against = k.against""")
def _(v):
    out = P.validation_results(sources(v), SETTINGS)
    cols = ["kappa", "kappa_se0", "kappa_z", "kappa_low", "kappa_high"]
    return out.select(*KEYS.split(", "), "tp", "fp", "fn", "tn", *_BATCH, "agree_pct", *cols)


# ---- J. descriptive tables and quality


VARIABLES = ["age_g", "race_new", "dx_bmi_grp", "chemo_bmi_grp", "income_quart", "dx_year_grp", "dx_year_grp_more",
             "stage_d", "erpr_model", "her2_model2", "surgery_type_model"]
FILTERS = {
    "any lab present": "missing_lab_anemia = 0 OR missing_lab_neutropenia = 0 OR missing_lab_thrombocytopenia = 0",
    "all labs present": "missing_lab_anemia = 0 AND missing_lab_neutropenia = 0 AND missing_lab_thrombocytopenia = 0",
    "any lab missing": "missing_lab_anemia = 1 OR missing_lab_neutropenia = 1 OR missing_lab_thrombocytopenia = 1",
    "neutrophils missing": "missing_lab_neutropenia = 1",
    "neutrophils present": "missing_lab_neutropenia = 0",
}


def _table_one(filters: dict[str, str]) -> str:
    parts = [
        f"SELECT '{name}' AS subset, '{var}' AS variable, CAST({var} AS VARCHAR) AS level FROM val WHERE {cond}"
        for name, cond in filters.items()
        for var in VARIABLES
    ]
    share = "100.0 * n / SUM(CASE WHEN level IS NOT NULL THEN n END) OVER (PARTITION BY subset, variable)"
    return f"""
SELECT subset, variable, COALESCE(level, '(Missing)') AS level, n, {r6('pct')} AS pct,
  CASE WHEN level IS NULL THEN CAST(n AS VARCHAR) ELSE n || ' (' || CAST(CAST(ROUND(CAST(pct AS DOUBLE), 1) AS DECIMAL(5, 1)) AS VARCHAR) || '%)' END AS label FROM (
 SELECT subset, variable, level, n, CASE WHEN level IS NOT NULL THEN {share} END AS pct FROM (
  SELECT subset, variable, level, {big('COUNT(*)')} AS n FROM ({' UNION ALL '.join(parts)}) u GROUP BY 1, 2, 3) c) p"""


@query("j1_table_one", _table_one({"all": "TRUE"}))
def _(v):
    return D.table_one(P.validation_table(sources(v), SETTINGS), VARIABLES)


@query("j2_table_one_filtered", _table_one(FILTERS))
def _(v):
    table = P.validation_table(sources(v), SETTINGS)
    return D.table_one(table, VARIABLES, {k: F.expr(c) for k, c in FILTERS.items()})


_LABCOLS = ["studyid", "co_tox_lab_date", "co_tox_lab_name", "co_tox_lab_unit", "co_tox_lab_result",
            "co_tox_lab_normal_low", "co_tox_lab_normal_high"]


@query("j3_missing_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {big(f'COUNT(*) - COUNT({c})')} AS n_missing, {r6(f'100.0 * (COUNT(*) - COUNT({c})) / COUNT(*)')} AS pct_missing FROM lab"
    for c in _LABCOLS) + " UNION ALL SELECT '(overall)', " + big(" + ".join(f"COUNT(*) - COUNT({c})" for c in _LABCOLS))
    + ", " + r6("100.0 * (" + " + ".join(f"COUNT(*) - COUNT({c})" for c in _LABCOLS) + f") / (COUNT(*) * {len(_LABCOLS)})") + " FROM lab")
def _(v):
    return Q.missing_profile(v.lab)


_TYPES = {"studyid": "bigint", "co_tox_dx_code_date": "date"} | {
    f"{c}_flag_icd{kind}": "int"
    for c, kind in [*((c, "") for c in ICD_CONDITIONS), ("neuropathy", "_reg"), ("neuropathy", "_se")]
}


@query("j4_overview", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, {big('COUNT(*)')} AS n, {big(f'COUNT(*) - COUNT({c})')} AS n_null, CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value FROM icd"
    for c, t in _TYPES.items()))
def _(v):
    return Q.overview(v.icd.select(*_TYPES))


@query("j5_any_null", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) > COUNT({c}) AS has_null FROM lab" for c in _LABCOLS))
def _(v):
    return Q.any_null(v.lab, _LABCOLS)


@query("j6_duplicate_keys", f"""
SELECT toxicityid, {big('COUNT(*)')} AS n FROM chart GROUP BY 1 HAVING COUNT(*) > 1""")
def _(v):
    return Q.duplicate_keys(v.chart, ["toxicityid"])


@query("j7_range_check", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r6(f'MIN({c})')} AS min_value, {r6(f'MAX({c})')} AS max_value, {big(f'COUNT(*) FILTER ({c} < {lo} OR {c} > {hi})')} AS n_outside FROM rds"
    for c, lo, hi in (("id", 0, 1000000000), ("network_size", 2, 15), ("recruiter_id", 0, 100))))
def _(v):
    return Q.range_check(v.rds, {"id": (0, 1e9), "network_size": (2, 15), "recruiter_id": (0, 100)})


@query("j7_recode_sentinel", """
SELECT id, CASE WHEN network_size = 1 THEN NULL ELSE network_size END AS network_size FROM rds""")
def _(v):
    return Q.recode_sentinel(v.rds, "network_size", 1, None).select("id", "network_size")


@query("j8_chronology", f"""
SELECT toxicityname, CASE WHEN toxicitydate IS NULL THEN 'no date' WHEN first_chemo_dt IS NULL THEN 'no anchor' WHEN toxicitydate < first_chemo_dt THEN 'before'
  WHEN toxicitydate = first_chemo_dt THEN 'same day' ELSE 'after' END AS timing, {big('COUNT(*)')} AS n FROM chart t JOIN cohort c ON t.studyid = c.studyid GROUP BY 1, 2""")
def _(v):
    joined = v.chart.join(v.cohort.select("studyid", "first_chemo_dt"), "studyid")
    return Q.chronology(joined, "toxicitydate", "first_chemo_dt", ["toxicityname"])


@query("j9_expectations", f"""
SELECT 'diagnosis dates missing' AS check_name, {big('0')} AS expected, {big('COUNT(*)')} AS actual, COUNT(*) = 0 AS ok FROM cohort WHERE dx_dt IS NULL
UNION ALL SELECT 'code dates missing', 0, {big('COUNT(*)')}, COUNT(*) = 0 FROM icd WHERE co_tox_dx_code_date IS NULL
UNION ALL SELECT 'limits missing after imputation', 0, {big('COUNT(*)')}, COUNT(*) = 0 FROM lab12 WHERE co_tox_lab_name IN (1, 16, 17) AND co_tox_lab_normal_low IS NULL
UNION ALL SELECT 'person-frames per person', 4, {big('MAX(k)')}, MAX(k) = 4 FROM (SELECT COUNT(*) AS k FROM pf GROUP BY studyid) q""")
def _(v):
    # imputation and person-frames look at the same cohort and labs
    src = P.staged(sources(v))
    count = lambda df: df.agg(F.count("*"))
    low = P.limited_labs(src).where(F.col(L.LAB).isin(1, 16, 17) & F.col(L.LOW).isNull())
    frames = P.person_frames(src).groupBy("studyid").agg(F.count("*").alias("k")).agg(F.max("k"))
    return Q.expectation_suite(
        [
            Q.expect("diagnosis dates missing", count(src.cohort.where("dx_dt IS NULL")), 0),
            Q.expect("code dates missing", count(v.icd.where("co_tox_dx_code_date IS NULL")), 0),
            Q.expect("limits missing after imputation", count(low), 0),
            Q.expect("person-frames per person", frames, 4),
        ]
    )


@query("j10_year_histogram", f"""
SELECT CAST(YEAR(toxicitydate) AS INTEGER) AS year, {big('COUNT(*)')} AS n FROM chart WHERE toxicityname = 'Anemia' GROUP BY 1""")
def _(v):
    return Q.year_histogram(v.chart, "toxicitydate", F.col("toxicityname") == "Anemia")
