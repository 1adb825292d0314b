"""Cohort construction, laboratory cleaning and toxicity phenotypes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import labs as L
from ..operators import tox as T
from ..operators.scale import checkpointed
from ..plans import toxicity as P
from .prelude import CHART_CONDITIONS, CTES, GROUPS, ICD_CONDITIONS, LAB_CONDITIONS, big, r6
from .registry import SETTINGS, query, sources
from .relational import dist_sql

# ---- D. cohort construction


@query("d1_treatment_group", "SELECT studyid, tx_group FROM grouped")
def _(v):
    return C.treatment_group(v.cohort).select("studyid", "tx_group")


@query("d2_time_frame", f"""
SELECT studyid, co_tox_lab_name, time_frame, {big('COUNT(*)')} AS n FROM rawf GROUP BY 1, 2, 3""")
def _(v):
    framed = P.framed_labs(sources(v), clean=False)
    return framed.groupBy("studyid", L.LAB, "time_frame").agg(F.count("*").alias("n"))


@query("d3_chart_window", "SELECT studyid, toxicityid, toxicityname, toxicitydate FROM chartw")
def _(v):
    return P.chart_in_window(sources(v)).select("studyid", "toxicityid", "toxicityname", "toxicitydate")


@query("d4_eligibility", """
SELECT studyid, dx_dt FROM cohort WHERE NOT (any_chemo = 1 AND first_chemo_dt IS NULL) AND YEAR(dx_dt) >= 1996 AND final_rct = 0""")
def _(v):
    return C.eligible(v.cohort, 1996).select("studyid", "dx_dt")


_STEPS = ["TRUE", "NOT (any_chemo = 1 AND first_chemo_dt IS NULL)", "YEAR(dx_dt) >= 1996", "final_rct = 0"]


def _attrition_sql() -> str:
    labels = ["start", "chemo date known", "diagnosis year", "no trial"]
    cells = []
    for i, label in enumerate(labels):
        now = " AND ".join(_STEPS[: i + 1])
        before = " AND ".join(_STEPS[: max(i, 1)])
        n = lambda c: f"COUNT(*) FILTER ({c})"
        p = lambda c: f"COUNT(DISTINCT CASE WHEN {c} THEN studyid END)"
        cells.append(
            f"SELECT {i} AS step, '{label}' AS label, {big(n(now))} AS n_rows, {big(p(now))} AS n_patients,"
            f" {big(n(before) + ' - ' + n(now))} AS rows_removed, {big(p(before) + ' - ' + p(now))} AS patients_removed FROM cohort"
        )
    return " UNION ALL ".join(cells)


@query("d5_attrition", _attrition_sql())
def _(v):
    return C.attrition(v.cohort, C.eligibility_steps(1996))


@query("d6_scaffold", "SELECT studyid, siteid, time_frame FROM scaf")
def _(v):
    return C.scaffold(C.adjuvant(v.cohort)).select("studyid", "siteid", "time_frame")


@query("d7_site_from_threshold", "SELECT studyid, CASE WHEN studyid > 700 THEN 2 ELSE 1 END AS siteid FROM cohort")
def _(v):
    return C.site_from_threshold(v.cohort, 700).select("studyid", "siteid")


@query("d8_age_at_event", f"""
SELECT studyid, co_tox_lab_date, {big('MIN(dx_age + CAST(TRUNC((co_tox_lab_date - dx_dt) / 365) AS INTEGER))')} AS age FROM rawf GROUP BY 1, 2""")
def _(v):
    framed = P.framed_labs(sources(v), clean=False)
    return framed.select("studyid", L.DATE, C.age_at(L.DATE).cast("long").alias("age")).distinct()


def _group_query(name: str, columns: list[str]) -> None:
    select = ", ".join(f"{GROUPS[c]} AS {c}" for c in columns)

    @query(name, f"SELECT studyid, {select} FROM cohort")
    def _(v):
        groups = C.derived_groups(v.cohort, SETTINGS.era2, SETTINGS.era3)
        return groups.select("studyid", *columns)


_group_query("d9_age_group", ["age_g"])
_group_query("d10_bmi_group", ["dx_bmi_grp", "chemo_bmi_grp"])
_group_query("d11_era_group", ["dx_year_grp", "dx_year_grp_more"])
_group_query("d12_race_recode", ["race_new"])


# coded columns and their levels; without labels of their own the codes are the labels
_FACTORS = {
    "cycle1_dose_reduction90": {0: "N", 1: "Y"},
    "stage_d": {1: "1", 2: "2", 3: "3"},
    "erpr_model": {1: "1", 2: "2"},
    "her2_model2": {1: "negative", 2: "positive"},
    "surgery_type_model": {1: "1", 2: "2"},
    "income_quart": {1: "1", 2: "2", 3: "3", 4: "4"},
}


@query("d13_factor_labels", "SELECT studyid, " + ", ".join(
    f"CASE {c} {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in labels.items())} END AS {c}"
    for c, labels in _FACTORS.items()) + " FROM cohort")
def _(v):
    return C.label_codes(v.cohort, _FACTORS).select("studyid", *_FACTORS)


# ---- G. laboratory cleaning


_LABROW = (
    "studyid, co_tox_lab_date, co_tox_lab_name, co_tox_lab_unit, {res} AS co_tox_lab_result, {low} AS co_tox_lab_normal_low"
)


def labrow(res: str = "co_tox_lab_result", low: str = "co_tox_lab_normal_low") -> str:
    return _LABROW.format(res=r6(res), low=r6(low))


def pick(df: DataFrame) -> DataFrame:
    return df.select("studyid", L.DATE, L.LAB, L.UNIT, L.RESULT, L.LOW)


@query("g1_unit_conversion", f"""
SELECT studyid, co_tox_lab_date, {r6('ROUND_EVEN(co_tox_lab_result * 100 / 88.402, 2)')} AS mg_dl FROM lab WHERE co_tox_lab_name = 11""")
def _(v):
    rows = v.lab.where(F.col(L.LAB) == L.CREATININE)
    return rows.select("studyid", L.DATE, L.umol_to_mg_dl(F.col(L.RESULT) * 100).alias("mg_dl"))


@query("g2_unit_scaling", f"""
SELECT {labrow('CASE WHEN co_tox_lab_unit IN (3, 11) THEN co_tox_lab_result * 1000 ELSE co_tox_lab_result END', 'CASE WHEN co_tox_lab_unit IN (3, 11) THEN co_tox_lab_normal_low * 1000 ELSE co_tox_lab_normal_low END')} FROM lab WHERE co_tox_lab_name = 1""")
def _(v):
    return pick(L.scale_units(v.lab.where(F.col(L.LAB) == L.ANC), L.SCALE_RULES[:1]))


@query("g3_lab_scaling", f"""
SELECT {labrow('co_tox_lab_result * 1000', 'co_tox_lab_normal_low * 1000')} FROM lab WHERE co_tox_lab_name = 16""")
def _(v):
    return pick(L.scale_units(v.lab.where(F.col(L.LAB) == L.PLATELETS), L.SCALE_RULES[1:]))


@query("g4_sentinel_repair", f"""
SELECT {labrow('CASE WHEN co_tox_lab_result = 0.1 THEN 0.2 ELSE co_tox_lab_result END')} FROM lab""")
def _(v):
    # the tables hold no negative sentinel, so the smallest result plays its part
    return pick(L.repair_sentinel(v.lab, 0.1, 0.2))


@query("g5_percent_to_absolute_result", f"SELECT {labrow()} FROM lab5")
def _(v):
    return pick(L.percent_to_absolute(L.repair_sentinel(v.lab), (L.RESULT,)))


@query("g6_percent_to_absolute_limit", f"SELECT {labrow()} FROM lab6")
def _(v):
    return pick(L.percent_to_absolute(L.repair_sentinel(v.lab)))


@query("g7_code_merge", f"""
SELECT CASE WHEN co_tox_lab_name = 2 THEN 1 ELSE co_tox_lab_name END AS co_tox_lab_name, {big('COUNT(*)')} AS n FROM lab GROUP BY 1""")
def _(v):
    # white-count rows stand in for neutrophil percent, which the tables lack
    merged = L.merge_codes(v.lab, {L.WBC: L.ANC})
    return merged.groupBy(L.LAB).agg(F.count("*").alias("n"))


# labs with the sentinel and the percent code that the tables lack: half of the percent counts are filed
# under the percent code, the smallest result stands as the sentinel
_CODED_ROW = "co_tox_lab_name = 1 AND co_tox_lab_unit = 4 AND studyid % 2 = 0"
_CODED = {"lab": f"""
SELECT studyid, co_tox_lab_date, CASE WHEN {_CODED_ROW} THEN 21 ELSE co_tox_lab_name END AS co_tox_lab_name,
  CASE WHEN {_CODED_ROW} THEN 16 ELSE co_tox_lab_unit END AS co_tox_lab_unit,
  CASE WHEN co_tox_lab_result = 0.1 THEN -0.1 ELSE co_tox_lab_result END AS co_tox_lab_result, co_tox_lab_normal_low, co_tox_lab_normal_high
FROM ({CTES["lab"]}) q"""}


def coded(v) -> DataFrame:
    own = (F.col(L.LAB) == L.ANC) & (F.col(L.UNIT) == L.UNIT_PERCENT) & (F.col("studyid") % 2 == 0)
    return v.lab.withColumns(
        {
            L.LAB: F.when(own, L.NEUTROPHIL_PCT).otherwise(F.col(L.LAB)),
            L.UNIT: F.when(own, 16).otherwise(F.col(L.UNIT)),
            L.RESULT: F.when(F.col(L.RESULT) == 0.1, -0.1).otherwise(F.col(L.RESULT)),
        }
    )


@query("g4_sentinel_repair_negative", f"SELECT {labrow()} FROM lab4", _CODED)
def _(v):
    return pick(L.repair_sentinel(coded(v)))


@query("g5_percent_code_result", f"SELECT {labrow()} FROM lab5", _CODED)
def _(v):
    return pick(L.percent_to_absolute(L.repair_sentinel(coded(v)), (L.RESULT,)))


@query("g6_percent_code_limit", f"SELECT {labrow()} FROM lab6", _CODED)
def _(v):
    return pick(L.percent_to_absolute(L.repair_sentinel(coded(v))))


@query("g7_code_merge_percent", f"""
SELECT CASE WHEN co_tox_lab_name = 21 THEN 1 ELSE co_tox_lab_name END AS co_tox_lab_name, co_tox_lab_unit, {big('COUNT(*)')} AS n FROM lab GROUP BY 1, 2""", _CODED)
def _(v):
    return L.merge_codes(coded(v)).groupBy(L.LAB, L.UNIT).agg(F.count("*").alias("n"))


@query("g8_blank_limits", f"SELECT {labrow()}, time_frame FROM lab8")
def _(v):
    out = L.blank_limits(P.framed_labs(sources(v)))
    return out.select("studyid", L.DATE, L.LAB, L.UNIT, L.RESULT, L.LOW, "time_frame")


@query("g9_missing_indicator", f"""
SELECT studyid, co_tox_lab_date, co_tox_lab_name, CASE WHEN co_tox_lab_normal_low IS NULL THEN 1 ELSE 0 END AS normal_low_missing,
  CASE WHEN co_tox_lab_normal_high IS NULL THEN 1 ELSE 0 END AS normal_high_missing FROM lab""")
def _(v):
    return L.missing_indicators(v.lab).select(
        "studyid", L.DATE, L.LAB, "normal_low_missing", "normal_high_missing"
    )


def _missing_pattern(limit: str, labs: str) -> str:
    gone = f"COUNT(*) FILTER ({limit} IS NULL)"
    return f"""
SELECT studyid, time_frame, co_tox_lab_name, {big('COUNT(*)')} AS n, {big(gone)} AS n_missing,
  CASE WHEN COUNT(*) = {gone} THEN 'full' WHEN {gone} = 0 THEN 'none' ELSE 'partial' END AS missing_ind
FROM lab8 WHERE co_tox_lab_name IN ({labs}) GROUP BY 1, 2, 3"""


@query("g10_missing_pattern", _missing_pattern(L.LOW, "1, 16, 17"))
def _(v):
    return L.missing_pattern(L.blank_limits(P.framed_labs(sources(v))), L.LOW, [1, 16, 17])


@query("g10_missing_pattern_high", _missing_pattern(L.HIGH, "6, 7, 8"))
def _(v):
    return L.missing_pattern(L.blank_limits(P.framed_labs(sources(v))), L.HIGH, [6, 7, 8])


_LIMITS = f"studyid, co_tox_lab_date, co_tox_lab_name, time_frame, {r6('co_tox_lab_normal_low')} AS co_tox_lab_normal_low, {r6('co_tox_lab_normal_high')} AS co_tox_lab_normal_high"


def limits(df: DataFrame) -> DataFrame:
    return df.select("studyid", L.DATE, L.LAB, "time_frame", L.LOW, L.HIGH)


@query("g11_impute_own_record", f"SELECT {_LIMITS} FROM lab11")
def _(v):
    return limits(L.impute_own_record(L.blank_limits(P.framed_labs(sources(v)))))


@query("g12_impute_constant", f"SELECT {_LIMITS} FROM lab12")
def _(v):
    return limits(P.limited_labs(sources(v)))


@query("g12_impute_site_median", f"""
SELECT l.studyid, l.co_tox_lab_date, l.co_tox_lab_name, l.time_frame, {r6('COALESCE(l.co_tox_lab_normal_low, m.med)')} AS co_tox_lab_normal_low
FROM (SELECT * FROM lab8 WHERE co_tox_lab_name IN (1, 16, 17)) l LEFT JOIN
 (SELECT co_tox_lab_name, siteid, MEDIAN(co_tox_lab_normal_low) AS med FROM lab8 WHERE co_tox_lab_name IN (1, 16, 17) GROUP BY 1, 2) m
ON l.co_tox_lab_name = m.co_tox_lab_name AND l.siteid = m.siteid""")
def _(v):
    labs = [1, 16, 17]
    framed = L.blank_limits(P.framed_labs(sources(v))).where(F.col(L.LAB).isin(labs))
    return L.impute_site_median(framed, L.LOW, labs).select(
        "studyid", L.DATE, L.LAB, "time_frame", L.LOW
    )


@query("g13_drop_null_results", f"""
SELECT co_tox_lab_name, {big('COUNT(*)')} AS n FROM labf WHERE co_tox_lab_result IS NOT NULL GROUP BY 1""")
def _(v):
    kept = L.drop_null_results(P.framed_labs(sources(v)))
    return kept.groupBy(L.LAB).agg(F.count("*").alias("n"))


@query("g14_zero_audit_by_unit", f"""
SELECT co_tox_lab_unit, {big('COUNT(*)')} AS n_zero, {big('COUNT(DISTINCT studyid)')} AS n_patient FROM (
 SELECT studyid, co_tox_lab_unit, FLOOR(co_tox_lab_result) AS r FROM lab WHERE co_tox_lab_name IN (1, 11)) q WHERE r = 0 GROUP BY 1""")
def _(v):
    # floored results give the audit zeros to find
    floored = v.lab.withColumn(L.RESULT, F.floor(L.RESULT).cast("double"))
    return L.zero_results_by_unit(floored, [1, 11])


@query("g14_zero_patient_distribution", f"""
SELECT studyid, {dist_sql('r')} FROM (SELECT studyid, FLOOR(co_tox_lab_result) AS r FROM lab WHERE co_tox_lab_name IN (1, 11) AND co_tox_lab_result IS NOT NULL) q
WHERE studyid IN (SELECT studyid FROM lab WHERE co_tox_lab_name IN (1, 11) AND FLOOR(co_tox_lab_result) = 0) GROUP BY 1""")
def _(v):
    floored = v.lab.withColumn(L.RESULT, F.floor(L.RESULT).cast("double"))
    return L.zero_patient_distribution(floored, [1, 11], ["studyid"])


_REPORT = f"""{big('COUNT(*) FILTER (co_tox_lab_normal_low IS NULL)')} AS nas, {big('COUNT(DISTINCT CASE WHEN co_tox_lab_normal_low IS NULL THEN studyid END)')} AS nas_patient,
  {big('COUNT(*)')} AS n, {big('COUNT(DISTINCT studyid)')} AS n_patient, {r6('100.0 * COUNT(*) FILTER (co_tox_lab_normal_low IS NULL) / COUNT(*)')} AS percent_n,
  {r6('100.0 * COUNT(DISTINCT CASE WHEN co_tox_lab_normal_low IS NULL THEN studyid END) / COUNT(DISTINCT studyid)')} AS percent_patient FROM rawf WHERE co_tox_lab_name IN (1, 16, 17)"""


@query("g15_limit_missing_report", f"SELECT time_frame, co_tox_lab_name, {_REPORT} GROUP BY 1, 2")
def _(v):
    return L.limit_missing_report(P.framed_labs(sources(v), clean=False), L.LOW, [1, 16, 17])


_REPORT_HIGH = _REPORT.replace("normal_low", "normal_high").replace("(1, 16, 17)", "(6, 7, 8)")


@query("g15_limit_missing_report_high", f"SELECT time_frame, co_tox_lab_name, {_REPORT_HIGH} GROUP BY 1, 2")
def _(v):
    return L.limit_missing_report(P.framed_labs(sources(v), clean=False), L.HIGH, [6, 7, 8])


@query("g15_limit_missing_by_site", f"SELECT siteid, time_frame, co_tox_lab_name, {_REPORT} GROUP BY 1, 2, 3")
def _(v):
    framed = P.framed_labs(sources(v), clean=False)
    return L.limit_missing_report(framed, L.LOW, [1, 16, 17], by_site=True)


# ---- H. phenotypes


@query("h1_creatinine_clearance", f"""
SELECT studyid, co_tox_lab_date, time_frame, {r6('crcl')} AS crcl FROM crcl WHERE co_tox_lab_name = 11""")
def _(v):
    rows = T.creatinine_clearance(P.limited_labs(sources(v))).where(F.col(L.LAB) == L.CREATININE)
    return rows.select("studyid", L.DATE, "time_frame", "crcl")


def _lab_grade(name: str, cond: str) -> None:
    cols = [f"{cond}_g{g}_n" for g in (1, 2, 3)] + [f"{cond}_g{g}_lab" for g in (1, 2, 3)]

    @query(name, f"SELECT studyid, time_frame, {', '.join(cols)} FROM labpf WHERE {cond}_lab_rows > 0")
    def _(v):
        flags = T.lab_flags(P.graded_labs(sources(v)))
        return flags.where(F.col(f"{cond}_lab_rows") > 0).select("studyid", "time_frame", *cols)


def _row_grade(name: str, cond: str) -> None:
    cols = [f"{cond}_g{g}" for g in (1, 2, 3)]

    @query(name, f"SELECT studyid, co_tox_lab_date, co_tox_lab_name, {', '.join(cols)} FROM labg WHERE {cond}_g1 IS NOT NULL")
    def _(v):
        rows = P.graded_labs(sources(v)).where(F.col(f"{cond}_g1").isNotNull())
        return rows.select("studyid", L.DATE, L.LAB, *cols)


_lab_grade("h2_renal_grades", "kidney")
_row_grade("h3_hepatic_grades", "liver")
_row_grade("h4_anemia_grades", "anemia")
_row_grade("h5_neutropenia_grades", "neutropenia")
_row_grade("h6_thrombocytopenia_grades", "thrombocytopenia")

_ICD_COLS = [c for f in T.ICD_FLAGS for c in (f, f"{f}_n")]


@query("h7_icd_flags", f"SELECT studyid, time_frame, {', '.join(_ICD_COLS)} FROM icdpf")
def _(v):
    return T.icd_flags(P.framed_icd(sources(v))).select("studyid", "time_frame", *_ICD_COLS)


_LAB_COLS = [f"{c}_g{g}_lab" for c in LAB_CONDITIONS for g in (1, 2, 3)]


@query("h8_lab_flags", f"SELECT studyid, time_frame, {', '.join(_LAB_COLS)} FROM labpf")
def _(v):
    return P.lab_person_flags(sources(v)).select("studyid", "time_frame", *_LAB_COLS)


@query("h9_chart_flags", "SELECT * FROM chartpf")
def _(v):
    return P.chart_person_flags(sources(v))


@query("h10_symmetric_completion", """
SELECT COALESCE(i.studyid, l.studyid) AS studyid, COALESCE(i.time_frame, l.time_frame) AS time_frame, COALESCE(i.anemia_flag_icd, 0) AS anemia_flag_icd,
  COALESCE(l.anemia_g2_lab, 0) AS anemia_g2_lab, CASE WHEN i.studyid IS NULL THEN 1 ELSE 0 END AS missing_icd, CASE WHEN l.studyid IS NULL THEN 1 ELSE 0 END AS missing_lab
FROM icdpf i FULL JOIN (SELECT * FROM labpf WHERE anemia_lab_rows > 0) l ON i.studyid = l.studyid AND i.time_frame = l.time_frame""")
def _(v):
    src = sources(v)
    lab = P.lab_person_flags(src).where("anemia_lab_rows > 0")
    return T.complete_pair(
        T.icd_flags(P.framed_icd(src)), lab, ["anemia_flag_icd"], ["anemia_g2_lab"]
    )


def _completed(c: str) -> str:
    return f"""
SELECT '{c}' AS condition, COALESCE(i.studyid, l.studyid) AS studyid, COALESCE(i.time_frame, l.time_frame) AS time_frame, COALESCE(i.{c}_flag_icd, 0) AS icd_flag,
  COALESCE(l.{c}_g2_lab, 0) AS lab_flag, CASE WHEN i.studyid IS NULL THEN 1 ELSE 0 END AS missing_icd, CASE WHEN l.studyid IS NULL THEN 1 ELSE 0 END AS missing_lab
FROM icdpf i FULL JOIN (SELECT * FROM labpf WHERE {c}_lab_rows > 0) l ON i.studyid = l.studyid AND i.time_frame = l.time_frame"""


@query("h10_symmetric_completion_all", " UNION ALL ".join(map(_completed, LAB_CONDITIONS)))
def _(v):
    src = sources(v)
    # both sides serve every condition
    icd, lab = checkpointed(T.icd_flags(P.framed_icd(src))), checkpointed(P.lab_person_flags(src))
    parts = []
    for c in LAB_CONDITIONS:
        flags = [f"{c}_flag_icd", f"{c}_g2_lab"]
        both = T.complete_pair(icd, lab.where(f"{c}_lab_rows > 0"), flags[:1], flags[1:])
        both = both.withColumnsRenamed(dict(zip(flags, ["icd_flag", "lab_flag"], strict=True)))
        parts.append(both.select(F.lit(c).alias("condition"), "studyid", "time_frame", "icd_flag", "lab_flag", "missing_icd", "missing_lab"))
    return reduce(DataFrame.unionByName, parts)


_PF = ["studyid", "siteid", "time_frame", "missing_icd", *[f"{c}_flag_icd" for c in ICD_CONDITIONS], *_LAB_COLS,
       *[f"missing_lab_{c}" for c in LAB_CONDITIONS]]


@query("h11_scaffold_completion", f"SELECT {', '.join(_PF)} FROM pf")
def _(v):
    return P.person_frames(sources(v)).select(*_PF)


def _concord(icd: str, lab: str, label: str) -> str:
    return (
        f"CASE WHEN {icd} = 1 AND {lab} = 1 THEN 'Both' WHEN {icd} = 1 THEN 'Only ICD'"
        f" WHEN {lab} = 1 THEN 'Only {label}' ELSE 'Neither' END"
    )


_CONCORD = {
    "renal_tox_indicator": ("kidney_flag_icd", "kidney_g1_lab", "CrCl60"),
    "hep_tox_indicator": ("liver_flag_icd", "liver_g2_lab", "Grade 2"),
    "anemia_tox_indicator": ("anemia_flag_icd", "anemia_g2_lab", "Grade 2"),
    "neutropenia_tox_indicator_g3": ("neutropenia_flag_icd", "neutropenia_g3_lab", "Grade 3"),
    "neutropenia_tox_indicator_g2": ("neutropenia_flag_icd", "neutropenia_g2_lab", "Grade 2"),
    "thrombocytopenia_tox_indicator": ("thrombocytopenia_flag_icd", "thrombocytopenia_g2_lab", "Grade 2"),
}


@query("h12_concordance", f"""
SELECT studyid, time_frame, {', '.join(f'{_concord(*a)} AS {k}' for k, a in _CONCORD.items())} FROM pf""")
def _(v):
    return T.concordance_labels(P.person_frames(sources(v))).select("studyid", "time_frame", *_CONCORD)


_TOX = [f"{c}_tox" for c in CHART_CONDITIONS]


@query("h13_chart_merge", f"SELECT studyid, {', '.join(_TOX)}, anemia_flag_icd FROM merged")
def _(v):
    src = sources(v)
    merged = T.merge_chart(P.person_frames(src), P.chart_person_flags(src))
    return merged.select("studyid", *_TOX, "anemia_flag_icd")


@query("h14_first_dates_and_gaps", """
SELECT q.*, CAST(first_icd_date - first_tox_date AS INTEGER) AS gap_between_icd_and_tox, CAST(first_icd_date - c.first_chemo_dt AS INTEGER) AS gap_between_icd_and_first_chemo,
  CAST(first_tox_date - c.first_chemo_dt AS INTEGER) AS gap_between_chart_and_first_chemo FROM (
 SELECT COALESCE(t.studyid, i.studyid) AS studyid, COALESCE(i.time_frame, 4) AS time_frame, COALESCE(t.neuropathy_tox, 0) AS neuropathy_tox,
  COALESCE(i.neuropathy_flag_icd, 0) AS neuropathy_flag_icd, fi.d AS first_icd_date, ft.d AS first_tox_date
 FROM chartpf t FULL JOIN (SELECT p.* FROM icdpf p JOIN adj a ON p.studyid = a.studyid WHERE time_frame = 4 AND a.siteid = 2) i ON t.studyid = i.studyid
 LEFT JOIN (SELECT studyid, MIN(co_tox_dx_code_date) AS d FROM icdf WHERE time_frame = 4 AND neuropathy_flag_icd = 1 GROUP BY 1) fi ON COALESCE(t.studyid, i.studyid) = fi.studyid
 LEFT JOIN (SELECT studyid, MIN(toxicitydate) AS d FROM chartw WHERE toxicityname = 'Neuropathy' GROUP BY 1) ft ON COALESCE(t.studyid, i.studyid) = ft.studyid) q
JOIN cohort c ON q.studyid = c.studyid""")
def _(v):
    src = sources(v)
    icd, chart = P.framed_icd(src), P.chart_in_window(src)
    site2 = C.adjuvant(v.cohort).where("siteid = 2").select("studyid")
    flags = T.icd_flags(icd).where("time_frame = 4").join(site2, "studyid", "left_semi")
    late = icd.where((F.col("time_frame") == 4) & (F.col("neuropathy_flag_icd") > 0))
    neuro = chart.where("toxicityname = 'Neuropathy'")
    return T.neuropathy_merge(
        flags,
        P.chart_person_flags(src),
        T.first_dates(late, "co_tox_dx_code_date", "first_icd_date"),
        T.first_dates(neuro, "toxicitydate", "first_tox_date"),
        v.cohort,
    )


_WIDE = [*[f"{c}_flag_icd" for c in ICD_CONDITIONS], *_LAB_COLS, *_TOX,
         *[f"missing_lab_{c}" for c in LAB_CONDITIONS]]


@query("h15_wide_merge", f"""
SELECT studyid, {', '.join(_WIDE)}, {r6('dx_bmi')} AS dx_bmi, {r6('chemo_bmi')} AS chemo_bmi, final_rct FROM merged""")
def _(v):
    src = sources(v)
    merged = T.merge_chart(P.person_frames(src), P.chart_person_flags(src))
    return merged.select("studyid", *_WIDE, "dx_bmi", "chemo_bmi", "final_rct")


_EITHER = [f"{c}_either_g{g}" for c in P.VALIDATED for g in (1, 2, 3)]


@query("h16_either_source", f"SELECT studyid, {', '.join(_EITHER)} FROM val")
def _(v):
    return P.validation_table(sources(v), SETTINGS).select("studyid", *_EITHER)


@query("h17_missing_icd_neuropathy", """
SELECT s.studyid, CASE WHEN i.neuropathy_flag_icd IS NULL THEN 1 ELSE 0 END AS missing_icd_neuropathy, COALESCE(i.neuropathy_flag_icd, 0) AS neuropathy_flag_icd
FROM (SELECT * FROM scaf WHERE time_frame = 4) s LEFT JOIN icdpf i ON s.studyid = i.studyid AND s.time_frame = i.time_frame""")
def _(v):
    people = C.adjuvant(v.cohort).select("studyid")
    codes = T.icd_flags(P.framed_icd(sources(v)), ["neuropathy_flag_icd"]).where("time_frame = 4")
    joined = people.join(codes.select("studyid", "neuropathy_flag_icd"), "studyid", "left")
    return joined.withColumn(
        "missing_icd_neuropathy", F.col("neuropathy_flag_icd").isNull().cast("int")
    ).fillna(0, ["neuropathy_flag_icd"])
