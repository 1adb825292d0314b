"""SQL forms of the input views and shared intermediate steps, composed on demand as CTEs."""

from __future__ import annotations

import re

from ..sources.views import CHART_NAMES

CTES: dict[str, str] = {}


def frame(date: str) -> str:
    return (
        f"CASE WHEN {date} IS NULL OR dx_dt IS NULL THEN NULL WHEN {date} <= dx_dt THEN 1"
        f" WHEN surgery_dt IS NULL THEN NULL WHEN {date} <= surgery_dt THEN 2"
        f" WHEN first_chemo_dt IS NULL THEN NULL WHEN {date} <= first_chemo_dt THEN 3"
        f" WHEN last_chemo_dt IS NULL THEN NULL WHEN {date} <= last_chemo_dt THEN 4 END"
    )


def r6(x: str) -> str:
    return f"(ROUND(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


CTES["cohort"] = """
SELECT c_custkey AS studyid, CASE WHEN c_nationkey < 13 THEN 1 ELSE 2 END AS siteid,
  MAX(CASE WHEN rn = 1 THEN od END) AS dx_dt,
  CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 27 = 0 THEN 0 WHEN MAX(n) >= 6 THEN 1 ELSE 0 END AS surgery_d,
  MAX(CASE WHEN n >= 6 AND rn = CASE WHEN c_custkey % 5 = 0 THEN 6 ELSE 3 END THEN od END) AS surgery_dt,
  CASE WHEN MAX(n) >= 8 AND c_custkey % 11 <> 0 THEN 1 ELSE 0 END AS any_chemo,
  MAX(CASE WHEN n >= 8 AND c_custkey % 11 <> 0 AND c_custkey % 23 <> 0 AND rn = 5 THEN od END) AS first_chemo_dt,
  MAX(CASE WHEN n >= 8 AND c_custkey % 11 <> 0 AND rn = n THEN od END) AS last_chemo_dt,
  30 + c_custkey % 55 AS dx_age,
  CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 50.0 + c_custkey % 40 END AS DOUBLE) AS final_dx_wt,
  CAST(CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 48.0 + c_custkey % 42 END AS DOUBLE) AS final_2nd_wt,
  CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 16.0 + c_custkey % 28 END AS DOUBLE) AS dx_bmi,
  CAST(CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE 17.0 + c_custkey % 27 END AS DOUBLE) AS chemo_bmi,
  CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE 0 END AS final_rct,
  CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_custkey % 6 END AS race_eth_model,
  1 + c_custkey % 3 AS stage_d,
  CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE 1 + c_custkey % 2 END AS erpr_model,
  CASE WHEN c_custkey % 4 < 2 THEN 1 ELSE 2 END AS her2_model2,
  CASE WHEN c_custkey % 5 > 2 THEN 2 ELSE 1 END AS surgery_type_model,
  CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE 1 + c_custkey % 4 END AS income_quart,
  CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS cycle1_dose_reduction90
FROM customer JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS od,
    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
    COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders) o ON c_custkey = o_custkey
GROUP BY c_custkey, c_nationkey"""

CTES["icd"] = """
SELECT o_custkey AS studyid, CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS co_tox_dx_code_date,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS anemia_flag_icd,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS neutropenia_flag_icd,
  CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS thrombocytopenia_flag_icd,
  CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS kidney_flag_icd,
  CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS liver_flag_icd,
  CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS neuropathy_flag_icd,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS neuropathy_flag_icd_reg,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS neuropathy_flag_icd_se
FROM orders"""

CTES["lab"] = """
SELECT o_custkey AS studyid, CAST(l_shipdate AS DATE) AS co_tox_lab_date, lab AS co_tox_lab_name,
  CASE WHEN l_suppkey % 33 = 0 THEN NULL WHEN lab = 1 AND l_suppkey % 20 = 0 THEN 4 WHEN lab IN (1, 2, 16) THEN 3 WHEN lab = 6 THEN 6 ELSE 12 END AS co_tox_lab_unit,
  CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN lab = 1 AND l_suppkey % 20 = 0 THEN l_quantity * 2.0 WHEN lab = 1 THEN l_quantity * 0.1 WHEN lab = 17 THEN 6.0 + l_quantity * 0.2
       WHEN lab = 16 THEN l_quantity * 8.0 WHEN lab = 6 THEN l_quantity * 5.0 WHEN lab = 11 THEN 0.3 + l_quantity * 0.1 WHEN lab = 5 THEN l_quantity * 0.08 ELSE l_quantity * 0.2 END AS co_tox_lab_result,
  CAST(CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN lab = 1 THEN 1.4 + (l_partkey % 4) * 0.3 WHEN lab = 17 THEN 10.0 + (l_partkey % 4) * 0.5 WHEN lab = 16 THEN 140.0 + (l_partkey % 2) * 10.0 END AS DOUBLE) AS co_tox_lab_normal_low,
  CAST(CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN lab = 6 THEN 35.0 + (l_partkey % 3) * 5.0 END AS DOUBLE) AS co_tox_lab_normal_high
FROM (SELECT l.*, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 17 WHEN 3 THEN 16 WHEN 4 THEN 6 WHEN 5 THEN 11 WHEN 6 THEN 5 ELSE 2 END AS lab FROM lineitem l) x
JOIN orders ON l_orderkey = o_orderkey"""

_CHART_ARMS = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CHART_NAMES))
CTES["chart"] = f"""
SELECT o_custkey AS studyid, l_orderkey * 10 + l_linenumber AS toxicityid,
  CASE l_partkey % 7 {_CHART_ARMS} ELSE '' END AS toxicityname,
  CASE WHEN l_suppkey % 30 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS toxicitydate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""

CTES["rds"] = """
SELECT c_custkey AS id, CASE WHEN c_custkey < 10 THEN NULL ELSE CAST(FLOOR((c_custkey - 10) / 3) AS BIGINT) END AS recruiter_id,
  COALESCE(n, 1) AS network_size, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS y,
  c_acctbal AS y_cont, c_mktsegment AS y_cat, c_custkey AS sample_order
FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey"""

CTES["coupons"] = """
SELECT c_custkey AS id, c_custkey AS own_coupon, 10 + 3 * c_custkey AS coupon_1, 11 + 3 * c_custkey AS coupon_2, 12 + 3 * c_custkey AS coupon_3 FROM customer"""

CTES["effects"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS x,
  CASE WHEN o_orderstatus = 'F' OR (o_orderpriority = '1-URGENT' AND c_acctbal > 4000) THEN 1 ELSE 0 END AS y,
  CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS z, c_mktsegment AS u, c_nationkey AS c, c_acctbal AS z_cont
FROM orders JOIN customer ON o_custkey = c_custkey"""

CTES["dag_edges"] = """
SELECT graph_id, src, dst FROM (
  SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT) AS graph_id, p_partkey % 20 AS src, 2 * (p_partkey % 20) + 1 AS dst FROM part
  UNION SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT), p_partkey % 20, 2 * (p_partkey % 20) + 2 FROM part
  UNION SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT), p_partkey % 20, p_partkey % 20 + 3 FROM part WHERE p_size % 2 = 0) e WHERE dst < 20"""

CTES["grouped"] = """
SELECT *, CASE WHEN surgery_d IS NULL THEN NULL
  WHEN (surgery_d = 0 AND any_chemo = 0) IS NULL THEN NULL WHEN surgery_d = 0 AND any_chemo = 0 THEN 'Neither'
  WHEN (surgery_d = 0 AND any_chemo = 1) IS NULL THEN NULL WHEN surgery_d = 0 AND any_chemo = 1 THEN 'Only chemo'
  WHEN surgery_dt IS NULL THEN NULL
  WHEN any_chemo IS NULL THEN NULL WHEN any_chemo = 0 THEN 'Only surgery'
  WHEN first_chemo_dt IS NULL THEN NULL WHEN surgery_dt < first_chemo_dt THEN 'Surgery before chemo'
  ELSE 'Surgery after chemo' END AS tx_group FROM cohort"""
CTES["adj"] = "SELECT * FROM grouped WHERE tx_group = 'Surgery before chemo'"
CTES["icdf"] = f"""
SELECT * FROM (SELECT i.*, a.siteid, a.dx_dt, a.first_chemo_dt, {frame('co_tox_dx_code_date')} AS time_frame
  FROM icd i JOIN adj a ON i.studyid = a.studyid) q WHERE time_frame IS NOT NULL"""
CTES["chartw"] = """
SELECT t.*, c.first_chemo_dt, c.last_chemo_dt FROM chart t JOIN cohort c ON t.studyid = c.studyid
WHERE c.surgery_d = 1 AND c.surgery_dt IS NOT NULL AND c.surgery_dt < c.first_chemo_dt
  AND t.toxicitydate > c.first_chemo_dt AND t.toxicitydate <= c.last_chemo_dt"""

_KEEP = "studyid, co_tox_lab_date, co_tox_lab_name, co_tox_lab_unit"
CTES["lab4"] = f"""
SELECT {_KEEP}, CASE WHEN co_tox_lab_result = -0.1 THEN 0.1 ELSE co_tox_lab_result END AS co_tox_lab_result,
  co_tox_lab_normal_low, co_tox_lab_normal_high FROM lab"""


def _percent(source: str, target: str) -> tuple[str, str, str]:
    shares = f"""
SELECT {_KEEP}, pct FROM (SELECT {_KEEP}, {target} AS pct, ROW_NUMBER() OVER (PARTITION BY studyid, co_tox_lab_date
    ORDER BY co_tox_lab_name NULLS FIRST, co_tox_lab_unit NULLS FIRST, {target} NULLS FIRST) AS k
  FROM {source} WHERE (co_tox_lab_name = 1 AND co_tox_lab_unit = 4) OR (co_tox_lab_name = 21 AND {target} <= 100)) q WHERE k = 1"""
    white = f"""
SELECT studyid, co_tox_lab_date, wbc FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY studyid, co_tox_lab_date
    ORDER BY co_tox_lab_unit NULLS FIRST, wbc NULLS FIRST) AS k
  FROM (SELECT studyid, co_tox_lab_date, co_tox_lab_unit, CASE WHEN co_tox_lab_unit IS NULL OR co_tox_lab_unit = 3
      THEN co_tox_lab_result * 1000 ELSE co_tox_lab_result END AS wbc FROM {source} WHERE co_tox_lab_name = 2) w) q WHERE k = 1"""
    others = {"co_tox_lab_result", "co_tox_lab_normal_low", "co_tox_lab_normal_high"} - {target}
    keep = ", ".join(f"l.{c}" for c in _KEEP.split(", ")) + ", " + ", ".join(f"l.{c}" for c in sorted(others))
    done = f"""
SELECT {keep}, COALESCE(b.abs_value, l.{target}) AS {target} FROM {source} l LEFT JOIN (
    SELECT s.studyid, s.co_tox_lab_date, s.co_tox_lab_name, s.co_tox_lab_unit,
      CAST(ROUND_EVEN(s.pct * w.wbc / 100, 0) AS DOUBLE) AS abs_value
    FROM {source}_share s JOIN {source}_white w ON s.studyid = w.studyid AND s.co_tox_lab_date = w.co_tox_lab_date) b
  ON l.studyid = b.studyid AND l.co_tox_lab_date = b.co_tox_lab_date AND l.co_tox_lab_name = b.co_tox_lab_name
  AND l.co_tox_lab_unit IS NOT DISTINCT FROM b.co_tox_lab_unit"""
    return shares, white, done


CTES["lab4_share"], CTES["lab4_white"], CTES["lab5"] = _percent("lab4", "co_tox_lab_result")
CTES["lab5_share"], CTES["lab5_white"], CTES["lab6"] = _percent("lab5", "co_tox_lab_normal_low")
_FACTOR = "CASE WHEN co_tox_lab_name = 1 AND co_tox_lab_unit IN (3, 11) OR co_tox_lab_name = 16 THEN 1000.0 ELSE 1.0 END"
CTES["lab7"] = f"""
SELECT studyid, co_tox_lab_date, CASE WHEN co_tox_lab_name = 21 THEN 1 ELSE co_tox_lab_name END AS co_tox_lab_name, co_tox_lab_unit,
  co_tox_lab_result * ({_FACTOR}) AS co_tox_lab_result, co_tox_lab_normal_low * ({_FACTOR}) AS co_tox_lab_normal_low,
  co_tox_lab_normal_high FROM lab6"""
CTES["labf"] = f"""
SELECT * FROM (SELECT l.*, a.siteid, a.dx_dt, a.dx_age, a.final_dx_wt, a.final_2nd_wt, {frame('co_tox_lab_date')} AS time_frame
  FROM lab7 l JOIN adj a ON l.studyid = a.studyid) q WHERE time_frame IS NOT NULL"""
CTES["rawf"] = f"""
SELECT * FROM (SELECT l.*, a.siteid, a.dx_dt, a.dx_age, a.final_dx_wt, a.final_2nd_wt, {frame('co_tox_lab_date')} AS time_frame
  FROM lab l JOIN adj a ON l.studyid = a.studyid) q WHERE time_frame IS NOT NULL"""
CTES["lab8"] = """
SELECT * REPLACE (CASE WHEN co_tox_lab_name = 17 AND co_tox_lab_normal_low <= 10 THEN NULL
  WHEN co_tox_lab_name = 1 AND (co_tox_lab_normal_low <= 1500 OR co_tox_lab_normal_low > 3000) THEN NULL
  ELSE co_tox_lab_normal_low END AS co_tox_lab_normal_low) FROM labf"""
CTES["own"] = """
SELECT studyid, time_frame, co_tox_lab_name, MIN(CASE WHEN co_tox_lab_name IN (6, 7, 8) THEN co_tox_lab_normal_high END) AS own_high,
  MAX(CASE WHEN co_tox_lab_name IN (1, 16, 17) THEN co_tox_lab_normal_low END) AS own_low FROM lab8 GROUP BY 1, 2, 3"""
CTES["lab11"] = """
SELECT l.* REPLACE (COALESCE(l.co_tox_lab_normal_low, o.own_low) AS co_tox_lab_normal_low,
  COALESCE(l.co_tox_lab_normal_high, o.own_high) AS co_tox_lab_normal_high)
FROM lab8 l LEFT JOIN own o ON l.studyid = o.studyid AND l.time_frame = o.time_frame AND l.co_tox_lab_name = o.co_tox_lab_name"""
CTES["lab12"] = """
SELECT * REPLACE (COALESCE(co_tox_lab_normal_low, CASE co_tox_lab_name WHEN 17 THEN 11.4 WHEN 1 THEN CASE WHEN siteid = 2 THEN 2000.0 ELSE 2100.0 END WHEN 16 THEN 140000.0 END) AS co_tox_lab_normal_low,
  COALESCE(co_tox_lab_normal_high, CASE co_tox_lab_name WHEN 6 THEN 35.0 WHEN 7 THEN 40.0 WHEN 8 THEN 110.0 END) AS co_tox_lab_normal_high)
FROM lab11 WHERE co_tox_lab_result IS NOT NULL"""
_AGE = "(140 - (dx_age + CAST(TRUNC((co_tox_lab_date - dx_dt) / 365) AS INTEGER)))"
CTES["crcl"] = f"""
SELECT *, CASE WHEN co_tox_lab_name <> 11 THEN NULL WHEN time_frame < 3 THEN {_AGE} * final_dx_wt * 0.85 / (72 * co_tox_lab_result)
  ELSE {_AGE} * final_2nd_wt * 0.85 / (72 * co_tox_lab_result) END AS crcl FROM lab12"""


def _liver(bili: str, ast: str, alp: str) -> str:
    return (
        f"CASE WHEN co_tox_lab_name IN (3, 4, 5, 6, 7, 8) THEN CASE WHEN co_tox_lab_name = 5 AND co_tox_lab_result {bili} THEN 1"
        f" WHEN co_tox_lab_name IN (6, 7) AND co_tox_lab_result {ast} * co_tox_lab_normal_high THEN 1"
        f" WHEN co_tox_lab_name = 8 AND co_tox_lab_result {alp} * co_tox_lab_normal_high THEN 1 ELSE 0 END END"
    )


def _low(lab: int, bound: str) -> str:
    return f"CASE WHEN co_tox_lab_name = {lab} THEN CASE WHEN co_tox_lab_result < {bound} THEN 1 ELSE 0 END END"


ROW_FLAGS = {
    "kidney_g1": "CASE WHEN crcl IS NOT NULL THEN CASE WHEN crcl < 60 THEN 1 ELSE 0 END END",
    "kidney_g2": "CASE WHEN crcl IS NOT NULL THEN CASE WHEN crcl < 30 THEN 1 ELSE 0 END END",
    "kidney_g3": "CASE WHEN crcl IS NOT NULL THEN CASE WHEN crcl < 15 THEN 1 ELSE 0 END END",
    "liver_g1": _liver(">= 1.2", ">= 2", "> 2.5"),
    "liver_g2": _liver("> 1.5", "> 3", "> 2.5"),
    "liver_g3": _liver("> 3", "> 5", "> 5"),
    "anemia_g1": _low(17, "co_tox_lab_normal_low"),
    "anemia_g2": _low(17, "10"),
    "anemia_g3": _low(17, "8"),
    "neutropenia_g1": _low(1, "co_tox_lab_normal_low"),
    "neutropenia_g2": _low(1, "1500"),
    "neutropenia_g3": _low(1, "1000"),
    "thrombocytopenia_g1": _low(16, "co_tox_lab_normal_low"),
    "thrombocytopenia_g2": _low(16, "75000"),
    "thrombocytopenia_g3": _low(16, "50000"),
}
CTES["labg"] = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in ROW_FLAGS.items()) + " FROM crcl"
LAB_CONDITIONS = ["kidney", "liver", "anemia", "neutropenia", "thrombocytopenia"]
ICD_CONDITIONS = [*LAB_CONDITIONS, "neuropathy"]
CTES["labpf"] = (
    "SELECT studyid, time_frame, "
    + ", ".join(f"CAST(COUNT({c}_g1) AS BIGINT) AS {c}_lab_rows" for c in LAB_CONDITIONS)
    + ", "
    + ", ".join(f"CAST(SUM({c}_g{g}) AS BIGINT) AS {c}_g{g}_n, MAX({c}_g{g}) AS {c}_g{g}_lab"
                for c in LAB_CONDITIONS for g in (1, 2, 3))
    + " FROM labg GROUP BY studyid, time_frame"
)
_ICD = [*[f"{c}_flag_icd" for c in ICD_CONDITIONS], "neuropathy_flag_icd_reg", "neuropathy_flag_icd_se"]
CTES["icdpf"] = (
    "SELECT studyid, time_frame, "
    + ", ".join(f"CAST(SUM({f}) AS BIGINT) AS {f}_n, MAX({f}) AS {f}" for f in _ICD)
    + " FROM icdf GROUP BY studyid, time_frame"
)
CHART_CONDITIONS = {
    "kidney": "Renal toxicity",
    "liver": "Hepatic toxicity",
    "anemia": "Anemia",
    "neutropenia": "Neutropenia/Leukopenia",
    "thrombocytopenia": "Thrombocytopenia",
    "neuropathy": "Neuropathy",
}
CTES["chartpf"] = (
    "SELECT studyid, "
    + ", ".join(
        f"CAST(SUM(CASE WHEN toxicityname = '{n}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}_tox_n,"
        f" MAX(CASE WHEN toxicityname = '{n}' THEN 1 ELSE 0 END) AS {c}_tox"
        for c, n in CHART_CONDITIONS.items()
    )
    + " FROM chartw GROUP BY studyid"
)
CTES["scaf"] = "SELECT a.*, f.time_frame FROM adj a, (VALUES (1), (2), (3), (4)) f(time_frame)"
CTES["pf"] = (
    "SELECT s.*, "
    + ", ".join(f"COALESCE(i.{c}_flag_icd, 0) AS {c}_flag_icd" for c in ICD_CONDITIONS)
    + ", CASE WHEN i.studyid IS NULL THEN 1 ELSE 0 END AS missing_icd, "
    + ", ".join(f"COALESCE(l.{c}_g{g}_lab, 0) AS {c}_g{g}_lab" for c in LAB_CONDITIONS for g in (1, 2, 3))
    + ", "
    + ", ".join(f"CASE WHEN COALESCE(l.{c}_lab_rows, 0) = 0 THEN 1 ELSE 0 END AS missing_lab_{c}" for c in LAB_CONDITIONS)
    + " FROM scaf s LEFT JOIN icdpf i ON s.studyid = i.studyid AND s.time_frame = i.time_frame"
    " LEFT JOIN labpf l ON s.studyid = l.studyid AND s.time_frame = l.time_frame"
)
CTES["merged"] = (
    "SELECT p.*, "
    + ", ".join(f"COALESCE(t.{c}_tox, 0) AS {c}_tox" for c in CHART_CONDITIONS)
    + " FROM pf p LEFT JOIN chartpf t ON p.studyid = t.studyid WHERE p.time_frame = 4 AND p.siteid = 2"
)
_BMI = (
    "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 18.5 THEN '<18.5' WHEN {0} < 25 THEN '18.5 - <25'"
    " WHEN {0} < 30 THEN '25 - <30' WHEN {0} < 35 THEN '30 - <35' WHEN {0} < 40 THEN '35 - <40' ELSE '40+' END"
)
GROUPS = {
    "age_g": "CASE WHEN dx_age < 50 THEN '<50' WHEN dx_age < 65 THEN '50-64' WHEN dx_age < 75 THEN '65-74' ELSE '75+' END",
    "race_new": "CASE CASE WHEN race_eth_model > 3 THEN 4 ELSE race_eth_model END WHEN 0 THEN 'White' WHEN 1 THEN 'Black' WHEN 2 THEN 'Asian' WHEN 3 THEN 'Hispanic' WHEN 4 THEN 'Other' END",
    "dx_bmi_grp": _BMI.format("dx_bmi"),
    "chemo_bmi_grp": _BMI.format("chemo_bmi"),
    "dx_year_grp": "CASE WHEN dx_dt < DATE '1995-06-01' THEN 'first half' ELSE 'later' END",
    "dx_year_grp_more": "CASE WHEN dx_dt < DATE '1995-03-01' THEN 'era 1' WHEN dx_dt < DATE '1995-09-01' THEN 'era 2' ELSE 'era 3' END",
}
_EITHER = ["anemia", "neutropenia", "thrombocytopenia"]
CTES["val"] = (
    "SELECT *, "
    + ", ".join(f"{v} AS {k}" for k, v in GROUPS.items())
    + ", "
    + ", ".join(f"GREATEST({c}_flag_icd, {c}_g{g}_lab) AS {c}_either_g{g}" for c in _EITHER for g in (1, 2, 3))
    + " FROM merged WHERE NOT (any_chemo = 1 AND first_chemo_dt IS NULL) AND YEAR(dx_dt) >= 1995 AND final_rct = 0"
)


def _long() -> str:
    parts = []
    for c in _EITHER:
        tests = [("icd", "chart", f"{c}_flag_icd", f"{c}_tox")]
        for g in (1, 2, 3):
            tests.append((f"lab g{g}", "chart", f"{c}_g{g}_lab", f"{c}_tox"))
            tests.append((f"icd or lab g{g}", "chart", f"{c}_either_g{g}", f"{c}_tox"))
            tests.append(("icd", f"lab g{g}", f"{c}_flag_icd", f"{c}_g{g}_lab"))
        for test, against, t, r in tests:
            for name, cond in (
                ("all", "TRUE"),
                ("lab present", f"missing_lab_{c} = 0"),
                ("dx after first era", "dx_year_grp_more <> 'era 1'"),
            ):
                parts.append(
                    f"SELECT studyid, '{name}' AS subset, '{c}' AS condition, '{test}' AS test,"
                    f" '{against}' AS against, {t} AS t, {r} AS r FROM val WHERE {cond}"
                )
    return " UNION ALL ".join(parts)


CTES["vlong"] = _long()
CTES["vcount"] = """
SELECT subset, condition, test, against, COUNT(*) FILTER (t = 1 AND r = 1) AS tp, COUNT(*) FILTER (t = 1 AND r = 0) AS fp,
  COUNT(*) FILTER (t = 0 AND r = 1) AS fn, COUNT(*) FILTER (t = 0 AND r = 0) AS tn
FROM vlong WHERE t IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2, 3, 4"""
CTES["forest"] = """
SELECT id, id AS seed_id, CAST(0 AS BIGINT) AS wave FROM rds WHERE recruiter_id IS NULL
UNION ALL SELECT r.id, f.seed_id, f.wave + 1 FROM rds r JOIN forest f ON r.recruiter_id = f.id"""
CTES["waves"] = "SELECT r.*, f.seed_id, f.wave FROM rds r LEFT JOIN forest f ON r.id = f.id"
CTES["rij"] = """
SELECT o.y AS g, r.y AS h, COUNT(*) AS r FROM rds r JOIN rds o ON r.recruiter_id = o.id GROUP BY 1, 2"""
CTES["two"] = """
SELECT r01 * 1.0 / NULLIF(r00 + r01, 0) AS s01, r10 * 1.0 / NULLIF(r10 + r11, 0) AS s10, r00, r01, r10, r11, n0, n1, hd0, hd1, md0, md1 FROM
 (SELECT CAST(SUM(CASE WHEN g = 0 AND h = 0 THEN r ELSE 0 END) AS DOUBLE) AS r00, CAST(SUM(CASE WHEN g = 0 AND h = 1 THEN r ELSE 0 END) AS DOUBLE) AS r01,
   CAST(SUM(CASE WHEN g = 1 AND h = 0 THEN r ELSE 0 END) AS DOUBLE) AS r10, CAST(SUM(CASE WHEN g = 1 AND h = 1 THEN r ELSE 0 END) AS DOUBLE) AS r11 FROM rij) a,
 (SELECT COUNT(*) FILTER (y = 0) AS n0, COUNT(*) FILTER (y = 1) AS n1,
   COUNT(*) FILTER (y = 0) / SUM(CASE WHEN y = 0 THEN 1.0 / network_size END) AS hd0, COUNT(*) FILTER (y = 1) / SUM(CASE WHEN y = 1 THEN 1.0 / network_size END) AS hd1,
   AVG(CASE WHEN y = 0 THEN network_size END) AS md0, AVG(CASE WHEN y = 1 THEN network_size END) AS md1 FROM rds) b"""
# successive-sampling rate: bisection on the log scale until the weights add up to twice the sample
CTES["hist"] = "SELECT network_size AS d, COUNT(*) AS n FROM rds GROUP BY 1"
CTES["bisect"] = """
SELECT 0 AS i, LN(1e-18) AS lo, LN(1e3) AS hi
UNION ALL SELECT i + 1, CASE WHEN s > 2 * n THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s > 2 * n THEN hi ELSE (lo + hi) / 2 END FROM (
  SELECT i, lo, hi, SUM(h.n / (1 - EXP(-h.d * EXP((lo + hi) / 2)))) AS s, SUM(h.n) AS n FROM bisect, hist h WHERE i < 100 GROUP BY i, lo, hi) q"""
CTES["rate"] = "SELECT EXP((lo + hi) / 2) AS t FROM bisect WHERE i = 100"
CTES["cells"] = """
SELECT c, u, COUNT(*) FILTER (x = 1 AND y = 1) * 1.0 AS a, COUNT(*) FILTER (x = 1 AND y = 0) * 1.0 AS b,
  COUNT(*) FILTER (x = 0 AND y = 1) * 1.0 AS cc, COUNT(*) FILTER (x = 0 AND y = 0) * 1.0 AS d FROM effects GROUP BY 1, 2"""
CTES["reach"] = """
SELECT graph_id, src, dst FROM dag_edges
UNION SELECT r.graph_id, r.src, e.dst FROM reach r JOIN dag_edges e ON r.graph_id = e.graph_id AND r.dst = e.src"""
_RECURSIVE = {"forest", "bisect", "reach"}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it (transitively) names, in definition order."""
    pool = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in pool and word not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{word}\b", text):
                needed.add(word)
                visit(pool[word])

    visit(body)
    if not needed:
        return body
    ordered = [k for k in pool if k in needed]
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({pool[k]})" for k in ordered) + "\n" + body
