"""Scans, sinks, projections, joins, aggregates, windows and set operations."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.nulls import (
    half_even,
    in_set,
    null_count,
    overwrite,
    r_ifelse,
    ratio,
    strict_sum,
)
from ..operators import cohort as C
from ..operators import describe as D
from ..operators import labs as L
from ..operators import quality as Q
from ..operators import rds as R
from ..operators import relational as X
from ..operators import tox as T
from ..operators.scale import checkpointed, first_row, join_null_safe, number_rows, scratch_path
from ..plans import toxicity as P
from ..sources import io
from .prelude import big, r6
from .registry import query, sources


def scratch(v, name: str) -> str:
    return scratch_path(v.spark, name)


# ---- A. scans, sinks, names


@query("a1_tabular_scan", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice FROM orders""")
def _(v):
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    return io.scan_table(v.spark, os.path.join(v.folder, "orders.parquet"), schema)


@query("a2_csv_scan", f"""
SELECT graph_id, {big('COUNT(*)')} AS n, {big('SUM(dst)')} AS total FROM dag_edges GROUP BY 1""")
def _(v):
    path = scratch(v, "edges")
    io.write_csv(v.dag_edges, path)
    back = io.scan_csv(v.spark, path, "graph_id long, src long, dst long")
    return back.groupBy("graph_id").agg(F.count("*").alias("n"), F.sum("dst").alias("total"))


@query("a3_csv_sink", f"""
SELECT studyid, toxicityid, toxicityname, toxicitydate FROM chart""")
def _(v):
    path = scratch(v, "chart")
    io.write_csv(v.chart, path)
    schema = "studyid long, toxicityid long, toxicityname string, toxicitydate date"
    return io.scan_csv(v.spark, path, schema).fillna("", ["toxicityname"])


@query("a4_stage", f"""
SELECT time_frame, {big('COUNT(*)')} AS n, {big('COUNT(DISTINCT studyid)')} AS n_patient FROM icdf GROUP BY 1""")
def _(v):
    staged = io.write_stage(P.framed_icd(sources(v)), scratch(v, "icd"))
    daily = staged.groupBy("time_frame", "studyid").agg(F.count("*").alias("d"))
    # the stage holds one row per person and day; events are counted from the source rows
    rows = v.icd.join(P.adjuvant_people(sources(v)), "studyid")
    rows = C.bucket_by_milestones(rows, "co_tox_dx_code_date").groupBy("time_frame").agg(
        F.count("*").alias("n")
    )
    return daily.groupBy("time_frame").agg(F.count("*").alias("n_patient")).join(rows, "time_frame")


@query("a5_lower_names", f"""
SELECT c_custkey, c_name, c_nationkey, {r6('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer""")
def _(v):
    raw = v.table("customer")
    return io.lower_names(raw.toDF(*[c.upper() for c in raw.columns]))


@query("a6_rename_by_role", """
SELECT studyid, anemia_flag_icd AS icd_anemia_flag_icd_raw, kidney_flag_icd AS icd_kidney_flag_icd_raw FROM icd""")
def _(v):
    flags = ["anemia_flag_icd", "kidney_flag_icd"]
    return io.rename_by_role(v.icd.select("studyid", *flags), flags, "icd_", "_raw")


# ---- B. projections, filters, predicates


@query("b1_select", "SELECT studyid, siteid, dx_dt FROM cohort")
def _(v):
    return v.cohort.select("studyid", "siteid", "dx_dt")


@query("b2_add_columns", f"""
SELECT studyid, {r6('dx_bmi + 1')} AS bmi_next, CAST(last_chemo_dt - dx_dt AS INTEGER) AS days FROM cohort""")
def _(v):
    return v.cohort.select(
        "studyid",
        (F.col("dx_bmi") + 1).alias("bmi_next"),
        F.datediff("last_chemo_dt", "dx_dt").alias("days"),
    )


@query("b3_filter_and", """
SELECT studyid, dx_age FROM cohort WHERE surgery_d = 1 AND any_chemo = 1 AND surgery_dt < first_chemo_dt""")
def _(v):
    kept = v.cohort.where("surgery_d = 1 AND any_chemo = 1 AND surgery_dt < first_chemo_dt")
    return kept.select("studyid", "dx_age")


@query("b4_null_predicates", f"""
SELECT {big('COUNT(*) FILTER (surgery_dt IS NULL)')} AS no_surgery, {big('COUNT(*) FILTER (dx_bmi IS NOT NULL)')} AS bmi_known FROM cohort""")
def _(v):
    return v.cohort.agg(
        null_count("surgery_dt").alias("no_surgery"),
        F.count_if(F.col("dx_bmi").isNotNull()).alias("bmi_known"),
    )


@query("b5_nested_conditional", """
SELECT studyid, CASE WHEN surgery_d IS NULL THEN NULL WHEN surgery_d = 0 THEN 'none'
  WHEN first_chemo_dt IS NULL OR surgery_dt IS NULL THEN NULL WHEN surgery_dt < first_chemo_dt THEN 'early' ELSE 'late' END AS kind FROM cohort""")
def _(v):
    inner = r_ifelse(F.col("surgery_dt") < F.col("first_chemo_dt"), "early", "late")
    return v.cohort.select(
        "studyid", r_ifelse(F.col("surgery_d") == 0, "none", inner).alias("kind")
    )


@query("b6_conditional_overwrite", f"""
SELECT studyid, {r6('CASE WHEN dx_bmi > 40 THEN 40 ELSE dx_bmi END')} AS dx_bmi FROM cohort""")
def _(v):
    return v.cohort.select("studyid", overwrite("dx_bmi", F.col("dx_bmi") > 40, 40.0).alias("dx_bmi"))


@query("b7_null_fill", f"""
SELECT studyid, COALESCE(surgery_d, 0) AS surgery_d, {r6('COALESCE(dx_bmi, 1)')} AS dx_bmi FROM cohort""")
def _(v):
    return v.cohort.select("studyid", "surgery_d", "dx_bmi").fillna({"surgery_d": 0, "dx_bmi": 1.0})


@query("b8_membership", f"""
SELECT co_tox_lab_unit IS NULL OR co_tox_lab_unit IN (3, 11) AS scaled, {big('COUNT(*)')} AS n
FROM lab WHERE co_tox_lab_name IN (1, 2, 16) GROUP BY 1""")
def _(v):
    kept = v.lab.where(in_set(L.LAB, [1, 2, 16]))
    return kept.groupBy(in_set(L.UNIT, [3, 11, None]).alias("scaled")).agg(F.count("*").alias("n"))


@query("b9_keyed_correction", f"""
SELECT l.studyid, l.co_tox_lab_date, l.co_tox_lab_name, {r6("CASE WHEN c.studyid IS NOT NULL THEN ROUND_EVEN(CAST(121 AS DOUBLE) / 88.402, 2) ELSE l.co_tox_lab_result END")} AS co_tox_lab_result
FROM lab l LEFT JOIN (SELECT DISTINCT studyid, dx_dt FROM cohort) c ON l.studyid = c.studyid AND l.co_tox_lab_date = c.dx_dt""")
def _(v):
    fixes = v.cohort.select(
        "studyid",
        F.col("dx_dt").alias(L.DATE),
        L.umol_to_mg_dl(F.lit(121.0)).alias("corrected"),
    )
    out = X.correct_by_key(v.lab, fixes, ["studyid", L.DATE], L.RESULT)
    return out.select("studyid", L.DATE, L.LAB, L.RESULT)


@query("b10_exclusion_list", """
SELECT t.studyid, t.toxicityid, t.toxicityname FROM chart t WHERE t.toxicityname <> ''
  AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_quantity > 45 AND x.l_orderkey * 10 + x.l_linenumber = t.toxicityid)""")
def _(v):
    listed = v.table("lineitem").where("l_quantity > 45").selectExpr(
        "l_orderkey * 10 + l_linenumber AS toxicityid"
    )
    named = v.chart.where("toxicityname <> ''")
    return X.exclude_listed(named, listed, ["toxicityid"]).select(
        "studyid", "toxicityid", "toxicityname"
    )


@query("b11_conditional_exclusion", f"""
SELECT toxicityname, {big('COUNT(*)')} AS n FROM chart t JOIN cohort c ON t.studyid = c.studyid
WHERE NOT COALESCE(toxicityname = 'Neuropathy' AND (toxicitydate IS NULL OR toxicitydate <= first_chemo_dt), FALSE) GROUP BY 1""")
def _(v):
    joined = v.chart.join(v.cohort.select("studyid", "first_chemo_dt"), "studyid")
    bad = (F.col("toxicityname") == "Neuropathy") & (
        F.col("toxicitydate").isNull() | (F.col("toxicitydate") <= F.col("first_chemo_dt"))
    )
    return D.frequency(X.drop_when(joined, bad), ["toxicityname"])


@query("b12_constant_column", "SELECT DISTINCT studyid, 0 AS missing_lab, 1 AS missing_icd FROM lab")
def _(v):
    return v.lab.select("studyid").distinct().select(
        "studyid", F.lit(0).alias("missing_lab"), F.lit(1).alias("missing_icd")
    )


# ---- C. joins


@query("c1_left_join", f"""
SELECT c.studyid, {big('COUNT(i.studyid)')} AS n_code FROM cohort c LEFT JOIN icd i ON c.studyid = i.studyid GROUP BY 1""")
def _(v):
    # counted before the join: equal to joining every row and counting, without moving the rows
    codes = v.icd.groupBy("studyid").agg(F.count("*").alias("n_code"))
    return v.cohort.select("studyid").join(codes, "studyid", "left").fillna(0, ["n_code"])


@query("c2_inner_join", """
SELECT i.studyid, i.time_frame, i.anemia_flag_icd_n, l.anemia_g1_n FROM icdpf i JOIN labpf l ON i.studyid = l.studyid AND i.time_frame = l.time_frame""")
def _(v):
    src = sources(v)
    icd, lab = T.icd_flags(P.framed_icd(src)), T.lab_flags(P.graded_labs(src))
    return icd.join(lab, ["studyid", "time_frame"]).select(
        "studyid", "time_frame", "anemia_flag_icd_n", "anemia_g1_n"
    )


@query("c3_right_join_scaffold", """
SELECT s.studyid, s.time_frame, i.anemia_flag_icd FROM icdpf i RIGHT JOIN scaf s ON i.studyid = s.studyid AND i.time_frame = s.time_frame""")
def _(v):
    src = sources(v)
    frames = C.scaffold(C.adjuvant(v.cohort).select("studyid"))
    icd = T.icd_flags(P.framed_icd(src)).select("studyid", "time_frame", "anemia_flag_icd")
    return frames.join(icd, ["studyid", "time_frame"], "left")


@query("c4_full_outer_join", """
SELECT COALESCE(c.studyid, i.studyid) AS studyid, i.time_frame, c.neuropathy_tox, i.neuropathy_flag_icd
FROM chartpf c FULL JOIN (SELECT * FROM icdpf WHERE time_frame = 4) i ON c.studyid = i.studyid""")
def _(v):
    src = sources(v)
    chart = P.chart_person_flags(src).select("studyid", "neuropathy_tox")
    icd = T.icd_flags(P.framed_icd(src)).where("time_frame = 4")
    icd = icd.select("studyid", "time_frame", "neuropathy_flag_icd")
    return chart.join(icd, "studyid", "full")


@query("c5_null_safe_join", f"""
SELECT l.studyid, l.co_tox_lab_date, l.co_tox_lab_unit, {big('COUNT(*)')} AS n_pair
FROM (SELECT * FROM lab WHERE co_tox_lab_name = 1) l JOIN (SELECT DISTINCT studyid, co_tox_lab_date, co_tox_lab_unit FROM lab WHERE co_tox_lab_name = 17) h
  ON l.studyid = h.studyid AND l.co_tox_lab_unit IS NOT DISTINCT FROM h.co_tox_lab_unit AND l.co_tox_lab_date = h.co_tox_lab_date GROUP BY 1, 2, 3""")
def _(v):
    keys = ["studyid", L.DATE, L.UNIT]
    anc = v.lab.where(F.col(L.LAB) == 1).select(*keys)
    hgb = v.lab.where(F.col(L.LAB) == 17).select(*keys).distinct()
    return join_null_safe(anc, hgb, keys, "inner").groupBy(*keys).agg(F.count("*").alias("n_pair"))


@query("c6_same_day_lookup", f"""
SELECT s.studyid, s.co_tox_lab_date, {r6('s.pct')} AS pct, {r6('w.wbc')} AS wbc
FROM lab4_share s LEFT JOIN lab4_white w ON s.studyid = w.studyid AND s.co_tox_lab_date = w.co_tox_lab_date""")
def _(v):
    day = ["studyid", L.DATE]
    pct = v.lab.where(
        ((F.col(L.LAB) == 1) & (F.col(L.UNIT) == 4)) | ((F.col(L.LAB) == 21) & (F.col(L.RESULT) <= 100))
    ).select(*day, L.LAB, L.UNIT, F.col(L.RESULT).alias("pct"))
    thousand = F.col(L.UNIT).isNull() | (F.col(L.UNIT) == 3)
    wbc = v.lab.where(F.col(L.LAB) == 2).select(
        *day, L.UNIT, overwrite(L.RESULT, thousand, F.col(L.RESULT) * 1000).alias("wbc")
    )
    left = first_row(pct, day, [L.LAB, L.UNIT, "pct"]).select(*day, "pct")
    right = first_row(wbc, day, [L.UNIT, "wbc"]).select(*day, "wbc")
    return left.join(right, day, "left")


@query("c7_left_semi", """
SELECT studyid, co_tox_lab_date, co_tox_lab_name FROM lab WHERE studyid IN
 (SELECT studyid FROM lab WHERE co_tox_lab_name IN (6, 7, 8) AND co_tox_lab_normal_high IS NULL)""")
def _(v):
    gap = v.lab.where(F.col(L.LAB).isin(6, 7, 8) & F.col(L.HIGH).isNull()).select("studyid").distinct()
    return X.keep_listed(v.lab, gap, ["studyid"]).select("studyid", L.DATE, L.LAB)


@query("c8_left_anti", """
SELECT studyid, time_frame, 'icd only' AS side FROM (SELECT studyid, time_frame FROM icdpf EXCEPT SELECT studyid, time_frame FROM labpf) a
UNION ALL SELECT studyid, time_frame, 'lab only' FROM (SELECT studyid, time_frame FROM labpf EXCEPT SELECT studyid, time_frame FROM icdpf) b""")
def _(v):
    src, keys = sources(v), ["studyid", "time_frame"]
    # both key tables are looked at from either side
    icd = checkpointed(P.framed_icd(src).select(*keys).distinct())
    lab = checkpointed(P.limited_labs(src).select(*keys).distinct())
    return icd.join(lab, keys, "left_anti").withColumn("side", F.lit("icd only")).unionByName(
        lab.join(icd, keys, "left_anti").withColumn("side", F.lit("lab only"))
    )


@query("c9_coverage", f"""
SELECT {big('COUNT(*)')} AS n_rows, {big('COUNT(DISTINCT studyid)')} AS n_keys FROM icd WHERE studyid NOT IN (SELECT studyid FROM adj)""")
def _(v):
    return X.coverage(v.icd.select("studyid"), C.adjuvant(v.cohort), "studyid")


@query("c10_inner_by_filter", """
SELECT t.studyid, t.toxicityid, c.siteid FROM chart t JOIN adj c ON t.studyid = c.studyid""")
def _(v):
    people = C.adjuvant(v.cohort).select("studyid", "siteid")
    joined = v.chart.join(people, "studyid", "left").where(F.col("siteid").isNotNull())
    return joined.select("studyid", "toxicityid", "siteid")


@query("c11_self_join", """
SELECT r.id, o.id AS recruiter, o.y AS recruiter_y FROM rds r JOIN rds o ON r.recruiter_id = o.id""")
def _(v):
    owners = v.rds.select(F.col("id").alias("recruiter"), F.col("y").alias("recruiter_y"))
    return v.rds.select("id", F.col("recruiter_id").alias("recruiter")).join(owners, "recruiter")


# ---- E. aggregations


@query("e1_grouped_count", f"SELECT toxicityname, {big('COUNT(*)')} AS n FROM chart GROUP BY 1")
def _(v):
    return D.frequency(v.chart, ["toxicityname"])


@query("e2_strict_sum", f"""
SELECT co_tox_lab_name, co_tox_lab_unit, {r6('CASE WHEN COUNT(*) = COUNT(co_tox_lab_result) THEN SUM(co_tox_lab_result) END')} AS total FROM lab GROUP BY 1, 2""")
def _(v):
    return v.lab.groupBy(L.LAB, L.UNIT).agg(strict_sum(L.RESULT).alias("total"))


@query("e3_sum_skipping_null", f"SELECT co_tox_lab_name, {r6('SUM(co_tox_lab_result)')} AS total FROM lab GROUP BY 1")
def _(v):
    return v.lab.groupBy(L.LAB).agg(F.sum(L.RESULT).alias("total"))


@query("e4_null_count", f"""
SELECT co_tox_lab_name, {big('COUNT(*) FILTER (co_tox_lab_result IS NULL)')} AS n_null FROM lab GROUP BY 1""")
def _(v):
    return v.lab.groupBy(L.LAB).agg(null_count(L.RESULT).alias("n_null"))


@query("e5_distinct_count", f"SELECT toxicityname, {big('COUNT(DISTINCT studyid)')} AS n_patient FROM chart GROUP BY 1")
def _(v):
    return v.chart.groupBy("toxicityname").agg(F.countDistinct("studyid").alias("n_patient"))


@query("e6_conditional_distinct", f"""
SELECT co_tox_lab_name, {big('COUNT(DISTINCT CASE WHEN co_tox_lab_normal_low IS NULL THEN studyid END)')} AS n_patient FROM lab GROUP BY 1""")
def _(v):
    gap = F.when(F.col(L.LOW).isNull(), F.col("studyid"))
    return v.lab.groupBy(L.LAB).agg(F.countDistinct(gap).alias("n_patient"))


def _limit_profile(limit: str, labs: str) -> str:
    return f"""
SELECT studyid, time_frame, co_tox_lab_name, {big('COUNT(*)')} AS n, {r6(f'MEDIAN({limit})')} AS median_limit,
  {r6(f'MIN({limit})')} AS min_limit, {r6(f'MAX({limit})')} AS max_limit,
  CASE WHEN MIN({limit}) = MAX({limit}) THEN 1 ELSE 0 END AS ind
FROM rawf WHERE co_tox_lab_name IN ({labs}) AND {limit} IS NOT NULL GROUP BY 1, 2, 3"""


@query("e7_limit_profile", _limit_profile(L.LOW, "1, 16, 17"))
def _(v):
    return L.limit_profile(P.framed_labs(sources(v), clean=False), L.LOW, [1, 16, 17])


@query("e7_limit_profile_high", _limit_profile(L.HIGH, "6, 7, 8"))
def _(v):
    return L.limit_profile(P.framed_labs(sources(v), clean=False), L.HIGH, [6, 7, 8])


_DIST = (
    "{n} AS n, {q1} AS q1, {med} AS median, {q3} AS q3, {lo} AS min, {hi} AS max, {mean} AS mean"
)


def dist_sql(x: str) -> str:
    return _DIST.format(
        n=big(f"COUNT({x})"),
        q1=r6(f"QUANTILE_CONT({x}, 0.25)"),
        med=r6(f"MEDIAN({x})"),
        q3=r6(f"QUANTILE_CONT({x}, 0.75)"),
        lo=r6(f"MIN({x})"),
        hi=r6(f"MAX({x})"),
        mean=r6(f"AVG({x})"),
    )


@query("e8_distribution", f"""
SELECT co_tox_lab_name, time_frame, {dist_sql('co_tox_lab_result')} FROM rawf WHERE co_tox_lab_result IS NOT NULL GROUP BY 1, 2""")
def _(v):
    framed = P.framed_labs(sources(v), clean=False)
    return L.distribution(framed, [L.LAB, "time_frame"], L.RESULT)


@query("e9_column_summary", f"""
SELECT co_tox_lab_name, co_tox_lab_unit, {dist_sql('co_tox_lab_normal_low')}, {big('COUNT(*) FILTER (co_tox_lab_normal_low IS NULL)')} AS n_null FROM lab GROUP BY 1, 2""")
def _(v):
    return D.column_summary(v.lab, [L.LAB, L.UNIT], L.LOW)


@query("e10_frequency", f"SELECT surgery_d, {big('COUNT(*)')} AS n FROM cohort GROUP BY 1")
def _(v):
    return D.frequency(v.cohort, ["surgery_d"])


@query("e11_two_way_table", f"""
SELECT tx_group, {big('COUNT(*) FILTER (any_chemo = 0)')} AS any_chemo_0, {big('COUNT(*) FILTER (any_chemo = 1)')} AS any_chemo_1,
  {big('COUNT(*) FILTER (any_chemo IS NULL)')} AS any_chemo_null FROM grouped GROUP BY 1""")
def _(v):
    return D.crosstab(C.treatment_group(v.cohort), "tx_group", "any_chemo", [0, 1])


@query("e12_any_event", """
SELECT studyid, CASE WHEN SUM(kidney_flag_icd) = 0 THEN 0 ELSE 1 END AS kidney_flag_icd FROM icd GROUP BY 1""")
def _(v):
    return T.icd_flags(v.icd, ["kidney_flag_icd"], ("studyid",)).select("studyid", "kidney_flag_icd")


@query("e13_percent_of_group", f"""
SELECT co_tox_lab_name, {r6('100.0 * COUNT(*) FILTER (co_tox_lab_normal_low IS NULL) / COUNT(*)')} AS pct FROM lab GROUP BY 1""")
def _(v):
    return v.lab.groupBy(L.LAB).agg(
        (100 * ratio(null_count(L.LOW), F.count("*"))).alias("pct")
    )


@query("e14_lab_presence", " UNION ALL ".join(
    f"SELECT '{c}' AS condition, {big('COUNT(*)')} AS total, {big(f'COUNT(*) - COALESCE(SUM(missing_lab_{c}), 0)')} AS n,"
    f" {r6(f'100.0 * (COUNT(*) - SUM(missing_lab_{c})) / NULLIF(COUNT(*), 0)')} AS pct FROM val"
    for c in ("kidney", "liver", "anemia", "neutropenia", "thrombocytopenia")))
def _(v):
    from .registry import SETTINGS

    return D.lab_presence(P.validation_table(sources(v), SETTINGS), T.LAB_CONDITIONS)


def _missing_mode(limit: str, labs: str) -> str:
    return f"""
SELECT time_frame, co_tox_lab_name, n_patient, missing_ind, n_missing, {r6('100.0 * n_missing / n_patient')} AS percent_missing FROM (
 SELECT time_frame, co_tox_lab_name, missing_ind, {big('COUNT(*)')} AS n_missing, {big('SUM(COUNT(*)) OVER (PARTITION BY time_frame, co_tox_lab_name)')} AS n_patient FROM (
  SELECT studyid, time_frame, co_tox_lab_name, CASE WHEN COUNT(*) = COUNT(*) FILTER ({limit} IS NULL) THEN 'full'
    WHEN COUNT(*) FILTER ({limit} IS NULL) = 0 THEN 'none' ELSE 'partial' END AS missing_ind
  FROM rawf WHERE co_tox_lab_name IN ({labs}) GROUP BY 1, 2, 3) p GROUP BY 1, 2, 3) q WHERE missing_ind <> 'none'"""


@query("e15_missing_mode", _missing_mode(L.LOW, "1, 16, 17"))
def _(v):
    return L.missing_mode_report(P.framed_labs(sources(v), clean=False), L.LOW, [1, 16, 17])


@query("e15_missing_mode_high", _missing_mode(L.HIGH, "6, 7, 8"))
def _(v):
    return L.missing_mode_report(P.framed_labs(sources(v), clean=False), L.HIGH, [6, 7, 8])


# ---- F. windows, sorts, dedup, set operations


@query("f1_row_number", f"""
SELECT o_custkey AS studyid, o_orderkey, {big('ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)')} AS rn FROM orders""")
def _(v):
    rows = v.table("orders").select(
        F.col("o_custkey").alias("studyid"), "o_orderkey", F.col("o_orderdate").cast("date").alias("od")
    )
    return number_rows(rows, ["studyid"], [F.col("od"), F.col("o_orderkey")]).drop("od")


@query("f2_first_event", """
SELECT studyid, MIN(toxicitydate) AS first_date FROM chartw WHERE toxicityname = 'Neuropathy' GROUP BY 1""")
def _(v):
    hits = P.chart_in_window(sources(v)).where("toxicityname = 'Neuropathy'")
    return T.first_dates(hits, "toxicitydate", "first_date")


@query("f3_first_row_per_day", f"""
SELECT studyid, co_tox_lab_date, co_tox_lab_name, co_tox_lab_unit, {r6('co_tox_lab_result')} AS co_tox_lab_result, {r6('co_tox_lab_normal_low')} AS co_tox_lab_normal_low, {r6('co_tox_lab_normal_high')} AS co_tox_lab_normal_high
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY studyid, co_tox_lab_date ORDER BY co_tox_lab_name NULLS FIRST, co_tox_lab_unit NULLS FIRST,
  co_tox_lab_result NULLS FIRST, co_tox_lab_normal_low NULLS FIRST, co_tox_lab_normal_high NULLS FIRST) AS k FROM lab) q WHERE k = 1""")
def _(v):
    return first_row(v.lab, ["studyid", L.DATE], [L.LAB])


@query("f4_sort", "SELECT studyid, time_frame, anemia_flag_icd_n FROM icdpf ORDER BY 1, 2")
def _(v):
    flags = T.icd_flags(P.framed_icd(sources(v)))
    return flags.select("studyid", "time_frame", "anemia_flag_icd_n").orderBy("studyid", "time_frame")


@query("f5_distinct", "SELECT DISTINCT co_tox_lab_name, co_tox_lab_unit FROM lab")
def _(v):
    return v.lab.select(L.LAB, L.UNIT).distinct()


@query("f6_union_fill", f"""
SELECT studyid, co_tox_dx_code_date AS event_date, anemia_flag_icd, CAST(NULL AS DOUBLE) AS co_tox_lab_result FROM icd
UNION ALL SELECT studyid, co_tox_lab_date, NULL, {r6('co_tox_lab_result')} FROM lab""")
def _(v):
    codes = v.icd.select("studyid", F.col("co_tox_dx_code_date").alias("event_date"), "anemia_flag_icd")
    labs = v.lab.select("studyid", F.col(L.DATE).alias("event_date"), L.RESULT)
    return X.union_fill(codes, labs)


@query("f7_key_equality", f"""
SELECT {big('COUNT(*)')} AS n FROM ((SELECT studyid, time_frame FROM pf EXCEPT ALL SELECT studyid, time_frame FROM scaf)
 UNION ALL (SELECT studyid, time_frame FROM scaf EXCEPT ALL SELECT studyid, time_frame FROM pf)) q""")
def _(v):
    return Q.keys_differ(
        P.person_frames(sources(v)), C.scaffold(C.adjuvant(v.cohort)), ["studyid", "time_frame"]
    )


@query("f8_running_estimate", f"""
SELECT id, {big('ROW_NUMBER() OVER w')} AS m, {r6('SUM(y_cont / network_size) OVER w / SUM(1.0 / network_size) OVER w')} AS estimate
FROM rds WINDOW w AS (ORDER BY sample_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(v):
    return R.convergence(v.rds, R.Frame(outcome="y_cont"))


@query("f9_running_by_group", f"""
SELECT y_cat, id, {big('ROW_NUMBER() OVER w')} AS m, {r6('SUM(y_cont / network_size) OVER w / SUM(1.0 / network_size) OVER w')} AS estimate
FROM rds WINDOW w AS (PARTITION BY y_cat ORDER BY sample_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(v):
    return R.convergence(v.rds, R.Frame(outcome="y_cont"), ["y_cat"])


# ---- O. scalar functions


@query("o1_scalar_functions", f"""
SELECT studyid, {r6('SQRT(dx_bmi)')} AS root, {big('ROUND_EVEN(dx_bmi * 1.25, 0)')} AS even, {big('TRUNC((dx_dt - DATE ' + "'1996-01-01'" + ') / 365)')} AS years,
  {big('YEAR(dx_dt)')} AS yr, LOWER('ID-' || CAST(studyid AS VARCHAR)) AS tag, {big('last_chemo_dt - first_chemo_dt')} AS days FROM cohort""")
def _(v):
    from ..functions.nulls import trunc_years

    return v.cohort.select(
        "studyid",
        F.sqrt("dx_bmi").alias("root"),
        half_even(F.col("dx_bmi") * 1.25).cast("long").alias("even"),
        trunc_years("dx_dt", F.to_date(F.lit("1996-01-01"))).cast("long").alias("years"),
        F.year("dx_dt").cast("long").alias("yr"),
        F.lower(F.concat(F.lit("ID-"), F.col("studyid").cast("string"))).alias("tag"),
        F.datediff("last_chemo_dt", "first_chemo_dt").cast("long").alias("days"),
    )
