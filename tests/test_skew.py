"""A hot key must be split by the runtime plan, and results must not change."""

import re

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohort as C
from cohortloom.operators import tox as T
from cohortloom.operators.scale import tune

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield tune(spark)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_cohort_join_splits_a_hot_patient(small_limits):
    spark = small_limits
    n = 120_000
    labs = spark.range(0, n, 1, 16).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7L ELSE id % 400 END AS studyid",
        "date_add(date'2010-01-01', CAST(id % 300 AS INT)) AS co_tox_lab_date",
        "CAST(17 AS INT) AS co_tox_lab_name",
        "6D + id % 9 AS co_tox_lab_result",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE 11D END AS co_tox_lab_normal_low",
        "CAST(NULL AS DOUBLE) AS co_tox_lab_normal_high",
        "CAST(NULL AS DOUBLE) AS crcl",
        "CAST(uuid() AS STRING) AS note",
    )
    people = spark.range(400).selectExpr(
        "id AS studyid", "1 AS siteid", "date'2010-02-01' AS dx_dt", "date'2010-04-01' AS surgery_dt",
        "date'2010-06-01' AS first_chemo_dt", "date'2010-09-01' AS last_chemo_dt")
    framed = C.bucket_by_milestones(labs.join(people, "studyid"), "co_tox_lab_date")
    kept = framed.withColumn("size", F.length("note"))
    flags = T.any_lab_flags(kept).select("studyid", "time_frame", "anemia_g2_lab", "anemia_lab_rows")
    rows = flags.collect()
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    hot = {r.time_frame: r.anemia_lab_rows for r in rows if r.studyid == 7}
    days = [(i % 300) for i in range(n) if i % 3 == 0 or i % 400 == 7]
    ends = [31, 90, 151, 243]
    want = {f + 1: sum(lo < d <= hi for d in days)
            for f, (lo, hi) in enumerate(zip([-1, *ends[:-1]], ends))}
    assert hot == want
    assert all(r.anemia_g2_lab == 1 for r in rows)


def test_facts_shrink_before_the_join(spark):
    """Codes and chart rows reach the cohort join as one row per person and day."""
    from cohortloom.catalog.registry import sources
    from cohortloom.plans import toxicity as P
    from cohortloom.sources.views import Views

    src = sources(Views(spark, "/root/testdata/sf0.001"))
    for df in (P.framed_icd(src), P.chart_person_flags(src)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        daily = re.search(r"Aggregate \[studyid#\d+L, (toxicitydate|co_tox_dx_code_date)#\d+\]", plan)
        assert daily and plan.index("Join Inner") < daily.start()
