"""Cohort, diagnosis, laboratory, chart, sampling, effect and graph views over the test tables."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scale import tune
from .io import scan_table

CHART_NAMES = [
    "Anemia",
    "Neutropenia/Leukopenia",
    "Thrombocytopenia",
    "Neuropathy",
    "Renal toxicity",
    "Hepatic toxicity",
]


class Views:
    """Lazily built input views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return scan_table(self.spark, os.path.join(self.folder, f"{name}.parquet"))

    @cached_property
    def cohort(self) -> DataFrame:
        orders = self.table("orders").select(
            F.col("o_custkey").alias("studyid"),
            "o_orderkey",
            F.col("o_orderdate").cast("date").alias("od"),
        )
        # the rank filter prunes each map task to six rows per key before the shuffle
        rank = F.row_number().over(W.partitionBy("studyid").orderBy("od", "o_orderkey"))
        early = orders.withColumn("rn", rank).where("rn <= 6").groupBy("studyid").agg(
            *[F.max(F.when(F.col("rn") == k, F.col("od"))).alias(f"d{k}") for k in (1, 3, 5, 6)]
        )
        span = orders.groupBy("studyid").agg(F.count("*").alias("n"), F.max("od").alias("last"))
        who = self.table("customer").select(F.col("c_custkey").alias("studyid"), "c_nationkey")
        return (
            who.join(span, "studyid")
            .join(early, "studyid")
            .selectExpr(
                "studyid",
                "CASE WHEN c_nationkey < 13 THEN 1 ELSE 2 END AS siteid",
                "d1 AS dx_dt",
                "CASE WHEN studyid % 50 = 0 THEN NULL WHEN studyid % 27 = 0 THEN 0 WHEN n >= 6"
                " THEN 1 ELSE 0 END AS surgery_d",
                "CASE WHEN n >= 6 THEN CASE WHEN studyid % 5 = 0 THEN d6 ELSE d3 END END"
                " AS surgery_dt",
                "CASE WHEN n >= 8 AND studyid % 11 <> 0 THEN 1 ELSE 0 END AS any_chemo",
                "CASE WHEN n >= 8 AND studyid % 11 <> 0 AND studyid % 23 <> 0 THEN d5 END"
                " AS first_chemo_dt",
                "CASE WHEN n >= 8 AND studyid % 11 <> 0 THEN last END AS last_chemo_dt",
                "30 + studyid % 55 AS dx_age",
                "CASE WHEN studyid % 17 = 0 THEN NULL ELSE 50D + studyid % 40 END AS final_dx_wt",
                "CASE WHEN studyid % 19 = 0 THEN NULL ELSE 48D + studyid % 42 END AS final_2nd_wt",
                "CASE WHEN studyid % 13 = 0 THEN NULL ELSE 16D + studyid % 28 END AS dx_bmi",
                "CASE WHEN studyid % 21 = 0 THEN NULL ELSE 17D + studyid % 27 END AS chemo_bmi",
                "CASE WHEN studyid % 40 = 0 THEN 1 ELSE 0 END AS final_rct",
                "CASE WHEN studyid % 31 = 0 THEN NULL ELSE studyid % 6 END AS race_eth_model",
                "1 + studyid % 3 AS stage_d",
                "CASE WHEN studyid % 37 = 0 THEN NULL ELSE 1 + studyid % 2 END AS erpr_model",
                "CASE WHEN studyid % 4 < 2 THEN 1 ELSE 2 END AS her2_model2",
                "CASE WHEN studyid % 5 > 2 THEN 2 ELSE 1 END AS surgery_type_model",
                "CASE WHEN studyid % 41 = 0 THEN NULL ELSE 1 + studyid % 4 END AS income_quart",
                "CASE WHEN studyid % 43 = 0 THEN NULL WHEN studyid % 7 = 0 THEN 1 ELSE 0 END"
                " AS cycle1_dose_reduction90",
            )
        )

    @cached_property
    def icd(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey AS studyid",
            "CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END"
            " AS co_tox_dx_code_date",
            "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS anemia_flag_icd",
            "CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS neutropenia_flag_icd",
            "CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS thrombocytopenia_flag_icd",
            "CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS kidney_flag_icd",
            "CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS liver_flag_icd",
            "CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS neuropathy_flag_icd",
            "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END"
            " AS neuropathy_flag_icd_reg",
            "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END"
            " AS neuropathy_flag_icd_se",
        )

    def _with_owner(self, line: DataFrame) -> DataFrame:
        owner = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("studyid"))
        return line.join(owner, line.l_orderkey == owner.o_orderkey)

    @cached_property
    def lab(self) -> DataFrame:
        lab = (
            "CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 17 WHEN 3 THEN 16 WHEN 4 THEN 6"
            " WHEN 5 THEN 11 WHEN 6 THEN 5 ELSE 2 END"
        )
        # the few values of a lab row are less to shuffle than the keys they are made from
        rows = self.table("lineitem").withColumn("lab", F.expr(lab)).selectExpr(
            "l_orderkey",
            "CAST(l_shipdate AS DATE) AS co_tox_lab_date",
            "lab AS co_tox_lab_name",
            "CASE WHEN l_suppkey % 33 = 0 THEN NULL WHEN lab = 1 AND l_suppkey % 20 = 0 THEN 4"
            " WHEN lab IN (1, 2, 16) THEN 3 WHEN lab = 6 THEN 6 ELSE 12 END AS co_tox_lab_unit",
            "CASE WHEN l_partkey % 97 = 0 THEN NULL"
            " WHEN lab = 1 AND l_suppkey % 20 = 0 THEN l_quantity * 2D"
            " WHEN lab = 1 THEN l_quantity * 0.1D WHEN lab = 17 THEN 6D + l_quantity * 0.2D"
            " WHEN lab = 16 THEN l_quantity * 8D WHEN lab = 6 THEN l_quantity * 5D"
            " WHEN lab = 11 THEN 0.3D + l_quantity * 0.1D WHEN lab = 5 THEN l_quantity * 0.08D"
            " ELSE l_quantity * 0.2D END AS co_tox_lab_result",
            "CAST(CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN lab = 1 THEN 1.4 + (l_partkey % 4) * 0.3"
            " WHEN lab = 17 THEN 10.0 + (l_partkey % 4) * 0.5"
            " WHEN lab = 16 THEN 140.0 + (l_partkey % 2) * 10.0 END AS DOUBLE)"
            " AS co_tox_lab_normal_low",
            "CAST(CASE WHEN l_suppkey % 9 = 0 THEN NULL"
            " WHEN lab = 6 THEN 35.0 + (l_partkey % 3) * 5.0 END AS DOUBLE)"
            " AS co_tox_lab_normal_high",
        )
        return self._with_owner(rows).select("studyid", *rows.columns[1:])

    @cached_property
    def chart(self) -> DataFrame:
        arms = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CHART_NAMES))
        return self._with_owner(self.table("lineitem")).where("l_returnflag = 'R'").selectExpr(
            "studyid",
            "l_orderkey * 10 + l_linenumber AS toxicityid",
            f"CASE l_partkey % 7 {arms} ELSE '' END AS toxicityname",
            "CASE WHEN l_suppkey % 30 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END"
            " AS toxicitydate",
        )

    @cached_property
    def rds(self) -> DataFrame:
        degree = self.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(
            F.count("*").alias("n")
        )
        who = self.table("customer").withColumnRenamed("c_custkey", "id")
        return who.join(degree, "id", "left").selectExpr(
            "id",
            "CASE WHEN id < 10 THEN NULL ELSE (id - 10) DIV 3 END AS recruiter_id",
            "COALESCE(n, 1) AS network_size",
            "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS y",
            "c_acctbal AS y_cont",
            "c_mktsegment AS y_cat",
            "id AS sample_order",
        )

    @cached_property
    def coupons(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS id",
            "c_custkey AS own_coupon",
            "10 + 3 * c_custkey AS coupon_1",
            "11 + 3 * c_custkey AS coupon_2",
            "12 + 3 * c_custkey AS coupon_3",
        )

    @cached_property
    def effects(self) -> DataFrame:
        orders, customer = self.table("orders"), self.table("customer")
        return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(
            "o_orderkey AS id",
            "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS x",
            "CASE WHEN o_orderstatus = 'F' OR (o_orderpriority = '1-URGENT' AND c_acctbal > 4000)"
            " THEN 1 ELSE 0 END AS y",
            "CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS z",
            "c_mktsegment AS u",
            "c_nationkey AS c",
            "c_acctbal AS z_cont",
        )

    @cached_property
    def dag_edges(self) -> DataFrame:
        part = self.table("part")
        step = part.selectExpr(
            "p_partkey DIV 20 AS graph_id", "p_partkey % 20 AS src", "p_size % 2 = 0 AS even"
        )
        jumps = F.array(
            2 * F.col("src") + 1, 2 * F.col("src") + 2, F.when(F.col("even"), F.col("src") + 3)
        )
        return (
            step.select("graph_id", "src", F.explode(jumps).alias("dst"))
            .where("dst < 20")
            .distinct()
        )
