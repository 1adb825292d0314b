"""Cohort construction: treatment sequence, time frames, eligibility, derived groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import all_of, col, cut, overwrite, r_case, r_ifelse, recode, trunc_years

MILESTONES = ["dx_dt", "surgery_dt", "first_chemo_dt", "last_chemo_dt"]
ADJUVANT = "Surgery before chemo"

# Group boundaries and labels.
AGE_BREAKS = [50, 65, 75]
AGE_LABELS = ["<50", "50-64", "65-74", "75+"]
BMI_BREAKS = [18.5, 25.0, 30.0, 35.0, 40.0]
BMI_LABELS = ["<18.5", "18.5 - <25", "25 - <30", "30 - <35", "35 - <40", "40+"]
RACE_LABELS = {0: "White", 1: "Black", 2: "Asian", 3: "Hispanic", 4: "Other"}
ERA2_BREAKS = ["2012-05-01"]
ERA2_LABELS = ["Jan 2004 - April 2012", "May 2012 - Dec 2019"]
ERA3_BREAKS = ["2008-01-01", "2012-05-01"]
ERA3_LABELS = ["Jan 2004 - Dec 2007", "Jan 2008 - April 2012", "May 2012 - Dec 2015"]


def treatment_group(cohort: DataFrame, name: str = "tx_group") -> DataFrame:
    """Order of surgery and chemotherapy; same-day surgery and chemotherapy counts as after."""
    none, chemo = F.col("surgery_d") == 0, F.col("any_chemo")
    sequence = r_case(
        [
            (none & (chemo == 0), "Neither"),
            (none & (chemo == 1), "Only chemo"),
            (F.col("surgery_dt").isNull(), None),
            (chemo == 0, "Only surgery"),
            (F.col("surgery_dt") < F.col("first_chemo_dt"), "Surgery before chemo"),
        ],
        "Surgery after chemo",
    )
    return cohort.withColumn(name, F.when(F.col("surgery_d").isNotNull(), sequence))


def adjuvant(cohort: DataFrame) -> DataFrame:
    return treatment_group(cohort).where(F.col("tx_group") == ADJUVANT)


def frame_of(date: Column | str, milestones: list[str] = MILESTONES) -> Column:
    """1-based index of the first milestone on or after ``date``; null beyond the last one."""
    return r_case([(col(date) <= F.col(m), i) for i, m in enumerate(milestones, 1)], None)


def bucket_by_milestones(
    events: DataFrame, date: str, milestones: list[str] = MILESTONES, name: str = "time_frame"
) -> DataFrame:
    framed = events.withColumn(name, frame_of(date, milestones).cast("int"))
    return framed.where(F.col(name).isNotNull())


def chart_window(chart: DataFrame, date: str = "toxicitydate") -> DataFrame:
    """Chart events after first and up to last chemotherapy, for surgery-before-chemo patients."""
    return chart.where(
        (F.col("surgery_d") == 1)
        & F.col("surgery_dt").isNotNull()
        & (F.col("surgery_dt") < F.col("first_chemo_dt"))
        & (col(date) > F.col("first_chemo_dt"))
        & (col(date) <= F.col("last_chemo_dt"))
    )


def eligibility_steps(min_year: int = 2004) -> list[tuple[str, Column]]:
    """Named keep-conditions in the order they are applied."""
    undated = (F.col("any_chemo") == 1) & F.col("first_chemo_dt").isNull()
    return [
        ("chemo date known", ~F.coalesce(undated, F.lit(False))),
        ("diagnosis year", F.year("dx_dt") >= min_year),
        ("no trial", F.col("final_rct") == 0),
    ]


def eligible(cohort: DataFrame, min_year: int = 2004) -> DataFrame:
    return cohort.where(all_of([c for _, c in eligibility_steps(min_year)]))


def attrition(df: DataFrame, steps: list[tuple[str, Column]], key: str = "studyid") -> DataFrame:
    """Rows and distinct patients left after each step and removed by it; one pass over ``df``."""
    kept, conds = [], [F.lit(True)]
    for _, cond in steps:
        conds.append(F.coalesce(cond, F.lit(False)))
    for i in range(len(conds)):
        kept.append(all_of(conds[: i + 1]))
    # every patient is reduced to its row counts per step before anything is compared
    per_key = df.groupBy(key).agg(*[F.count_if(k).alias(f"r{i}") for i, k in enumerate(kept)])
    wide = per_key.agg(
        *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(kept))],
        *[F.count_if((F.col(f"r{i}") > 0) & F.col(key).isNotNull()).alias(f"p{i}")
          for i in range(len(kept))],
    )
    rows = []
    for i, label in enumerate(["start", *[s for s, _ in steps]]):
        back = max(i - 1, 0)
        rows.append(
            F.struct(
                F.lit(i).alias("step"),
                F.lit(label).alias("label"),
                F.col(f"r{i}").alias("n_rows"),
                F.col(f"p{i}").alias("n_patients"),
                (F.col(f"r{back}") - F.col(f"r{i}")).alias("rows_removed"),
                (F.col(f"p{back}") - F.col(f"p{i}")).alias("patients_removed"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def scaffold(cohort: DataFrame, frames: int = 4, name: str = "time_frame") -> DataFrame:
    """One row per person and frame 1..frames."""
    return cohort.withColumn(name, F.explode(F.array(*[F.lit(i) for i in range(1, frames + 1)])))


def site_from_threshold(df: DataFrame, threshold: int, key: str = "studyid") -> DataFrame:
    return df.withColumn("siteid", r_ifelse(F.col(key) > threshold, 2, 1))


def age_at(date: Column | str, dx_age: str = "dx_age", dx_dt: str = "dx_dt") -> Column:
    return F.col(dx_age) + trunc_years(date, dx_dt)


def date_cut(x: Column | str, breaks: list[str], labels: list[str]) -> Column:
    return cut(x, [F.to_date(F.lit(b)) for b in breaks], labels)


def derived_groups(
    cohort: DataFrame,
    era2: tuple[list[str], list[str]] = (ERA2_BREAKS, ERA2_LABELS),
    era3: tuple[list[str], list[str]] = (ERA3_BREAKS, ERA3_LABELS),
) -> DataFrame:
    """Age, BMI, era and race groups plus labelled codes used by the descriptive tables."""
    race = overwrite("race_eth_model", F.col("race_eth_model") > 3, 4)
    return cohort.withColumns(
        {
            "age_g": cut("dx_age", AGE_BREAKS, AGE_LABELS),
            "race_new": recode(race.cast("int"), RACE_LABELS),
            "dx_bmi_grp": cut("dx_bmi", BMI_BREAKS, BMI_LABELS),
            "chemo_bmi_grp": cut("chemo_bmi", BMI_BREAKS, BMI_LABELS),
            "dx_year_grp": date_cut("dx_dt", *era2),
            "dx_year_grp_more": date_cut("dx_dt", *era3),
        }
    )


def label_codes(df: DataFrame, labels: dict[str, dict]) -> DataFrame:
    """Replace each listed code column by its label; unknown codes become null."""
    return df.withColumns({c: recode(F.col(c).cast("int"), m) for c, m in labels.items()})
