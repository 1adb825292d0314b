"""Toxicity phenotypes: graded rows, person-frame flags, completion and merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import any_flag, r_case, r_ifelse, ratio, strict_sum
from .cohort import age_at, scaffold
from .labs import (
    ALP,
    ALT,
    ANC,
    AST,
    BILI_TOTAL,
    CREATININE,
    HEMOGLOBIN,
    HEPATIC,
    HIGH,
    LAB,
    LIMIT_RULES,
    LOW,
    PLATELETS,
    RESULT,
    LimitRule,
    impute_constant,
)

ID, FRAME = "studyid", "time_frame"
GRADES = (1, 2, 3)


@dataclass(frozen=True)
class Cut:
    """``result op factor * limit`` (or ``result op factor`` when no limit column applies)."""

    lab: int
    op: str
    factor: float
    limit: str | None = None

    def column(self) -> Column:
        bound = F.lit(self.factor) if self.limit is None else F.lit(self.factor) * F.col(self.limit)
        x = F.col(RESULT)
        return {"<": x < bound, ">": x > bound, ">=": x >= bound}[self.op]


@dataclass(frozen=True)
class Condition:
    name: str
    labs: tuple[int, ...]
    chart_name: str
    grades: dict[int, tuple[Cut, ...]]


# Grading cut-offs per condition and grade.
CONDITIONS = {
    c.name: c
    for c in (
        Condition(
            "liver",
            tuple(HEPATIC),
            "Hepatic toxicity",
            {
                1: (Cut(BILI_TOTAL, ">=", 1.2), Cut(AST, ">=", 2.0, HIGH),
                    Cut(ALT, ">=", 2.0, HIGH), Cut(ALP, ">", 2.5, HIGH)),
                2: (Cut(BILI_TOTAL, ">", 1.5), Cut(AST, ">", 3.0, HIGH),
                    Cut(ALT, ">", 3.0, HIGH), Cut(ALP, ">", 2.5, HIGH)),
                3: (Cut(BILI_TOTAL, ">", 3.0), Cut(AST, ">", 5.0, HIGH),
                    Cut(ALT, ">", 5.0, HIGH), Cut(ALP, ">", 5.0, HIGH)),
            },
        ),
        Condition(
            "anemia",
            (HEMOGLOBIN,),
            "Anemia",
            {
                1: (Cut(HEMOGLOBIN, "<", 1.0, LOW),),
                2: (Cut(HEMOGLOBIN, "<", 10.0),),
                3: (Cut(HEMOGLOBIN, "<", 8.0),),
            },
        ),
        Condition(
            "neutropenia",
            (ANC,),
            "Neutropenia/Leukopenia",
            {
                1: (Cut(ANC, "<", 1.0, LOW),),
                2: (Cut(ANC, "<", 1500.0),),
                3: (Cut(ANC, "<", 1000.0),),
            },
        ),
        Condition(
            "thrombocytopenia",
            (PLATELETS,),
            "Thrombocytopenia",
            {
                1: (Cut(PLATELETS, "<", 1.0, LOW),),
                2: (Cut(PLATELETS, "<", 75000.0),),
                3: (Cut(PLATELETS, "<", 50000.0),),
            },
        ),
    )
}
RENAL_CUTS = {1: 60.0, 2: 30.0, 3: 15.0}
CHART_CONDITIONS = {
    "kidney": "Renal toxicity",
    **{c.name: c.chart_name for c in CONDITIONS.values()},
    "neuropathy": "Neuropathy",
}
LAB_CONDITIONS = ["kidney", *CONDITIONS]
ICD_CONDITIONS = ["kidney", *CONDITIONS, "neuropathy"]
ICD_FLAGS = [
    *[f"{c}_flag_icd" for c in ICD_CONDITIONS],
    "neuropathy_flag_icd_reg",
    "neuropathy_flag_icd_se",
]


def creatinine_clearance(lab: DataFrame) -> DataFrame:
    """Clearance of serum creatinine rows: early frames use the first weight, later the second."""
    early = F.col(FRAME) < 3
    weight = r_ifelse(early, F.col("final_dx_wt"), F.col("final_2nd_wt"))
    top = (140 - age_at("co_tox_lab_date")) * weight * 0.85
    # a zero result means unbounded clearance, which no grade counts
    value = F.when((F.col(RESULT) == 0) & weight.isNotNull(), float("inf")).otherwise(
        ratio(top, 72 * F.col(RESULT))
    )
    return lab.withColumn("crcl", F.when(F.col(LAB) == CREATININE, value))


def grade_rows(lab: DataFrame) -> DataFrame:
    """Row flags ``<condition>_g1..3``: 0/1 on rows of the condition's labs, null elsewhere."""
    flags = {}
    for cond in CONDITIONS.values():
        mine = F.col(LAB).isin(list(cond.labs))
        for grade in GRADES:
            arms = [((F.col(LAB) == c.lab) & c.column(), 1) for c in cond.grades[grade]]
            flags[f"{cond.name}_g{grade}"] = F.when(mine, r_case(arms, 0))
    for grade, bound in RENAL_CUTS.items():
        flags[f"kidney_g{grade}"] = r_ifelse(F.col("crcl") < bound, 1, 0)
    return lab.withColumns(flags)


def lab_rows_of(condition: str) -> Column:
    labs = [CREATININE] if condition == "kidney" else list(CONDITIONS[condition].labs)
    return F.col(LAB).isin(labs)


def lab_flags(graded: DataFrame, keys: tuple[str, ...] = (ID, FRAME)) -> DataFrame:
    """Any-grade flags per person and frame for every condition, in one shuffle.

    A condition's columns are null where the person-frame has no usable row of its labs. For the
    kidney that means no known clearance; elsewhere a null row flag makes the sum null.
    """
    aggs = []
    for cond in LAB_CONDITIONS:
        rows = lab_rows_of(cond)
        usable = rows & F.col("crcl").isNotNull() if cond == "kidney" else rows
        aggs.append(F.count_if(usable).alias(f"{cond}_lab_rows"))
        for g in GRADES:
            flag = F.col(f"{cond}_g{g}")
            total = F.sum(F.when(usable, flag))
            if cond != "kidney":
                total = F.when(F.count_if(usable & flag.isNull()) == 0, total)
            aggs.append(total.alias(f"{cond}_g{g}_n"))
    summed = graded.groupBy(*keys).agg(*aggs)
    return summed.withColumns(
        {
            f"{c}_g{g}_lab": any_flag(F.col(f"{c}_g{g}_n")).cast("int")
            for c in LAB_CONDITIONS
            for g in GRADES
        }
    )


def any_lab_flags(framed: DataFrame, rules: list[LimitRule] = LIMIT_RULES) -> DataFrame:
    """The any-grade flags of ``lab_flags`` straight from framed rows whose limits are not yet filled.

    A filled limit is one value per person, frame and lab, so a row without a limit can only raise a
    flag through its group's most extreme such row. The groups therefore carry: the flags of rows with
    a known limit, that extreme result, and the limit to fill in. Nothing is joined back to rows, and
    a hot person is reduced before the shuffle.
    """
    rows = grade_rows(framed)
    has = F.col(RESULT).isNotNull()
    open_labs = {c: F.col(LAB).isin([r.lab for r in rules if r.column == c]) for c in (HIGH, LOW)}
    # the group's own limit, as each rule asks for it
    own = {}
    for c in (HIGH, LOW):
        value = F.lit(None).cast("double")
        for how, pick in (("min", F.min), ("max", F.max)):
            labs = [r.lab for r in rules if (r.column, r.own) == (c, how)]
            if labs:
                value = F.coalesce(value, pick(F.when(F.col(LAB).isin(labs), F.col(c))))
        own[c] = value
    flags = [f"{c}_g{g}" for c in LAB_CONDITIONS for g in GRADES]
    usable = F.when(F.col(LAB) == CREATININE, F.col("crcl").isNotNull()).otherwise(has)
    groups = rows.groupBy(ID, FRAME, LAB, "siteid").agg(
        F.count_if(usable).alias("__rows"),
        F.count_if(has).alias("__known"),
        *[F.max(F.when(has, F.col(f))).alias(f"__k_{f}") for f in flags],
        F.max(F.when(open_labs[HIGH] & F.col(HIGH).isNull(), F.col(RESULT))).alias("__highest"),
        F.min(F.when(open_labs[LOW] & F.col(LOW).isNull(), F.col(RESULT))).alias("__lowest"),
        own[HIGH].alias(HIGH),
        own[LOW].alias(LOW),
    )
    filled = impute_constant(groups, rules).withColumn("crcl", F.lit(None).cast("double"))
    merged = [F.col(f"__k_{f}") for f in flags]
    # for the extreme rows the kidney flags are already known and stay out
    for extreme in ("__highest", "__lowest"):
        filled = grade_rows(filled.withColumn(RESULT, F.col(extreme))).withColumnsRenamed(
            {f: f"{extreme}_{f}" for f in flags}
        )
        there = F.col(extreme).isNotNull()
        merged = [F.greatest(m, F.when(there, F.col(f"{extreme}_{f}"))) for m, f in zip(merged, flags)]
    merged = [F.max(m).alias(f"{f}_lab") for m, f in zip(merged, flags)]
    counts = [
        F.sum(F.when(lab_rows_of(c), F.col("__rows")).otherwise(0)).alias(f"{c}_lab_rows")
        for c in LAB_CONDITIONS
    ]
    out = filled.groupBy(ID, FRAME).agg(*merged, *counts, F.sum("__known").alias("__known"))
    return out.where("__known > 0").drop("__known")


def icd_flags(
    icd: DataFrame, flags: list[str] = ICD_FLAGS, keys: tuple[str, ...] = (ID, FRAME)
) -> DataFrame:
    """Code counts ``<flag>_n`` and any-code flags per person and frame, all flags in one shuffle."""
    counts = icd.groupBy(*keys).agg(*[strict_sum(f).alias(f"{f}_n") for f in flags])
    return counts.withColumns({f: any_flag(F.col(f"{f}_n")).cast("int") for f in flags})


def chart_days(chart: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Chart-reviewed toxicities per person and day, so that a busy chart joins as few rows."""
    names = names or CHART_CONDITIONS
    return chart.groupBy(ID, "toxicitydate").agg(
        *[
            strict_sum(r_ifelse(F.col("toxicityname") == label, 1, 0)).alias(f"{c}_tox_n")
            for c, label in names.items()
        ]
    )


def chart_flags(days: DataFrame) -> DataFrame:
    """Any chart-reviewed toxicity per person from ``chart_days``, every condition in one pass."""
    cols = [c for c in days.columns if c.endswith("_tox_n")]
    counts = days.groupBy(ID).agg(*[strict_sum(c).alias(c) for c in cols])
    return counts.withColumns({c[:-2]: any_flag(F.col(c)).cast("int") for c in cols})


def complete_pair(
    icd: DataFrame, lab: DataFrame, icd_cols: list[str], lab_cols: list[str]
) -> DataFrame:
    """Person-frames known to either source; the absent side is 0 and marked missing."""
    left = icd.select(ID, FRAME, *icd_cols, F.lit(0).alias("missing_icd"))
    right = lab.select(ID, FRAME, *lab_cols, F.lit(0).alias("missing_lab"))
    both = left.join(right, [ID, FRAME], "full")
    return both.fillna(0, [*icd_cols, *lab_cols]).fillna(1, ["missing_icd", "missing_lab"])


def complete_scaffold(
    cohort: DataFrame, icd: DataFrame, lab: DataFrame, frames: int = 4
) -> DataFrame:
    """Every person and frame of the cohort with all flags filled and missing sources marked."""
    icd_cols = [f"{c}_flag_icd" for c in ICD_CONDITIONS if f"{c}_flag_icd" in icd.columns]
    lab_cols = [f"{c}_g{g}_lab" for c in LAB_CONDITIONS for g in GRADES]
    rows = [f"{c}_lab_rows" for c in LAB_CONDITIONS]
    out = (
        scaffold(cohort, frames)
        .join(icd.select(ID, FRAME, *icd_cols, F.lit(0).alias("missing_icd")), [ID, FRAME], "left")
        .join(lab.select(ID, FRAME, *lab_cols, *rows), [ID, FRAME], "left")
    )
    out = out.withColumns(
        {f"missing_lab_{c}": (F.coalesce(f"{c}_lab_rows", F.lit(0)) == 0).cast("int")
         for c in LAB_CONDITIONS}
    ).drop(*rows)
    return out.fillna(0, [*icd_cols, *lab_cols]).fillna(1, ["missing_icd"])


def concordance(icd_flag: str, lab_flag: str, lab_label: str) -> Column:
    """Both / Only ICD / Only <lab> / Neither."""
    i, x = F.col(icd_flag), F.col(lab_flag)
    return r_case(
        [
            ((i == 1) & (x == 1), "Both"),
            ((i == 1) & (x == 0), "Only ICD"),
            ((i == 0) & (x == 1), f"Only {lab_label}"),
        ],
        "Neither",
    )


def concordance_labels(person_frames: DataFrame) -> DataFrame:
    return person_frames.withColumns(
        {
            "renal_tox_indicator": concordance("kidney_flag_icd", "kidney_g1_lab", "CrCl60"),
            "hep_tox_indicator": concordance("liver_flag_icd", "liver_g2_lab", "Grade 2"),
            "anemia_tox_indicator": concordance("anemia_flag_icd", "anemia_g2_lab", "Grade 2"),
            "neutropenia_tox_indicator_g3": concordance(
                "neutropenia_flag_icd", "neutropenia_g3_lab", "Grade 3"
            ),
            "neutropenia_tox_indicator_g2": concordance(
                "neutropenia_flag_icd", "neutropenia_g2_lab", "Grade 2"
            ),
            "thrombocytopenia_tox_indicator": concordance(
                "thrombocytopenia_flag_icd", "thrombocytopenia_g2_lab", "Grade 2"
            ),
        }
    )


def merge_chart(
    person_frames: DataFrame, chart: DataFrame, frame: int = 4, site: int = 2
) -> DataFrame:
    """Chart-reviewed site and frame, with every chart flag filled."""
    cols = [c for c in chart.columns if c.endswith("_tox")]
    kept = person_frames.where((F.col(FRAME) == frame) & (F.col("siteid") == site))
    return kept.join(chart.select(ID, *cols), ID, "left").fillna(0, cols)


def first_dates(events: DataFrame, date: str, name: str) -> DataFrame:
    """First event date per person."""
    return events.groupBy(ID).agg(F.min(date).alias(name))


def neuropathy_merge(
    icd_frames: DataFrame,
    chart: DataFrame,
    first_icd: DataFrame,
    first_chart: DataFrame,
    cohort: DataFrame,
    compat: bool = False,
) -> DataFrame:
    """Chart and code neuropathy per person with first dates and day gaps.

    A person known only to the chart has no frame after the full join. The default sets frame 4;
    ``compat`` leaves it null, as the source analysis does.
    """
    out = chart.select(ID, "neuropathy_tox").join(
        icd_frames.select(ID, FRAME, "neuropathy_flag_icd"), ID, "full"
    )
    if not compat:
        out = out.withColumn(FRAME, F.coalesce(FRAME, F.lit(4)))
    out = (
        out.join(first_icd, ID, "left")
        .join(first_chart, ID, "left")
        .join(cohort.select(ID, "first_chemo_dt"), ID, "left")
    )
    gap = F.datediff
    return out.fillna(0, ["neuropathy_tox", "neuropathy_flag_icd"]).withColumns(
        {
            "gap_between_icd_and_tox": gap("first_icd_date", "first_tox_date"),
            "gap_between_icd_and_first_chemo": gap("first_icd_date", "first_chemo_dt"),
            "gap_between_chart_and_first_chemo": gap("first_tox_date", "first_chemo_dt"),
        }
    ).drop("first_chemo_dt")


def either_flags(wide: DataFrame, conditions: list[str]) -> DataFrame:
    """1 when the code or the laboratory grade is positive."""
    return wide.withColumns(
        {
            f"{c}_either_g{g}": r_case(
                [(F.col(f"{c}_flag_icd") == 1, 1), (F.col(f"{c}_g{g}_lab") == 1, 1)], 0
            )
            for c in conditions
            for g in GRADES
        }
    )
