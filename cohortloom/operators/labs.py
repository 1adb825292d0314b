"""Laboratory cleaning: repairs, unit rules, reference limits and their missingness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import any_of, half_even, in_set, null_count, overwrite, ratio
from .scale import checkpointed, exact_quantiles, join_null_safe

ID, DATE, FRAME = "studyid", "co_tox_lab_date", "time_frame"
LAB, UNIT, RESULT = "co_tox_lab_name", "co_tox_lab_unit", "co_tox_lab_result"
LOW, HIGH = "co_tox_lab_normal_low", "co_tox_lab_normal_high"

# Laboratory and unit codes.
ANC, WBC, BILI_TOTAL, AST, ALT, ALP = 1, 2, 5, 6, 7, 8
CREATININE, PLATELETS, HEMOGLOBIN, NEUTROPHIL_PCT = 11, 16, 17, 21
HEPATIC = [3, 4, 5, 6, 7, 8]
UNIT_K_PER_UL, UNIT_PERCENT, UNIT_UNKNOWN = 3, 4, 11
UMOL_PER_MG_DL = 88.402


@dataclass(frozen=True)
class ScaleRule:
    """Multiply result and lower limit of a lab, for the listed units (None: every unit)."""

    lab: int
    units: tuple[int, ...] | None
    factor: float


@dataclass(frozen=True)
class LimitRange:
    """Lower limits at or below ``low``, or above ``high``, are implausible."""

    lab: int
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class LimitRule:
    """How a missing limit is filled: from the own record, then from a constant per site."""

    lab: int
    column: str
    own: str
    constant: float
    by_site: tuple[tuple[int, float], ...] = ()


SCALE_RULES = [ScaleRule(ANC, (3, 11), 1000.0), ScaleRule(PLATELETS, None, 1000.0)]
LIMIT_RANGES = [LimitRange(HEMOGLOBIN, 10.0), LimitRange(ANC, 1500.0, 3000.0)]
LIMIT_RULES = [
    LimitRule(AST, HIGH, "min", 35.0),
    LimitRule(ALT, HIGH, "min", 40.0),
    LimitRule(ALP, HIGH, "min", 110.0),
    LimitRule(HEMOGLOBIN, LOW, "max", 11.4),
    LimitRule(ANC, LOW, "max", 2100.0, ((2, 2000.0),)),
    LimitRule(PLATELETS, LOW, "max", 140000.0),
]


def umol_to_mg_dl(x: Column) -> Column:
    return half_even(x / UMOL_PER_MG_DL, 2)


def repair_sentinel(lab: DataFrame, bad: float = -0.1, good: float = 0.1) -> DataFrame:
    return lab.withColumn(RESULT, overwrite(RESULT, F.col(RESULT) == bad, good))


def percent_to_absolute(lab: DataFrame, targets: tuple[str, ...] = (RESULT, LOW)) -> DataFrame:
    """Turn percent counts into absolute ones with the same patient's same-day white count.

    Per patient and day one percent row (for each target) and one white-count row are used; every row
    sharing the chosen percent row's patient, day, lab and unit takes the converted value. Only the
    few rows that can hold a percent meet the join; all others pass by without a shuffle. Each part asks
    for its lab codes first, so a table partitioned by them is read in parts.
    """
    counts, whites = F.col(LAB).isin(ANC, NEUTROPHIL_PCT), F.col(LAB) == WBC
    by_unit = (F.col(LAB) == ANC) & (F.col(UNIT) == UNIT_PERCENT)
    by_code = F.col(LAB) == NEUTROPHIL_PCT
    candidate = F.coalesce(by_unit | by_code, F.lit(False))
    in_thousands = F.col(UNIT).isNull() | (F.col(UNIT) == UNIT_K_PER_UL)
    white = overwrite(RESULT, in_thousands, F.col(RESULT) * 1000)
    picks = [F.min(F.when(F.col(LAB) == WBC, F.struct(UNIT, white.alias("value")))).alias("__wbc")]
    for t in targets:
        is_percent = by_unit | (by_code & (F.col(t) <= 100))
        picks.append(F.min(F.when(is_percent, F.struct(LAB, UNIT, F.col(t)))).alias(f"__p_{t}"))
    days = lab.where(counts | whites).where(candidate | whites).groupBy(ID, DATE).agg(*picks)
    days = days.where(
        F.col("__wbc").isNotNull() & any_of([F.col(f"__p_{t}").isNotNull() for t in targets])
    )
    fixed = lab.where(counts).where(candidate).join(days, [ID, DATE], "left")
    for t in targets:
        pick = F.col(f"__p_{t}")
        same = (F.col(LAB) == pick[LAB]) & F.col(UNIT).eqNullSafe(pick[UNIT])
        value = half_even(pick[t] * F.col("__wbc")["value"] / 100)
        fixed = fixed.withColumn(f"__v_{t}", F.when(same, value))
    for t in targets:
        fixed = fixed.withColumn(t, F.coalesce(f"__v_{t}", t))
    return lab.where(~candidate).unionByName(fixed.select(*lab.columns))


def scale_units(lab: DataFrame, rules: list[ScaleRule] = SCALE_RULES) -> DataFrame:
    """Apply the unit factors as one expression: no join, no shuffle."""
    factor = F.lit(1.0)
    for rule in rules:
        hit = F.col(LAB) == rule.lab
        if rule.units is not None:
            hit = hit & in_set(UNIT, rule.units)
        factor = F.when(hit, rule.factor).otherwise(factor)
    return lab.withColumns({RESULT: F.col(RESULT) * factor, LOW: F.col(LOW) * factor})


def merge_codes(lab: DataFrame, mapping: dict[int, int] | None = None) -> DataFrame:
    out = F.col(LAB)
    for old, new in (mapping or {NEUTROPHIL_PCT: ANC}).items():
        out = overwrite(out, F.col(LAB) == old, new)
    return lab.withColumn(LAB, out)


def blank_limits(lab: DataFrame, ranges: list[LimitRange] = LIMIT_RANGES) -> DataFrame:
    """Null out implausible lower limits."""
    bad = []
    for r in ranges:
        off = []
        if r.low is not None:
            off.append(F.col(LOW) <= r.low)
        if r.high is not None:
            off.append(F.col(LOW) > r.high)
        bad.append((F.col(LAB) == r.lab) & any_of(off))
    return lab.withColumn(LOW, overwrite(LOW, any_of(bad), None))


def missing_indicators(lab: DataFrame) -> DataFrame:
    return lab.withColumns(
        {
            "normal_low_missing": F.col(LOW).isNull().cast("int"),
            "normal_high_missing": F.col(HIGH).isNull().cast("int"),
        }
    )


def missing_pattern(lab: DataFrame, limit: str, labs: list[int]) -> DataFrame:
    """full / none / partial limit missingness per person, frame and lab."""
    counts = lab.where(F.col(LAB).isin(labs)).groupBy(ID, FRAME, LAB).agg(
        F.count("*").alias("n"), null_count(limit).alias("n_missing")
    )
    label = F.when(F.col("n") == F.col("n_missing"), "full").when(F.col("n_missing") == 0, "none")
    return counts.withColumn("missing_ind", label.otherwise("partial"))


def missing_mode_report(lab: DataFrame, limit: str, labs: list[int]) -> DataFrame:
    """Person-frames by pattern, with the share of all person-frames of that frame and lab."""
    pattern = missing_pattern(lab, limit, labs)
    by_mode = pattern.groupBy(FRAME, LAB).agg(
        F.count("*").alias("n_patient"),
        F.count_if(F.col("missing_ind") == "full").alias("full"),
        F.count_if(F.col("missing_ind") == "partial").alias("partial"),
    )
    long = by_mode.unpivot([FRAME, LAB, "n_patient"], ["full", "partial"], "missing_ind", "n_missing")
    pct = 100 * ratio(F.col("n_missing"), F.col("n_patient"))
    return long.where("n_missing > 0").withColumn("percent_missing", pct)


def impute_own_record(
    lab: DataFrame, rules: list[LimitRule] = LIMIT_RULES, compat: bool = False
) -> DataFrame:
    """Fill a missing limit from the same person, frame and lab.

    Only groups that hold both missing and known limits are joined back, so the right side is
    small and a hot person is reduced on the map side instead of being sorted in a window; only rows
    that lack a limit meet that join, all others pass by without a shuffle. ``compat``
    fills neutrophil limits only for people who also lack a hemoglobin limit, as the source analysis
    does (it selects those people by the wrong lab code).
    """
    specs = {(c, how): [r.lab for r in rules if (r.column, r.own) == (c, how)]
             for c, how in {(r.column, r.own) for r in rules}}
    aggs, keep = [], []
    for (c, how), labs in sorted(specs.items()):
        here = F.col(LAB).isin(labs)
        pick = F.min if how == "min" else F.max
        aggs += [pick(F.when(here, F.col(c))).alias(f"__own_{c}_{how}"),
                 F.count_if(here & F.col(c).isNull()).alias(f"__gap_{c}_{how}")]
        keep.append((F.col(f"__gap_{c}_{how}") > 0) & F.col(f"__own_{c}_{how}").isNotNull())
    groups = (
        lab.where(F.col(LAB).isin([r.lab for r in rules]))
        .groupBy(ID, FRAME, LAB)
        .agg(*aggs)
        .where(any_of(keep))
        .select(ID, FRAME, LAB, *[f"__own_{c}_{how}" for c, how in sorted(specs)])
    )
    if compat:
        lacking = lab.where((F.col(LAB) == HEMOGLOBIN) & F.col(LOW).isNull()).select(ID).distinct()
        anc = groups.where(F.col(LAB) == ANC).join(lacking, ID, "left_semi")
        groups = groups.where(F.col(LAB) != ANC).unionByName(anc)
    gap = any_of([F.col(LAB).isin(labs) & F.col(c).isNull() for (c, _), labs in sorted(specs.items())])
    gap = F.coalesce(gap, F.lit(False))
    # the written size, not an estimate, decides whether the rows need a shuffle
    filled = lab.where(gap).join(checkpointed(groups), [ID, FRAME, LAB], "left")
    for c, how in sorted(specs):
        filled = filled.withColumn(c, F.coalesce(c, f"__own_{c}_{how}"))
    filled = filled.drop(*[f"__own_{c}_{how}" for c, how in specs])
    return lab.where(~gap).select(*filled.columns).unionByName(filled)


def impute_constant(lab: DataFrame, rules: list[LimitRule] = LIMIT_RULES) -> DataFrame:
    """Fill what is still missing with the fixed limit of the lab (and site)."""
    for c in (LOW, HIGH):
        fill = F.lit(None).cast("double")
        for r in (r for r in rules if r.column == c):
            value = F.lit(r.constant)
            for site, at_site in r.by_site:
                value = F.when(F.col("siteid") == site, at_site).otherwise(value)
            fill = F.when(F.col(LAB) == r.lab, value).otherwise(fill)
        lab = lab.withColumn(c, F.coalesce(F.col(c), fill))
    return lab


def site_median_limits(lab: DataFrame, limit: str, labs: list[int]) -> DataFrame:
    """Exact median limit per lab and site (the data-driven alternative to the constants)."""
    known = lab.where(F.col(LAB).isin(labs))
    return exact_quantiles(known, [LAB, "siteid"], limit, {"median_limit": 0.5})


def impute_site_median(lab: DataFrame, limit: str, labs: list[int]) -> DataFrame:
    # written first, so that its real size (one row per lab and site) decides the join
    medians = checkpointed(site_median_limits(lab, limit, labs).drop("n"))
    joined = join_null_safe(lab, medians, [LAB, "siteid"], "left")
    return joined.withColumn(limit, F.coalesce(limit, "median_limit")).drop("median_limit")


def drop_null_results(lab: DataFrame) -> DataFrame:
    return lab.where(F.col(RESULT).isNotNull())


def clean_results(lab: DataFrame) -> DataFrame:
    """Repairs that precede time framing, in the order the limits depend on."""
    lab = repair_sentinel(lab)
    lab = percent_to_absolute(lab)
    return merge_codes(scale_units(lab))


def limit_profile(lab: DataFrame, limit: str, labs: list[int]) -> DataFrame:
    """min / median / max known limit per person, frame and lab, and whether they agree."""
    known = lab.where(F.col(LAB).isin(labs))
    stats = exact_quantiles(
        known,
        [ID, FRAME, LAB],
        limit,
        {"median_limit": 0.5},
        {"min_limit": F.min(limit), "max_limit": F.max(limit)},
    )
    return stats.withColumn("ind", (F.col("min_limit") == F.col("max_limit")).cast("int"))


def limit_missing_report(
    lab: DataFrame, limit: str, labs: list[int], by_site: bool = False
) -> DataFrame:
    """Missing limits in rows and patients per frame and lab (and site)."""
    keys = ["siteid", FRAME, LAB] if by_site else [FRAME, LAB]
    # one row per person first: the distinct counts then need no second shuffle of raw rows
    person = lab.where(F.col(LAB).isin(labs)).groupBy(*keys, ID).agg(
        F.count("*").alias("n"), null_count(limit).alias("nas")
    )
    return (
        person.groupBy(*keys)
        .agg(
            F.sum("nas").alias("nas"),
            F.count_if(F.col("nas") > 0).alias("nas_patient"),
            F.sum("n").alias("n"),
            F.count("*").alias("n_patient"),
        )
        .withColumns(
            {
                "percent_n": 100 * ratio(F.col("nas"), F.col("n")),
                "percent_patient": 100 * ratio(F.col("nas_patient"), F.col("n_patient")),
            }
        )
    )


def zero_results_by_unit(lab: DataFrame, labs: list[int]) -> DataFrame:
    """Zero results per unit, in rows and patients."""
    zero = lab.where(F.col(LAB).isin(labs) & (F.col(RESULT) == 0))
    return zero.groupBy(UNIT).agg(
        F.count("*").alias("n_zero"), F.countDistinct(ID).alias("n_patient")
    )


def zero_patient_distribution(lab: DataFrame, labs: list[int], keys: list[str]) -> DataFrame:
    """Result distribution, per ``keys``, of patients who ever had a zero result."""
    used = lab.where(F.col(LAB).isin(labs) & F.col(RESULT).isNotNull())
    patients = used.where(F.col(RESULT) == 0).select(ID).distinct()
    return distribution(used.join(patients, ID, "left_semi"), keys, RESULT)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, quartiles, mean, max and count of the known values per key."""
    out = exact_quantiles(
        df,
        keys,
        value,
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
        {
            "min": F.min(value),
            "max": F.max(value),
            "mean": F.sum(F.col(value) * F.col("__c")) / F.sum("__c"),
        },
    )
    return out
