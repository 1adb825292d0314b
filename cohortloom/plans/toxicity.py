"""Codes and laboratory grades against chart review, from raw tables to the batch result."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import strict_sum
from ..operators import cohort as C
from ..operators import labs as L
from ..operators import tox as T
from ..operators import validate as V
from ..operators.scale import checkpointed


@dataclass(frozen=True)
class Settings:
    """Study-specific dates and exclusions."""

    min_year: int = 2004
    era2: tuple = (C.ERA2_BREAKS, C.ERA2_LABELS)
    era3: tuple = (C.ERA3_BREAKS, C.ERA3_LABELS)
    dropped_era: str = C.ERA3_LABELS[0]
    late_name: str = "dx after first era"


VALIDATED = ["anemia", "neutropenia", "thrombocytopenia"]
_PERSON = ["studyid", "siteid", "dx_dt", "surgery_dt", "first_chemo_dt", "last_chemo_dt",
           "dx_age", "final_dx_wt", "final_2nd_wt"]


@dataclass(frozen=True)
class Sources:
    cohort: DataFrame
    icd: DataFrame
    lab: DataFrame
    chart: DataFrame
    # raw framed labs, once ``staged`` has written them
    framed: DataFrame | None = None


def adjuvant_people(src: Sources) -> DataFrame:
    return C.adjuvant(src.cohort).select(*_PERSON)


def framed_icd(src: Sources) -> DataFrame:
    """Codes of the adjuvant group with their time frame.

    Codes are reduced to one row per person and day before the join: a person with very many codes
    then contributes at most one row per day.
    """
    daily = src.icd.where(F.col("co_tox_dx_code_date").isNotNull())
    daily = daily.groupBy("studyid", "co_tox_dx_code_date").agg(
        *[strict_sum(f).alias(f) for f in T.ICD_FLAGS]
    )
    return C.bucket_by_milestones(
        daily.join(adjuvant_people(src), "studyid"), "co_tox_dx_code_date"
    )


def framed_labs(src: Sources, clean: bool = True) -> DataFrame:
    """Labs of the adjuvant group with their time frame, cleaned unless asked otherwise.

    Cleaning looks at the same rows three times (days, rows with a percent, all others) and imputation
    twice more, so the framed rows are written once, by lab code; the raw labs are scanned once. A day lies in one
    frame, so that framing first changes nothing about a day's conversion.
    """
    if not clean:
        return _raw_framed(src) if src.framed is None else src.framed
    return L.clean_results(staged_labs(src).framed)


def _raw_framed(src: Sources) -> DataFrame:
    # the semi join names the group alone: Spark moves it below the joins that make up the labs, whose
    # rows then meet the milestones without those of everybody else
    people = checkpointed(adjuvant_people(src))
    lab = src.lab.join(people.select("studyid"), "studyid", "left_semi")
    return C.bucket_by_milestones(lab.join(people, "studyid"), L.DATE)


def limited_labs(src: Sources) -> DataFrame:
    """Framed, cleaned labs with blanked, flagged and imputed limits and known results."""
    lab = L.missing_indicators(L.blank_limits(framed_labs(src)))
    return L.impute_constant(L.drop_null_results(L.impute_own_record(lab)))


def graded_labs(src: Sources) -> DataFrame:
    return T.grade_rows(T.creatinine_clearance(limited_labs(src)))


def lab_person_flags(src: Sources) -> DataFrame:
    return T.any_lab_flags(T.creatinine_clearance(L.blank_limits(framed_labs(src))))


def _in_window(src: Sources, events: DataFrame) -> DataFrame:
    people = src.cohort.select("studyid", "surgery_d", "surgery_dt", "first_chemo_dt", "last_chemo_dt")
    return C.chart_window(events.join(people, "studyid"))


def chart_in_window(src: Sources) -> DataFrame:
    return _in_window(src, src.chart)


def chart_person_flags(src: Sources) -> DataFrame:
    return T.chart_flags(_in_window(src, T.chart_days(src.chart)))


def staged_cohort(src: Sources) -> Sources:
    """The same sources with the cohort written once: every branch below reads it again."""
    return replace(src, cohort=checkpointed(src.cohort)) if src.framed is None else src


def staged_labs(src: Sources) -> Sources:
    """The same sources with the raw framed labs written once, by lab code."""
    return replace(src, framed=checkpointed(_raw_framed(src), L.LAB)) if src.framed is None else src


def staged(src: Sources) -> Sources:
    """The same sources with cohort and framed labs written once, for several analyses of them."""
    return staged_labs(staged_cohort(src))


def person_frames(src: Sources) -> DataFrame:
    """Every adjuvant person and frame with all code and laboratory flags."""
    return _person_frames(staged_cohort(src))


def _person_frames(src: Sources) -> DataFrame:
    return T.complete_scaffold(
        C.adjuvant(src.cohort), T.icd_flags(framed_icd(src)), lab_person_flags(src)
    )


def validation_table(src: Sources, settings: Settings = Settings()) -> DataFrame:
    """One row per eligible person of the chart-reviewed site in the last frame."""
    src = staged_cohort(src)
    wide = T.merge_chart(_person_frames(src), chart_person_flags(src))
    wide = C.eligible(wide, settings.min_year)
    wide = C.derived_groups(wide, settings.era2, settings.era3)
    return T.either_flags(wide, VALIDATED)


def subsets(settings: Settings = Settings()) -> list[V.Subset]:
    return [V.ALL_ROWS, V.LAB_PRESENT, V.not_in_era(settings.dropped_era, settings.late_name)]


def validation_results(src: Sources, settings: Settings = Settings()) -> DataFrame:
    return V.batch_validation(validation_table(src, settings), VALIDATED, subsets(settings))
