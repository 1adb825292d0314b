import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom.functions.nulls import cut, in_set, r_case, r_ifelse, strict_min, strict_sum, trunc_years
from cohortloom.operators import cohort as C
from cohortloom.operators import relational as X
from cohortloom.operators import tox as T

D = dt.date


def values(df, c):
    return [r[c] for r in df.orderBy("k").collect()]


def test_null_condition_is_a_null_answer(frame):
    df = frame([(1, None), (2, 0), (3, 5)], "k int, x int")
    out = df.select("k", r_ifelse(F.col("x") < 1, "a", "b").alias("v"))
    assert values(out, "v") == [None, "a", "b"]
    chain = r_case([(F.col("x") < 1, "low"), (F.col("x") < 9, "mid")], "high")
    assert values(df.select("k", chain.alias("v")), "v") == [None, "low", "mid"]


def test_strict_aggregates(frame):
    df = frame([(1, 1), (1, None), (2, 3)], "k int, x int")
    out = df.groupBy("k").agg(strict_sum("x").alias("s"), strict_min("x").alias("m"))
    assert [(r.s, r.m) for r in out.orderBy("k").collect()] == [(None, None), (3, 3)]


def test_membership_is_never_null(frame):
    df = frame([(1, None), (2, 3), (3, 4)], "k int, x int")
    assert values(df.select("k", in_set("x", [3]).alias("v")), "v") == [False, True, False]
    assert values(df.select("k", in_set("x", [3, None]).alias("v")), "v") == [True, True, False]
    assert values(df.select("k", in_set("x", [None]).alias("v")), "v") == [True, False, False]


def test_cut_is_left_closed_and_years_truncate_toward_zero(frame):
    df = frame([(1, 49.9), (2, 50.0), (3, 75.0), (4, None)], "k int, x double")
    labels = values(df.select("k", cut("x", [50, 75], ["a", "b", "c"]).alias("v")), "v")
    assert labels == ["a", "b", "c", None]
    dates = frame([(1, D(2000, 1, 1), D(2001, 6, 1)), (2, D(2002, 1, 1), D(2000, 1, 1))],
                  "k int, a date, b date")
    assert values(dates.select("k", trunc_years("a", "b").alias("v")), "v") == [-1, 2]


@pytest.mark.parametrize(
    "surgery, surgery_dt, chemo, chemo_dt, want",
    [
        (None, None, 0, None, None),
        (0, None, 0, None, "Neither"),
        (0, None, 1, None, "Only chemo"),
        (0, None, None, None, None),
        (1, None, 1, D(2010, 1, 1), None),
        (1, D(2010, 1, 1), 0, None, "Only surgery"),
        (1, D(2010, 1, 1), None, None, None),
        (1, D(2010, 1, 1), 1, None, None),
        (1, D(2010, 1, 1), 1, D(2010, 1, 2), "Surgery before chemo"),
        (1, D(2010, 1, 1), 1, D(2010, 1, 1), "Surgery after chemo"),
        (1, D(2010, 1, 2), 1, D(2010, 1, 1), "Surgery after chemo"),
    ],
)
def test_treatment_group(frame, surgery, surgery_dt, chemo, chemo_dt, want):
    df = frame([(surgery, surgery_dt, chemo, chemo_dt)],
               "surgery_d int, surgery_dt date, any_chemo int, first_chemo_dt date")
    assert C.treatment_group(df).first()["tx_group"] == want


def test_frames_close_on_the_right(frame):
    stones = (D(2010, 1, 10), D(2010, 2, 10), D(2010, 3, 10), D(2010, 4, 10))
    days = [stones[0], D(2010, 1, 11), stones[1], stones[2], stones[3], D(2010, 4, 11), None]
    df = frame([(i, d, *stones) for i, d in enumerate(days)],
               "k int, d date, dx_dt date, surgery_dt date, first_chemo_dt date, last_chemo_dt date")
    out = C.bucket_by_milestones(df, "d")
    assert [(r.k, r.time_frame) for r in out.orderBy("k").collect()] == [
        (0, 1), (1, 2), (2, 2), (3, 3), (4, 4)]


def test_chart_window_is_open_left_closed_right(frame):
    base = (1, D(2010, 1, 1), D(2010, 2, 1), D(2010, 3, 1))
    days = [D(2010, 2, 1), D(2010, 2, 2), D(2010, 3, 1), D(2010, 3, 2), None]
    df = frame([(i, d, *base) for i, d in enumerate(days)],
               "k int, toxicitydate date, surgery_d int, surgery_dt date, first_chemo_dt date, last_chemo_dt date")
    assert [r.k for r in C.chart_window(df).orderBy("k").collect()] == [1, 2]


def test_attrition_counts_rows_and_people(frame):
    df = frame([(1, 1), (1, 5), (2, 5), (3, 1), (None, 1)], "studyid int, x int")
    rows = C.attrition(df, [("small", F.col("x") < 3)]).orderBy("step").collect()
    assert [(r.n_rows, r.n_patients) for r in rows] == [(5, 3), (3, 2)]
    assert (rows[1].rows_removed, rows[1].patients_removed) == (2, 1)


def test_completion_covers_every_key_once(frame):
    icd = frame([(1, 1, 1), (2, 1, 0)], "studyid int, time_frame int, f int")
    lab = frame([(2, 1, 1), (3, 2, 1)], "studyid int, time_frame int, g int")
    out = T.complete_pair(icd, lab, ["f"], ["g"]).orderBy("studyid").collect()
    assert [(r.studyid, r.f, r.g, r.missing_icd, r.missing_lab) for r in out] == [
        (1, 1, 0, 0, 1), (2, 0, 1, 0, 0), (3, 0, 1, 1, 0)]


def test_neuropathy_merge_keeps_chart_only_people(frame):
    icd = frame([(1, 4, 1)], "studyid int, time_frame int, neuropathy_flag_icd int")
    chart = frame([(2, 1)], "studyid int, neuropathy_tox int")
    first_icd = frame([(1, D(2010, 3, 1))], "studyid int, first_icd_date date")
    first_tox = frame([(2, D(2010, 3, 4))], "studyid int, first_tox_date date")
    people = frame([(1, D(2010, 2, 27)), (2, D(2010, 3, 1))], "studyid int, first_chemo_dt date")
    args = (icd, chart, first_icd, first_tox, people)
    fixed = {r.studyid: r for r in T.neuropathy_merge(*args).collect()}
    assert fixed[2].time_frame == 4 and fixed[2].gap_between_chart_and_first_chemo == 3
    assert fixed[1].gap_between_icd_and_first_chemo == 2
    kept = {r.studyid: r for r in T.neuropathy_merge(*args, compat=True).collect()}
    assert kept[2].time_frame is None


def test_corrections_exclusions_and_coverage(frame):
    df = frame([(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)], "k int, t string, x double")
    fixes = frame([(2, None, 9.0), (3, "z", 8.0)], "k int, t string, corrected double")
    assert values(X.correct_by_key(df, fixes, ["k", "t"], "x"), "x") == [1.0, 9.0, 3.0]
    assert [r.k for r in X.exclude_listed(df, fixes, ["k"]).collect()] == [1]
    assert sorted(r.k for r in X.drop_when(df, F.col("t") == "a").collect()) == [2, 3]
    row = X.coverage(df.unionByName(df), fixes, "k").first()
    assert (row.n_rows, row.n_keys) == (2, 1)
