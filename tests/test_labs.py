import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import labs as L
from cohortloom.operators import tox as T

DAY = dt.date(2010, 1, 1)
LAB = ("studyid int, co_tox_lab_date date, co_tox_lab_name int, co_tox_lab_unit int,"
       " co_tox_lab_result double, co_tox_lab_normal_low double, co_tox_lab_normal_high double")
FRAMED = LAB + ", siteid int, time_frame int, crcl double"


def test_percent_conversion(frame):
    rows = [
        (1, DAY, 1, 4, 50.0, 40.0, None),  # white count in K/uL
        (1, DAY, 2, 3, 7.0, None, None),
        (2, DAY, 1, 4, 50.0, None, None),  # white count in /uL
        (2, DAY, 2, 1, 7000.0, None, None),
        (3, DAY, 21, None, 45.0, None, None),  # percent code, unit unknown on both
        (3, DAY, 2, None, 6.0, None, None),
        (4, DAY, 1, 4, 50.0, None, None),  # no white count that day
        (5, DAY, 1, 4, 25.0, None, None),  # 25% of 10 is 2.5 -> 2 (half to even)
        (5, DAY, 2, 1, 10.0, None, None),
        (6, DAY, 21, 16, 150.0, None, None),  # above 100: not a percent
        (6, DAY, 2, 3, 7.0, None, None),
        (7, DAY, 1, 4, 30.0, None, None),  # two percent rows, two white counts: first of each
        (7, DAY, 1, 4, 20.0, None, None),
        (7, DAY, 2, 3, 9.0, None, None),
        (7, DAY, 2, 3, 8.0, None, None),
    ]
    out = L.percent_to_absolute(frame(rows, LAB)).where(F.col(L.LAB) != 2)
    got = sorted((r.studyid, r[L.RESULT], r[L.LOW]) for r in out.collect())
    assert got == sorted([
        (1, 3500.0, 2800.0), (2, 3500.0, None), (3, 2700.0, None), (4, 50.0, None),
        (5, 2.0, None), (6, 150.0, None), (7, 1600.0, None), (7, 1600.0, None)], key=str)


def test_unit_rules_and_limits(frame):
    rows = [(1, DAY, 1, 3, 2.0, 1.5, None), (2, DAY, 1, 11, 2.0, 3.1, None),
            (3, DAY, 1, 1, 2000.0, 2000.0, None), (4, DAY, 16, None, 90.0, 140.0, None),
            (5, DAY, 17, 5, 9.0, 10.0, None), (6, DAY, 1, 1, None, 3000.0, None)]
    out = L.blank_limits(L.scale_units(frame(rows, LAB)))
    got = {r.studyid: (r[L.RESULT], r[L.LOW]) for r in out.collect()}
    assert got == {1: (2000.0, None), 2: (2000.0, None), 3: (2000.0, 2000.0), 4: (90000.0, 140000.0),
                   5: (9.0, None), 6: (None, 3000.0)}


def test_imputation(frame):
    rows = [
        (1, DAY, 17, 5, 9.0, 11.0, None, 1, 4, None),
        (1, DAY, 17, 5, 9.0, 12.0, None, 1, 4, None),
        (1, DAY, 17, 5, 9.0, None, None, 1, 4, None),  # own record, larger limit
        (2, DAY, 6, 6, 9.0, None, 40.0, 1, 4, None),
        (2, DAY, 6, 6, 9.0, None, 36.0, 1, 4, None),
        (2, DAY, 6, 6, 9.0, None, None, 1, 4, None),  # own record, smaller limit
        (3, DAY, 1, 1, 9.0, None, None, 1, 4, None),
        (4, DAY, 1, 1, 9.0, None, None, 2, 4, None),
        (5, DAY, 8, 6, 9.0, None, None, 2, 4, None),
    ]
    df = frame(rows, FRAMED)
    out = L.impute_constant(L.impute_own_record(df))
    got = sorted((r.studyid, r[L.LOW] or 0, r[L.HIGH] or 0) for r in out.collect())
    assert got == [(1, 11.0, 0), (1, 12.0, 0), (1, 12.0, 0), (2, 0, 36.0), (2, 0, 36.0), (2, 0, 40.0),
                   (3, 2100.0, 0), (4, 2000.0, 0), (5, 0, 110.0)]
    modes = {r.studyid: r.missing_ind for r in L.missing_pattern(df, L.LOW, [1, 17]).collect()}
    assert modes == {1: "partial", 3: "full", 4: "full"}


def test_compat_imputation_needs_a_hemoglobin_gap(frame):
    rows = [(w, DAY, 1, 1, 9.0, x, None, 1, 4, None) for w in (1, 2) for x in (1800.0, None)]
    rows.append((2, DAY, 17, 5, 9.0, None, None, 1, 4, None))
    df = frame(rows, FRAMED)
    lows = lambda d: sorted((r.studyid, r[L.LOW] or 0) for r in d.where(F.col(L.LAB) == 1).collect())
    assert lows(L.impute_own_record(df)) == [(1, 1800.0), (1, 1800.0), (2, 1800.0), (2, 1800.0)]
    assert lows(L.impute_own_record(df, compat=True)) == [(1, 0), (1, 1800.0), (2, 1800.0), (2, 1800.0)]


@pytest.mark.parametrize(
    "lab, result, low, high, want",
    [
        (17, 8.0, 11.0, None, ("anemia", 1, 1, 0)),
        (17, 7.9, 11.0, None, ("anemia", 1, 1, 1)),
        (17, 10.0, 11.0, None, ("anemia", 1, 0, 0)),
        (17, 11.0, 11.0, None, ("anemia", 0, 0, 0)),
        (1, 999.0, 2000.0, None, ("neutropenia", 1, 1, 1)),
        (1, 1000.0, 2000.0, None, ("neutropenia", 1, 1, 0)),
        (1, 1500.0, 2000.0, None, ("neutropenia", 1, 0, 0)),
        (16, 50000.0, 140000.0, None, ("thrombocytopenia", 1, 1, 0)),
        (16, 75000.0, 140000.0, None, ("thrombocytopenia", 1, 0, 0)),
        (5, 1.2, None, None, ("liver", 1, 0, 0)),
        (5, 1.5, None, None, ("liver", 1, 0, 0)),
        (5, 3.0, None, None, ("liver", 1, 1, 0)),
        (6, 70.0, None, 35.0, ("liver", 1, 0, 0)),
        (6, 105.0, None, 35.0, ("liver", 1, 0, 0)),
        (7, 176.0, None, 35.0, ("liver", 1, 1, 1)),
        (8, 250.0, None, 100.0, ("liver", 0, 0, 0)),
        (8, 251.0, None, 100.0, ("liver", 1, 1, 0)),
        (3, 99.0, None, None, ("liver", 0, 0, 0)),
    ],
)
def test_grades_at_their_cuts(frame, lab, result, low, high, want):
    row = T.grade_rows(frame([(1, DAY, lab, 1, result, low, high, 1, 4, None)], FRAMED)).first()
    assert tuple(row[f"{want[0]}_g{g}"] for g in (1, 2, 3)) == want[1:]


@pytest.mark.parametrize("crcl, want", [(15.0, (1, 1, 0)), (14.9, (1, 1, 1)), (30.0, (1, 0, 0)),
                                        (60.0, (0, 0, 0)), (None, (None, None, None))])
def test_renal_cuts(frame, crcl, want):
    row = T.grade_rows(frame([(1, DAY, 11, 5, 1.0, None, None, 1, 4, crcl)], FRAMED)).first()
    assert tuple(row[f"kidney_g{g}"] for g in (1, 2, 3)) == want


def test_clearance_uses_the_weight_of_its_frame(frame):
    rows = [(11, 1.0, 2, 60.0, None), (11, 1.0, 3, 60.0, None), (11, 0.0, 1, 60.0, 50.0),
            (11, None, 1, 60.0, 50.0), (17, 1.0, 1, 60.0, 50.0)]
    df = frame([(i, lab, res, f, a, b, 50, DAY, DAY) for i, (lab, res, f, a, b) in enumerate(rows)],
               "k int, co_tox_lab_name int, co_tox_lab_result double, time_frame int, final_dx_wt double,"
               " final_2nd_wt double, dx_age int, dx_dt date, co_tox_lab_date date")
    got = [r.crcl for r in T.creatinine_clearance(df).orderBy("k").collect()]
    assert got[0] == pytest.approx(90 * 60 * 0.85 / 72)
    assert got[1] is None and got[2] == float("inf") and got[3] is None and got[4] is None


SWAPPED = [dataclasses.replace(r, own="max" if r.own == "min" else "min") for r in L.LIMIT_RULES]
TWO_SIDED = [*L.LIMIT_RULES, L.LimitRule(L.HEMOGLOBIN, L.HIGH, "min", 16.0)]


@pytest.mark.parametrize("rules", [L.LIMIT_RULES, SWAPPED, TWO_SIDED])
def test_group_flags_equal_row_flags_with_a_hot_person(spark, frame, rules):
    """The join-free person-frame flags equal grading every imputed row; one person holds a third."""
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        who = 0 if i % 3 == 0 else rnd.randrange(1, 60)
        lab = rnd.choice([1, 3, 5, 6, 7, 8, 11, 16, 17])
        scale = {1: 2500, 16: 150000, 17: 14, 6: 200, 7: 200, 8: 600}.get(lab, 4)
        limit = {1: 2100.0, 16: 140000.0, 17: 11.5, 6: 35.0, 7: 40.0, 8: 110.0}.get(lab)
        limit = limit and (None if rnd.random() < 0.5 else limit * rnd.choice([0.9, 1.0, 1.2]))
        result = None if rnd.random() < 0.1 else round(rnd.random() * scale, 1)
        low, high = (limit, None) if lab in (1, 16, 17) else (None, limit)
        crcl = None if lab != 11 or result is None or rnd.random() < 0.2 else result * 20
        rows.append((who, DAY, lab, 1, result, low, high, 1 + who % 2, rnd.randrange(1, 5), crcl))
    df = frame(rows, FRAMED)
    done = L.impute_constant(L.drop_null_results(L.impute_own_record(df, rules)), rules)
    slow, fast = T.lab_flags(T.grade_rows(done)), T.any_lab_flags(df, rules)
    cols = ["studyid", "time_frame", *[f"{c}_g{g}_lab" for c in T.LAB_CONDITIONS for g in (1, 2, 3)],
            *[f"{c}_lab_rows" for c in T.LAB_CONDITIONS]]
    as_rows = lambda d: sorted(map(tuple, d.select(*cols).collect()), key=str)
    assert as_rows(slow) == as_rows(fast)
