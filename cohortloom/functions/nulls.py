"""Missing-value semantics shared by every operator.

The source analyses treat a missing condition as a missing answer, which is not what
``CASE WHEN`` does. Everything that depends on that difference lives here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def r_ifelse(cond: Column, yes, no) -> Column:
    """Two-way choice that is null when ``cond`` is null (CASE would take the ELSE arm)."""
    return F.when(cond.isNull(), None).when(cond, _value(yes)).otherwise(_value(no))


def r_case(arms: list[tuple[Column, object]], default=None) -> Column:
    """Chain of ``r_ifelse``: the first null condition met makes the result null."""
    out = F
    for cond, value in arms:
        out = out.when(cond.isNull(), None).when(cond, _value(value))
    return out.otherwise(_value(default))


def overwrite(target: Column | str, cond: Column, value) -> Column:
    """``x[cond] <- v``: rows whose condition is null keep their old value."""
    return F.when(cond, _value(value)).otherwise(col(target))


def strict_sum(x: Column | str) -> Column:
    """Sum that is null as soon as one input is null."""
    return F.when(F.count(col(x)) == F.count(F.lit(1)), F.sum(col(x)))


def strict_min(x: Column | str) -> Column:
    return F.when(F.count(col(x)) == F.count(F.lit(1)), F.min(col(x)))


def strict_max(x: Column | str) -> Column:
    return F.when(F.count(col(x)) == F.count(F.lit(1)), F.max(col(x)))


def null_count(x: Column | str) -> Column:
    return F.count_if(col(x).isNull())


def in_set(x: Column | str, values) -> Column:
    """Membership that is never null; a null matches only if ``values`` holds a null."""
    known = [v for v in values if v is not None]
    hit = F.coalesce(col(x).isin(known), F.lit(False)) if known else F.lit(False)
    return hit | col(x).isNull() if None in values else hit


def any_flag(n: Column) -> Column:
    """Collapse an event count to 0/1, keeping null as null."""
    return r_ifelse(n == 0, 0, 1)


def half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(col(x), digits)


def trunc_years(later: Column | str, earlier: Column | str) -> Column:
    """Whole 365-day years between two dates, truncated toward zero."""
    return (F.datediff(col(later), col(earlier)) / 365).cast("int")


def cut(x: Column | str, breaks: list, labels: list[str]) -> Column:
    """Left-closed intervals: ``labels[i]`` for values below ``breaks[i]``, the last label above."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("cut needs one more label than breaks")
    return r_case([(col(x) < F.lit(b), lab) for b, lab in zip(breaks, labels)], labels[-1])


def recode(x: Column | str, mapping: dict) -> Column:
    """Code -> label; a code outside the mapping becomes null."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.create_map(*pairs)[col(x)]


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def ratio(num: Column, den: Column) -> Column:
    """Division in doubles that is null for a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
