"""Agreement of a test with a reference standard: confusion counts, accuracy, kappa, in batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.nulls import r_case, ratio

GRADES = (1, 2, 3)


@dataclass(frozen=True)
class Pair:
    """One comparison: column ``test_col`` against column ``ref_col``."""

    condition: str
    test: str
    against: str
    test_col: str
    ref_col: str


@dataclass(frozen=True)
class Subset:
    """A named row filter; ``keep`` maps a condition name to the filter for that condition."""

    name: str
    keep: Callable[[str], Column]


ALL_ROWS = Subset("all", lambda condition: F.lit(True))
LAB_PRESENT = Subset("lab present", lambda condition: F.col(f"missing_lab_{condition}") == 0)


def not_in_era(era: str, name: str, column: str = "dx_year_grp_more") -> Subset:
    return Subset(name, lambda condition: F.col(column) != era)


def standard_pairs(conditions: list[str]) -> list[Pair]:
    """Codes, grades and either-source against the chart, and codes against each grade."""
    out = []
    for c in conditions:
        out.append(Pair(c, "icd", "chart", f"{c}_flag_icd", f"{c}_tox"))
        for g in GRADES:
            out.append(Pair(c, f"lab g{g}", "chart", f"{c}_g{g}_lab", f"{c}_tox"))
            out.append(Pair(c, f"icd or lab g{g}", "chart", f"{c}_either_g{g}", f"{c}_tox"))
            out.append(Pair(c, "icd", f"lab g{g}", f"{c}_flag_icd", f"{c}_g{g}_lab"))
    return out


def confusion_label(test: Column, ref: Column) -> Column:
    return r_case(
        [
            ((test == 0) & (ref == 0), "TN"),
            ((test == 1) & (ref == 1), "TP"),
            ((test == 1) & (ref == 0), "FP"),
        ],
        "FN",
    )


def confusion_from_labels(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(label) == c.upper()).alias(c) for c in ("tp", "fp", "fn", "tn")]
    )


def pair_counts(
    wide: DataFrame, pairs: list[Pair], subsets: list[Subset] | None = None
) -> DataFrame:
    """2x2 counts of every pair in every subset, complete pairs only.

    People are first collapsed to distinct flag combinations, so the fan-out over pairs and subsets
    runs on a few combinations instead of on rows.
    """
    subsets = subsets or [ALL_ROWS]
    conditions = sorted({p.condition for p in pairs})
    flags = sorted({c for p in pairs for c in (p.test_col, p.ref_col)})
    masks = {
        f"__s{i}_{c}": F.coalesce(s.keep(c), F.lit(False))
        for i, s in enumerate(subsets)
        for c in conditions
    }
    combos = (
        wide.select(*flags, *[m.alias(k) for k, m in masks.items()])
        .groupBy(*flags, *masks)
        .agg(F.count("*").alias("__n"))
    )
    per_condition = []
    for c in conditions:
        tests = [
            F.struct(
                F.lit(p.test).alias("test"),
                F.lit(p.against).alias("against"),
                F.col(p.test_col).cast("int").alias("t"),
                F.col(p.ref_col).cast("int").alias("r"),
            )
            for p in pairs
            if p.condition == c
        ]
        kept = [F.when(F.col(f"__s{i}_{c}"), F.lit(s.name)) for i, s in enumerate(subsets)]
        per_condition.append(
            F.struct(
                F.lit(c).alias("condition"),
                F.array_compact(F.array(*kept)).alias("kept"),
                F.array(*tests).alias("tests"),
            )
        )
    long = (
        combos.select("__n", F.inline(F.array(*per_condition)))
        .select("__n", "condition", F.explode("kept").alias("subset"), "tests")
        .select("__n", "condition", "subset", F.inline("tests"))
        .where("t IS NOT NULL AND r IS NOT NULL")
    )
    t, r = F.col("t"), F.col("r")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0))
    return long.groupBy("subset", "condition", "test", "against").agg(
        count((t == 1) & (r == 1)).alias("tp"),
        count((t == 1) & (r == 0)).alias("fp"),
        count((t == 0) & (r == 1)).alias("fn"),
        count((t == 0) & (r == 0)).alias("tn"),
    )


def with_accuracy(counts: DataFrame, conf: float = 0.95, interval: str = "wilson") -> DataFrame:
    """Accuracy measures with intervals for the five proportions that carry them."""
    total = sum((F.col(c) for c in ("fp", "fn", "tn")), F.col("tp"))
    ends = {
        "sensitivity": (F.col("tp"), F.col("tp") + F.col("fn")),
        "specificity": (F.col("tn"), F.col("tn") + F.col("fp")),
        "ppv": (F.col("tp"), F.col("tp") + F.col("fp")),
        "npv": (F.col("tn"), F.col("tn") + F.col("fn")),
        "accuracy": (F.col("tp") + F.col("tn"), total),
    }
    method = {"wilson": M.wilson, "exact": M.exact_interval}[interval]
    cols = dict(M.accuracy_columns())
    for name, (k, n) in ends.items():
        cols[f"{name}_low"], cols[f"{name}_high"] = method(k, n, conf)
    cols.update(M.lr_intervals(conf=conf))
    return counts.withColumns(cols)


def with_agreement(counts: DataFrame) -> DataFrame:
    total = sum((F.col(c) for c in ("fp", "fn", "tn")), F.col("tp"))
    cols = M.agreement_columns(F.col("tp") + F.col("tn"), total)
    return counts.withColumns({**cols, **M.binary_kappa_columns()})


def batch_validation(
    wide: DataFrame, conditions: list[str], subsets: list[Subset] | None = None
) -> DataFrame:
    """Every comparison in every subset, with all measures, from one aggregation."""
    counts = pair_counts(wide, standard_pairs(conditions), subsets)
    return with_agreement(with_accuracy(counts))


def kappa_table(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Percent agreement and kappa of two raters with any number of categories."""
    keys = keys or []
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(
        F.count("*").alias("c")
    )
    sides = F.array(
        F.struct(
            F.col(a).cast("string").alias("cat"),
            F.col("c").alias("ca"),
            F.lit(0).cast("long").alias("cb"),
            F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col(b).cast("string").alias("cat"),
            F.lit(0).cast("long").alias("ca"),
            F.col("c").alias("cb"),
            F.lit(0).cast("long").alias("hit"),
        ),
    )
    margins = joint.select(*keys, F.inline(sides)).groupBy(*keys, "cat").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("ca", "cb", "hit")]
    )
    product = F.col("ca") * F.col("cb")
    total = margins.groupBy(*keys).agg(
        F.sum("ca").alias("total"),
        F.sum("hit").alias("hit"),
        F.sum(product).alias("pe"),
        F.sum(product * (F.col("ca") + F.col("cb"))).alias("cross"),
    )
    n = F.col("total")
    cols = {
        **M.agreement_columns(F.col("hit"), n),
        **M.kappa_columns(
            ratio(F.col("hit"), n), ratio(F.col("pe"), n * n), ratio(F.col("cross"), n * n * n), n
        ),
    }
    return total.select(*keys, n.cast("long").alias("n"), *[c.alias(k) for k, c in cols.items()])
