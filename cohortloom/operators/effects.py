"""Effect measures by stratum, pooled measures, confounding and interaction classification."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.nulls import ratio
from .scale import checkpointed


CELLS = ("n11", "n10", "n01", "n00")


def cell_total() -> Column:
    return sum((F.col(x) for x in CELLS[1:]), F.col(CELLS[0]))


@dataclass(frozen=True)
class Roles:
    exposure: str = "x"
    outcome: str = "y"


def cells(df: DataFrame, keys: list[str], roles: Roles = Roles()) -> DataFrame:
    """2x2 cells per key, named n<exposure><outcome>."""
    x, y = F.col(roles.exposure), F.col(roles.outcome)
    return df.groupBy(*keys).agg(
        F.count_if((x == 1) & (y == 1)).alias("n11"),
        F.count_if((x == 1) & (y == 0)).alias("n10"),
        F.count_if((x == 0) & (y == 1)).alias("n01"),
        F.count_if((x == 0) & (y == 0)).alias("n00"),
    )


def measures(df: DataFrame, keys: list[str], roles: Roles = Roles()) -> DataFrame:
    """Crude (no keys) or stratum-specific RR, OR and RD."""
    return cells(df, keys, roles).withColumns(M.risk_columns())


def _pooled(strata: DataFrame, keys: list[str]) -> DataFrame:
    a, b, c, d = (F.col(x).cast("double") for x in CELLS)
    n = F.nullif(a + b + c + d, F.lit(0.0))
    return strata.groupBy(*keys).agg(
        ratio(F.sum(a * (c + d) / n), F.sum(c * (a + b) / n)).alias("rr_adj"),
        ratio(F.sum(a * d / n), F.sum(b * c / n)).alias("or_adj"),
        *[F.sum(x).alias(x) for x in CELLS],
        F.min("rr").alias("rr_min"),
        F.max("rr").alias("rr_max"),
        F.count("*").alias("n_strata"),
    )


def mantel_haenszel(df: DataFrame, stratum: str, roles: Roles = Roles()) -> DataFrame:
    """Pooled RR and OR over strata, next to the crude ones."""
    strata = measures(df, [stratum], roles)
    return _pooled(strata, []).withColumns(
        {k: v for k, v in M.risk_columns().items() if k in ("rr", "odds_ratio")}
    )


def classify(
    crude: Column, low: Column, high: Column, alike: float = 1.5, near_null: float = 0.05
) -> Column:
    """Pattern of the stratum RRs (their ``low`` and ``high`` end) around the crude RR.

    Crude strictly between differing strata is interaction. Strata on one side of it are confounding
    if they are alike and on one side of 1, and otherwise only lean that way.
    ``alike`` is the largest ratio at which stratum RRs still count as the same.
    """
    side = lambda v: M.side_of_null(v, near_null)
    same = ratio(high, low) <= alike
    between = (low < crude) & (crude < high)
    qualitative = (side(low) != side(high)) | (side(low) == 0)
    mean = F.sqrt(low * high)
    distance = F.abs(F.log(mean)) - F.abs(F.log(crude))
    confounding = (
        F.when((mean - 1) * (crude - 1) < 0, "qualitative confounding")
        .when(distance < 0, "positive confounding")
        .otherwise("negative confounding")
    )
    return (
        F.when(crude.isNull() | low.isNull() | high.isNull(), None)
        .when((low <= 0) | (crude <= 0), "undefined")
        .when(between & ~same & qualitative, "qualitative interaction")
        .when(between & ~same, "quantitative interaction")
        .when(between | (low == crude) | (high == crude), "no clear change")
        .when(~same | (side(low) * side(high) < 0), "leans to confounding")
        .otherwise(confounding)
    )


def screen_covariates(
    df: DataFrame, covariates: list[str], roles: Roles = Roles(), alike: float = 1.5
) -> DataFrame:
    """Crude, pooled and stratum-range RR with the pattern label, for many covariates at once."""
    cells_of = F.array(
        *[
            F.struct(F.lit(c).alias("covariate"), F.col(c).cast("string").alias("level"))
            for c in covariates
        ]
    )
    long = df.select(roles.exposure, roles.outcome, F.inline(cells_of)).where("level IS NOT NULL")
    strata = measures(long, ["covariate", "level"], roles)
    pooled = _pooled(strata, ["covariate"])
    pooled = pooled.withColumn("rr_crude", M.risk_columns()["rr"])
    label = classify(F.col("rr_crude"), F.col("rr_min"), F.col("rr_max"), alike)
    return pooled.withColumn("pattern", label).drop(*CELLS)


def covariate_association(
    df: DataFrame, covariates: list[str], roles: Roles = Roles()
) -> DataFrame:
    """Confounder criteria: exposure prevalence, and outcome risk in the unexposed, by level."""
    cells_of = F.array(
        *[
            F.struct(F.lit(c).alias("covariate"), F.col(c).cast("string").alias("level"))
            for c in covariates
        ]
    )
    long = df.select(roles.exposure, roles.outcome, F.inline(cells_of)).where("level IS NOT NULL")
    out = cells(long, ["covariate", "level"], roles)
    return out.select(
        "covariate",
        "level",
        ratio(F.col("n11") + F.col("n10"), cell_total()).alias("p_exposed"),
        ratio(F.col("n01"), F.col("n01") + F.col("n00")).alias("risk_unexposed"),
    )


TERMS = ["intercept", "x", "z", "xz"]
MOST_STEPS, SETTLED, FARTHEST = 30, 1e-10, 25.0


def interaction_model(df: DataFrame, z: str, roles: Roles = Roles()) -> DataFrame:
    """Logistic model with exposure, ``z`` (standardised) and their product; one row per term.

    Newton steps on sums: rows are reduced to counts per exposure and value of ``z``, and each step is one
    aggregation to the gradient and the 4 x 4 curvature. ``converged`` is false, and the columns beside
    it null, where a model has no estimate: groups that the terms separate (coefficients run away), terms that
    depend on each other (no curvature), or no rows.
    """
    x, y = F.col(roles.exposure).cast("double"), F.col(roles.outcome).cast("double")
    known = df.where(x.isNotNull() & y.isNotNull() & F.col(z).isNotNull())
    stats = known.agg(F.avg(z).alias("m"), F.stddev(z).alias("s")).first()
    scaled = (F.col(z) - F.lit(stats["m"])) / F.lit(stats["s"] or 1.0)
    rows = known.select(x.alias("x"), y.alias("y"), scaled.alias("z"))
    # every step reads the counts again, so they are written once
    rows = checkpointed(rows.groupBy("x", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("yes")))
    beta, spread, converged = np.zeros(4), None, False
    for _ in range(MOST_STEPS):
        rise, bend = _newton_sums(rows, beta)
        if not np.isfinite(bend).all() or np.linalg.cond(bend) > 1e12:
            break
        step = np.linalg.solve(bend, rise)
        beta = beta + step
        if np.abs(beta).max() > FARTHEST:
            break
        if np.abs(step).max() < SETTLED:
            spread, converged = np.sqrt(np.diag(np.linalg.inv(bend))), True
            break
    table = []
    for i, term in enumerate(TERMS):
        if converged:
            p = math.erfc(abs(beta[i] / spread[i]) / math.sqrt(2))
            table.append((term, float(beta[i]), float(spread[i]), p, True))
        else:
            table.append((term, None, None, None, False))
    schema = "term string, estimate double, std_error double, p_value double, converged boolean"
    return df.sparkSession.createDataFrame(table, schema)


def _newton_sums(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and negated curvature of the log-likelihood, from one aggregation."""
    terms = [F.lit(1.0), F.col("x"), F.col("z"), F.col("x") * F.col("z")]
    score = reduce(lambda a, b: a + b, [F.lit(float(b)) * t for b, t in zip(beta, terms, strict=True)])
    p = 1 / (1 + F.exp(-score))
    left, weight = F.col("yes") - F.col("n") * p, F.col("n") * p * (1 - p)
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = [F.sum(left * t) for t in terms] + [F.sum(weight * terms[i] * terms[j]) for i, j in pairs]
    got = np.array([math.nan if v is None else v for v in rows.agg(*sums).first()], float)
    bend = np.zeros((4, 4))
    for (i, j), v in zip(pairs, got[4:], strict=True):
        bend[i, j] = bend[j, i] = v
    return got[:4], bend
