"""Unmeasured-confounding sensitivity: observed and standardised RR, bounding factor, E-values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.nulls import ratio
from .effects import CELLS, Roles, cell_total, cells


def observed_rr(df: DataFrame, by: str, roles: Roles = Roles()) -> DataFrame:
    """Risk ratio within each level of the measured covariates."""
    return cells(df, [by], roles).select(
        by, M.risk_columns()["rr"].alias("rr_obs")
    )


def _by_level(df: DataFrame, by: str, u: str, roles: Roles) -> DataFrame:
    return cells(df, [by, u], roles)


def exposure_confounder_rr(df: DataFrame, by: str, u: str, roles: Roles = Roles()) -> DataFrame:
    """Largest ratio over levels of ``u`` of its prevalence in exposed to unexposed."""
    level = _by_level(df, by, u, roles)
    totals = level.groupBy(by).agg(
        F.sum(F.col("n11") + F.col("n10")).alias("n1"), F.sum(F.col("n01") + F.col("n00")).alias("n0")
    )
    p1 = ratio(F.col("n11") + F.col("n10"), F.col("n1"))
    p0 = ratio(F.col("n01") + F.col("n00"), F.col("n0"))
    return level.join(totals, by).groupBy(by).agg(F.max(ratio(p1, p0)).alias("rr_eu"))


def confounder_outcome_rr(df: DataFrame, by: str, u: str, roles: Roles = Roles()) -> DataFrame:
    """Largest over exposure groups of the max-to-min outcome risk over levels of ``u``."""
    cols = M.risk_columns()
    risk = _by_level(df, by, u, roles).select(
        by, cols["risk1"].alias("risk1"), cols["risk0"].alias("risk0")
    )
    spread = lambda c: ratio(F.max(c), F.min(c))
    return risk.groupBy(by).agg(F.greatest(spread("risk1"), spread("risk0")).alias("rr_ud"))


def standardised_rr(df: DataFrame, by: str, u: str, roles: Roles = Roles()) -> DataFrame:
    """Risk ratio standardised to the distribution of ``u``; levels lacking an exposure group
    leave the ratio null, since its risk there is unknown."""
    cols = M.risk_columns()
    level = _by_level(df, by, u, roles).select(
        by,
        cols["risk1"].alias("r1"),
        cols["risk0"].alias("r0"),
        cell_total().alias("n"),
    )
    whole = (F.count("r1") == F.count(F.lit(1))) & (F.count("r0") == F.count(F.lit(1)))
    top, bottom = F.sum(F.col("r1") * F.col("n")), F.sum(F.col("r0") * F.col("n"))
    return level.groupBy(by).agg(F.when(whole, ratio(top, bottom)).alias("rr_true"))


def bias_analysis(df: DataFrame, by: str, u: str, roles: Roles = Roles()) -> DataFrame:
    """Observed, standardised and bound-corrected RR per covariate level, with the bound."""
    out = (
        cells(df, [by], roles)
        .withColumns({k: M.risk_columns()[k] for k in ("rr", "rr_low", "rr_high")})
        .drop(*CELLS)
        .join(exposure_confounder_rr(df, by, u, roles), by)
        .join(confounder_outcome_rr(df, by, u, roles), by)
        .join(standardised_rr(df, by, u, roles), by)
    )
    out = out.withColumn("bound", M.bounding_factor(F.col("rr_ud"), F.col("rr_eu")))
    rr, b = F.col("rr"), F.col("bound")
    return out.withColumns(
        {f"{c}_corrected": M.bias_corrected(rr, F.col(c), b) for c in ("rr", "rr_low", "rr_high")}
    )


def with_e_values(
    estimates: DataFrame, kind: str = "kind", est: str = "estimate", low="low", high="high"
) -> DataFrame:
    """E-values of the point and of the limit nearest the null, for any supported measure."""
    conv = {f"rr_{c}": M.as_risk_ratio(F.col(kind), F.col(c)) for c in (est, low, high)}
    out = estimates.withColumns(conv)
    rr, lo, hi = (F.col(f"rr_{c}") for c in (est, low, high))
    return out.withColumns(
        {"e_value": M.e_value(rr), "e_value_limit": M.e_value_limit(rr, lo, hi)}
    )


def contour(estimates: DataFrame, rr: str = "rr", top: float = 20.0, points: int = 40) -> DataFrame:
    """Grid of (RR_EU, RR_UD) pairs on the boundary that explains each estimate away."""
    up = F.when(F.col(rr) >= 1, F.col(rr)).when(F.col(rr) > 0, 1 / F.col(rr))
    step = F.explode(F.sequence(F.lit(1), F.lit(points))).alias("step")
    grid = estimates.withColumn("__up", up).where("__up IS NOT NULL").select("*", step)
    eu = F.col("__up") + F.col("step") * (F.lit(top) / points)
    return grid.withColumn("rr_eu", eu).withColumn(
        "rr_ud", F.col("__up") * (F.col("rr_eu") - 1) / (F.col("rr_eu") - F.col("__up"))
    ).drop("__up")
