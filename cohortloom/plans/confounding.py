"""From a causal graph to adjusted effects and E-values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dag as G
from ..operators import effects as E
from ..operators import evalue as V


def screened_effects(df: DataFrame, covariates: list[str], roles: E.Roles = E.Roles()) -> DataFrame:
    """Crude against pooled RR, pattern and E-value for every candidate covariate."""
    screen = E.screen_covariates(df, covariates, roles)
    est = screen.withColumns(
        {"kind": F.lit("rr"), "estimate": F.col("rr_adj"), "low": F.col("rr_min"),
         "high": F.col("rr_max")}
    )
    return V.with_e_values(est).select(
        "covariate", "n_strata", "rr_crude", "rr_adj", "rr_min", "rr_max", "pattern", "e_value"
    )


def stratum_e_values(df: DataFrame, by: str, roles: E.Roles = E.Roles()) -> DataFrame:
    """E-values of every stratum's RR and of its confidence limit nearest the null."""
    strata = E.measures(df, [by], roles).select(
        by,
        F.lit("rr").alias("kind"),
        F.col("rr").alias("estimate"),
        F.col("rr_low").alias("low"),
        F.col("rr_high").alias("high"),
    )
    return V.with_e_values(strata.where("estimate > 0"))


def adjustment_covariates(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """Nodes to adjust for: confounders of exposure and outcome."""
    return G.variable_roles(edges, questions).where("role IN ('confounder', 'proxy confounder')")
