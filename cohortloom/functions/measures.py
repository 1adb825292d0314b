"""Closed-form statistics as column expressions over counts that are already aggregated."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, r_case, ratio

Z95 = NormalDist().inv_cdf(0.975)


def z_value(conf: float) -> float:
    return NormalDist().inv_cdf(0.5 + conf / 2)


def wilson(successes: Column, n: Column, conf: float = 0.95) -> tuple[Column, Column]:
    """Score interval for a proportion (Wilson 1927); null when ``n`` is 0."""
    z = z_value(conf)
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = ratio(successes, n)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / scale
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta integral (modified Lentz), vectorised."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out = out * step
        if np.all(np.abs(step - 1.0) < 1e-14):
            break
    return out


def beta_cdf(x, a, b):
    """Regularised incomplete beta function for arrays ``0 < x < 1``."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    xs, aa, bb = np.where(low, x, 1 - x), np.where(low, a, b), np.where(low, b, a)
    tail = front * _beta_fraction(aa, bb, xs) / aa
    return np.where(low, tail, 1 - tail)


def beta_quantile(q: float, a, b):
    """Inverse of ``beta_cdf`` by bisection."""
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(70):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a, b) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def clopper_pearson(k: np.ndarray, n: np.ndarray, conf: float = 0.95):
    """Exact binomial interval (Clopper & Pearson 1934)."""
    alpha = 1 - conf
    k, n = k.astype(float), n.astype(float)
    low, high = np.zeros_like(k), np.ones_like(k)
    inner = k > 0
    if inner.any():
        low[inner] = beta_quantile(alpha / 2, k[inner], n[inner] - k[inner] + 1)
    inner = k < n
    if inner.any():
        high[inner] = beta_quantile(1 - alpha / 2, k[inner] + 1, n[inner] - k[inner])
    empty = n == 0
    low[empty] = np.nan
    high[empty] = np.nan
    return low, high


def exact_interval(successes: Column, n: Column, conf: float = 0.95) -> tuple[Column, Column]:
    """Clopper-Pearson limits; only ever applied to aggregated count rows."""

    @F.pandas_udf("low double, high double")
    def limits(k: pd.Series, m: pd.Series) -> pd.DataFrame:
        low, high = clopper_pearson(k.to_numpy(), m.to_numpy(), conf)
        return pd.DataFrame({"low": low, "high": high})

    both = limits(successes.cast("long"), n.cast("long"))
    return F.nanvl(both["low"], F.lit(None)), F.nanvl(both["high"], F.lit(None))


def accuracy_columns(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """Diagnostic accuracy of a 2x2 table (test in rows, reference standard in columns)."""
    tp, fp, fn, tn = (col(c).cast("double") for c in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    se, sp = ratio(tp, tp + fn), ratio(tn, tn + fp)
    youden = se + sp - 1
    return {
        "sensitivity": se,
        "specificity": sp,
        "ppv": ratio(tp, tp + fp),
        "npv": ratio(tn, tn + fn),
        "apparent_prev": ratio(tp + fp, n),
        "true_prev": ratio(tp + fn, n),
        "accuracy": ratio(tp + tn, n),
        "youden": youden,
        "dor": ratio(tp * tn, fp * fn),
        "lr_pos": ratio(se, 1 - sp),
        "lr_neg": ratio(1 - se, sp),
        "nnd": ratio(F.lit(1.0), youden),
    }


def lr_intervals(tp="tp", fp="fp", fn="fn", tn="tn", conf: float = 0.95) -> dict[str, Column]:
    """Log-method limits of both likelihood ratios (Simel 1991); null when a needed cell is 0."""
    z = z_value(conf)
    tp, fp, fn, tn = (col(c).cast("double") for c in (tp, fp, fn, tn))
    se, sp = ratio(tp, tp + fn), ratio(tn, tn + fp)
    out = {}
    for name, est, a, b in (
        ("lr_pos", ratio(se, 1 - sp), tp, fp),
        ("lr_neg", ratio(1 - se, sp), fn, tn),
    ):
        var = ratio(F.lit(1.0), a) - ratio(F.lit(1.0), tp + fn)
        var = var + ratio(F.lit(1.0), b) - ratio(F.lit(1.0), fp + tn)
        half = z * F.sqrt(F.when(var >= 0, var))
        out[f"{name}_low"] = est * F.exp(-half)
        out[f"{name}_high"] = est * F.exp(half)
    return out


def agreement_columns(agree: Column, n: Column, conf_z: float = 1.96) -> dict[str, Column]:
    """Percent agreement with the normal-approximation limits."""
    p = ratio(agree, n)
    half = conf_z * F.sqrt(ratio(p * (1 - p), n))
    return {"agree_pct": 100 * p, "agree_low": 100 * (p - half), "agree_high": 100 * (p + half)}


def kappa_columns(po: Column, pe: Column, cross: Column, n: Column) -> dict[str, Column]:
    """Cohen's kappa with the null standard error (Fleiss, Cohen & Everitt 1969).

    ``cross`` is ``sum_i p_i. p_.i (p_i. + p_.i)``.
    """
    kappa = ratio(po - pe, 1 - pe)
    # a raw difference that is a rounding error below zero would make sqrt NaN
    var = F.greatest(pe + pe * pe - cross, F.lit(0.0))
    se0 = ratio(F.sqrt(var), (1 - pe) * F.sqrt(n.cast("double")))
    return {
        "kappa": kappa,
        "kappa_se0": se0,
        "kappa_z": ratio(kappa, se0),
        "kappa_low": kappa - Z95 * se0,
        "kappa_high": kappa + Z95 * se0,
    }


def binary_kappa_columns(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    tp, fp, fn, tn = (col(c).cast("double") for c in (tp, fp, fn, tn))
    n = F.nullif(tp + fp + fn + tn, F.lit(0.0))
    a1, b1 = (tp + fp) / n, (tp + fn) / n
    a0, b0 = 1 - a1, 1 - b1
    po = (tp + tn) / n
    pe = a1 * b1 + a0 * b0
    cross = a1 * b1 * (a1 + b1) + a0 * b0 * (a0 + b0)
    return kappa_columns(po, pe, cross, n)


def risk_columns(a="n11", b="n10", c="n01", d="n00", conf: float = 0.95) -> dict[str, Column]:
    """RR, OR and RD with log-Wald (Wald for RD) limits.

    Cells: a exposed with outcome, b exposed without, c unexposed with, d unexposed without.
    """
    z = z_value(conf)
    a, b, c, d = (col(x).cast("double") for x in (a, b, c, d))
    r1, r0 = ratio(a, a + b), ratio(c, c + d)
    rr, odds = ratio(r1, r0), ratio(a * d, b * c)
    inv = lambda x: ratio(F.lit(1.0), x)
    se_rr = F.sqrt(inv(a) - inv(a + b) + inv(c) - inv(c + d))
    se_or = F.sqrt(inv(a) + inv(b) + inv(c) + inv(d))
    rd = r1 - r0
    se_rd = F.sqrt(ratio(r1 * (1 - r1), a + b) + ratio(r0 * (1 - r0), c + d))
    return {
        "risk1": r1,
        "risk0": r0,
        "rr": rr,
        "rr_low": rr * F.exp(-z * se_rr),
        "rr_high": rr * F.exp(z * se_rr),
        "odds_ratio": odds,
        "or_low": odds * F.exp(-z * se_or),
        "or_high": odds * F.exp(z * se_or),
        "rd": rd,
        "rd_low": rd - z * se_rd,
        "rd_high": rd + z * se_rd,
    }


def bounding_factor(rr_ud: Column, rr_eu: Column) -> Column:
    return ratio(rr_ud * rr_eu, rr_ud + rr_eu - 1)


def bias_corrected(rr: Column, estimate: Column, b: Column) -> Column:
    """Shift ``estimate`` toward the null by the bounding factor, on the side of ``rr``."""
    return F.when(rr >= 1, ratio(estimate, b)).when(rr < 1, estimate * b)


def e_value(rr: Column) -> Column:
    """Smallest joint confounder strength that could explain ``rr`` away."""
    up = F.when(rr >= 1, rr).when(rr > 0, 1 / rr)
    return up + F.sqrt(up * (up - 1))


def e_value_limit(rr: Column, low: Column, high: Column) -> Column:
    """E-value of the confidence limit nearest the null; 1 when the interval holds 1."""
    return (
        F.when(rr >= 1, F.when(low <= 1, 1.0).otherwise(e_value(low)))
        .when(rr < 1, F.when(high >= 1, 1.0).otherwise(e_value(high)))
    )


def as_risk_ratio(kind: Column, estimate: Column) -> Column:
    """Approximate risk ratio of another effect measure (VanderWeele & Ding 2017)."""
    root = F.sqrt(F.when(estimate > 0, estimate))
    return (
        F.when(kind.isin("rr", "or_rare", "hr_rare", "rate"), estimate)
        .when(kind == "or_common", root)
        .when(
            kind == "hr_common",
            (1 - F.pow(F.lit(0.5), root)) / (1 - F.pow(F.lit(0.5), 1 / root)),
        )
        .when(kind == "smd", F.exp(0.91 * estimate))
    )


def side_of_null(value: Column, tol: float) -> Column:
    """-1 below the null, 0 at it (within relative ``tol``), 1 above it."""
    return r_case([(value > 1 + tol, 1), (value < 1 / (1 + tol), -1)], 0)
