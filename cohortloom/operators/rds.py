"""Respondent-driven sampling: frame, waves, estimators, weights, diagnostics, intervals.

Everything row-level stays in Spark. What reaches the driver is bounded by construction and checked:
group-by-group recruitment counts and degree histograms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.nulls import ratio
from .labs import distribution
from .scale import checkpointed, join_null_safe, running_sums, side_by_side

MAX_CELLS = 1_000_000


@dataclass(frozen=True)
class Frame:
    """Column roles of a respondent table; a null recruiter marks a seed."""

    id: str = "id"
    recruiter: str = "recruiter_id"
    degree: str = "network_size"
    outcome: str = "y"
    order: str | None = "sample_order"


def _inverse(degree: Column) -> Column:
    return ratio(F.lit(1.0), degree)


def _bounded(df: DataFrame) -> pd.DataFrame:
    """Bring an aggregate to the driver, refusing anything that is not small."""
    rows = df.limit(MAX_CELLS + 1).toPandas()
    if len(rows) > MAX_CELLS:
        raise ValueError("too many group or degree cells for a driver-side solve")
    return rows


def _known_degree(frame: Frame) -> Column:
    # also keeps NaN and infinity out
    return (F.col(frame.degree) > 0) & (F.col(frame.degree) < float("inf"))


def usable(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Respondents every estimator works on: known outcome and a known, positive degree.

    The others are left out, with the recruitments they made or came from; ``left_out`` counts them.
    """
    return df.where(F.col(frame.outcome).isNotNull() & _known_degree(frame))


def left_out(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """How many respondents the estimators leave out, and why (one row)."""
    degree = F.col(frame.degree)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(frame.outcome).isNull()).alias("no_outcome"),
        F.count_if(degree.isNull()).alias("no_degree"),
        F.count_if(degree.isNotNull() & ~F.coalesce(_known_degree(frame), F.lit(False))).alias("bad_degree"),
        F.count_if(F.col(frame.outcome).isNull() | ~F.coalesce(_known_degree(frame), F.lit(False))).alias("left_out"),
    )


def recruiter_from_coupons(
    df: DataFrame, coupons: list[str], subject: str = "own_coupon", key: str = "id"
) -> DataFrame:
    """Recruiter = whoever was handed the respondent's own coupon; otherwise ``seed``.

    A coupon listed by several people goes to the smallest id; one's own listing does not count.
    """
    handed = df.unpivot([key, subject], coupons, "slot", "coupon")
    handed = handed.where(F.col("coupon").isNotNull() & ~F.col("coupon").eqNullSafe(F.col(subject)))
    giver = handed.groupBy(F.col("coupon").alias(subject)).agg(F.min(key).alias("giver"))
    out = df.join(giver, subject, "left")
    return out.withColumn(
        "recruiter_id", F.coalesce(F.col("giver").cast("string"), F.lit("seed"))
    ).drop("giver")


def with_waves(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Seed and wave of every respondent, by pointer doubling up the recruitment trees.

    Each round doubles the distance covered, so the number of rounds is logarithmic in the deepest
    chain. A respondent is written once more per round until it is resolved and never again: every round
    adds a table of what was still open, and lookups go to all of these. Respondents whose chain is broken or
    circular keep a null seed and wave.
    """
    first = checkpointed(
        df.select(
            F.col(frame.id).alias("id"),
            F.coalesce(frame.recruiter, frame.id).alias("ptr"),
            F.col(frame.recruiter).isNotNull().cast("long").alias("dist"),
            F.col(frame.recruiter).isNull().alias("done"),
        )
    )
    resolved, open_ = first.where("done"), first.where("NOT done")
    reach, total = 1, first.count()
    while reach <= 4 * total:
        # two doublings per written table
        once = _double(open_, resolved.unionByName(open_))
        far = once.where("NOT done")
        moved = checkpointed(once.where("done").unionByName(_double(far, resolved.unionByName(once))))
        resolved, open_ = resolved.unionByName(moved.where("done")), moved.where("NOT done")
        reach *= 4
        if open_.isEmpty():
            break
    found = resolved.where("ptr IS NOT NULL").select(
        F.col("id").alias(frame.id), F.col("ptr").alias("seed_id"), F.col("dist").alias("wave")
    )
    return df.join(found, frame.id, "left")


def _double(open_: DataFrame, known: DataFrame) -> DataFrame:
    """The open respondents with the pointer of whom they point to; ``known`` has everybody's."""
    ahead = known.select(
        F.col("id").alias("ptr"),
        F.col("ptr").alias("next_ptr"),
        F.col("dist").alias("next_dist"),
        F.col("done").alias("next_done"),
    )
    # an unknown recruiter ends the chain without a seed
    return open_.join(ahead, "ptr", "left").select(
        "id",
        F.col("next_ptr").alias("ptr"),
        (F.col("dist") + F.col("next_dist")).alias("dist"),
        F.coalesce("next_done", F.lit(True)).alias("done"),
    )


def validity_report(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Number of violations per rule of a valid respondent table."""
    i, r, d = (F.col(c) for c in (frame.id, frame.recruiter, frame.degree))
    simple = df.agg(
        F.count_if(i.isNull()).alias("missing id"),
        F.count_if(d.isNull() | (d <= 0)).alias("bad network size"),
        F.count_if(i == r).alias("self recruitment"),
    ).unpivot([], ["missing id", "bad network size", "self recruitment"], "rule", "n_bad")
    repeated = df.groupBy(frame.id).count().where("count > 1")
    rules = [simple, repeated.agg(F.count("*").alias("n_bad")).withColumn("rule", F.lit("repeated id"))]
    owners = df.select(i.alias("__o"), *([F.col(frame.order).alias("__t")] if frame.order else []))
    recruits = df.where(r.isNotNull()).select(r.alias("__o"), frame.id,
                                              *([frame.order] if frame.order else []))
    lost = recruits.join(owners.select("__o").distinct(), "__o", "left_anti")
    rules.append(lost.agg(F.count("*").alias("n_bad")).withColumn("rule", F.lit("unknown recruiter")))
    if frame.order:
        late = recruits.join(owners, "__o").where(F.col("__t") > F.col(frame.order))
        rules.append(
            late.agg(F.count("*").alias("n_bad")).withColumn("rule", F.lit("recruited before recruiter"))
        )
    lost = circular(df.where(i.isNotNull()).dropDuplicates([frame.id]), frame)
    rules.append(lost.agg(F.count("*").alias("n_bad")).withColumn("rule", F.lit("no path to a seed")))
    return reduce(DataFrame.unionByName, [x.select("rule", "n_bad") for x in rules])


def circular(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Respondents with no path to a seed (circular or broken chains)."""
    return with_waves(df, frame).where("seed_id IS NULL")


def tree_edges(waves: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """(seed, wave, recruiter, recruit, stratum) for every recruitment."""
    return waves.where(F.col(frame.recruiter).isNotNull()).select(
        "seed_id",
        "wave",
        F.col(frame.recruiter).alias("recruiter"),
        F.col(frame.id).alias("recruit"),
        F.col(frame.outcome).alias("stratum"),
    )


def degree_by_wave(waves: DataFrame, frame: Frame = Frame(), strata: list[str] | None = None):
    return distribution(waves, ["wave", *(strata or [])], frame.degree)


def recruitment_counts(
    df: DataFrame, frame: Frame = Frame(), keep: list[str] | None = None
) -> DataFrame:
    """Recruitments ``r`` from group ``g`` to group ``h`` (by ``keep`` attributes of the recruit).

    Recruits are counted per recruiter first, so a prolific recruiter meets the join as few rows.
    """
    keep = keep or []
    made = (
        df.where(F.col(frame.recruiter).isNotNull())
        .groupBy(F.col(frame.recruiter).alias("__o"), F.col(frame.outcome).alias("h"), *keep)
        .agg(F.count("*").alias("__n"))
    )
    owners = df.select(F.col(frame.id).alias("__o"), F.col(frame.outcome).alias("g"))
    return made.join(owners, "__o").groupBy("g", "h", *keep).agg(F.sum("__n").alias("r"))


def group_degrees(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Size, harmonic and arithmetic mean degree per group."""
    d = F.col(frame.degree)
    return df.groupBy(F.col(frame.outcome).alias("level")).agg(
        F.count("*").alias("n"),
        ratio(F.count("*"), F.sum(_inverse(d))).alias("harmonic_degree"),
        F.avg(d).alias("mean_degree"),
        F.sum(_inverse(d)).alias("inverse_degree"),
    )


def _two_group_row(counts: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row with S_AB, S_BA, D_A, D_B (A: level 1, B: level 0) and recruitment margins."""
    r = lambda g, h: F.coalesce(F.sum(F.when((F.col("g") == g) & (F.col("h") == h), F.col("r"))), F.lit(0))  # noqa: E731,E501
    rec = counts.agg(*[r(g, h).alias(f"r{g}{h}") for g in (0, 1) for h in (0, 1)])
    at = lambda c, lvl: F.max(F.when(F.col("level") == lvl, F.col(c))).alias(f"{c}{lvl}")
    cols = ("n", "harmonic_degree", "mean_degree", "inverse_degree")
    deg = degrees.agg(*[at(c, lvl) for c in cols for lvl in (0, 1)])
    return side_by_side(rec, deg).withColumns(
        {
            "s01": ratio(F.col("r01"), F.col("r00") + F.col("r01")),
            "s10": ratio(F.col("r10"), F.col("r10") + F.col("r11")),
        }
    )


def _rds_i_expr(d0: str = "harmonic_degree0", d1: str = "harmonic_degree1") -> Column:
    a, b = F.col("s01") * F.col(d0), F.col("s10") * F.col(d1)
    return ratio(a, a + b)


def rds_i_binary(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Prevalence of a 0/1 outcome from cross-recruitment shares and harmonic degrees."""
    df = usable(df, frame)
    row = _two_group_row(recruitment_counts(df, frame), group_degrees(df, frame))
    return row.select(F.lit("RDS-I").alias("estimator"), _rds_i_expr().alias("estimate"))


def _stationary(r: pd.DataFrame, levels: list) -> np.ndarray:
    """Stationary vector of the row-normalised recruitment matrix."""
    at = {v: i for i, v in enumerate(levels)}
    s = np.zeros((len(levels), len(levels)))
    for g, h, n in r[["g", "h", "r"]].itertuples(index=False):
        s[at[g], at[h]] = n
    rows = s.sum(axis=1, keepdims=True)
    # a group that recruited nobody passes on to every group alike
    s = np.divide(s, rows, out=np.full_like(s, 1 / len(levels)), where=rows > 0)
    a = np.vstack([s.T - np.eye(len(levels)), np.ones(len(levels))])
    pi, *_ = np.linalg.lstsq(a, np.append(np.zeros(len(levels)), 1.0), rcond=None)
    return np.clip(pi, 0, None)


def _level_table(df: DataFrame, frame: Frame) -> pd.DataFrame:
    """Size, degrees and RDS-I share of every level (one row per level, checked to be few)."""
    df = usable(df, frame)
    deg = _bounded(group_degrees(df, frame)).sort_values("level").reset_index(drop=True)
    pi = _stationary(_bounded(recruitment_counts(df, frame)), deg["level"].tolist())
    share = pi / deg["harmonic_degree"].to_numpy()
    return deg.assign(share=share / share.sum())


def rds_i(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Share of every level of a categorical outcome (stationary vector over harmonic degree)."""
    table = _level_table(df, frame)
    kind = df.schema[frame.outcome].dataType.simpleString()
    rows = [(v, float(p)) for v, p in zip(table["level"].tolist(), table["share"])]
    return df.sparkSession.createDataFrame(rows, f"level {kind}, estimate double")


def rds_ii(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Inverse-degree weighted mean of a numeric (0/1 or continuous) outcome."""
    known = usable(df, frame)
    w = _inverse(F.col(frame.degree))
    return known.agg(ratio(F.sum(w * F.col(frame.outcome)), F.sum(w)).alias("estimate")).select(
        F.lit("RDS-II").alias("estimator"), "estimate"
    )


def rds_ii_levels(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Inverse-degree weighted share of every level."""
    w = usable(df, frame).groupBy(
        F.col(frame.outcome).alias("level")
    ).agg(F.sum(_inverse(F.col(frame.degree))).alias("w"))
    total = F.sum("w").over(W.partitionBy())  # one row per level
    return w.select("level", (F.col("w") / total).alias("estimate"))


def _solve_rate(degree: np.ndarray, count: np.ndarray, size: float) -> float:
    """Rate ``t`` at which inclusion ``1 - exp(-d t)`` makes the weights add up to ``size``."""
    if size < count.sum():
        raise ValueError("the population cannot be smaller than the sample")
    if not (np.isfinite(degree).all() and (degree > 0).all()):
        raise ValueError("degrees must be known and positive; see usable()")

    def total(log_rate: float) -> float:
        return float((count / -np.expm1(-degree * math.exp(log_rate))).sum())

    lo, hi = math.log(1e-18), math.log(1e3)
    # weights fall from near infinity to the sample size as the rate grows
    while total(lo) < size:
        lo -= 10
    while total(hi) > max(size, count.sum() * (1 + 1e-12)):
        hi += 10
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) > size else (lo, mid)
        if hi - lo < 1e-15 * max(1.0, abs(hi)):
            break
    return math.exp((lo + hi) / 2)


def ss_rate(df: DataFrame, size: float, frame: Frame = Frame()) -> float:
    """Rate ``t`` at which inclusion ``1 - exp(-d t)`` makes the weights add up to ``size``.

    The degree histogram stays in Spark, however many degrees there are; a step is one aggregation of it.
    Beyond the sample itself the weights add up to q(t) = sum n / (exp(d t) - 1), whose logarithm is convex
    and falls: Newton steps on it, from a start known to be too small, rise to the rate without passing it.
    """
    known = df.where(_known_degree(frame))
    d, n = F.col("d"), F.col("n")
    hist = checkpointed(
        known.groupBy(F.col(frame.degree).cast("double").alias("d")).agg(F.count("*").cast("double").alias("n"))
    )
    total, inverse, least = hist.agg(F.sum(n), F.sum(n / d), F.min(d)).first()
    if size < (total or 0):
        raise ValueError("the population cannot be smaller than the sample")
    if not total or size <= total * (1 + 1e-12):
        # everybody is sampled: weights of one to the last bit
        return 50.0 / (least or 1.0)
    rate = inverse / size
    for _ in range(100):
        x = d * F.lit(rate)
        beyond, fall = hist.agg(F.sum(n / F.expm1(x)), F.sum(n * d / (F.expm1(x) * -F.expm1(-x)))).first()
        step = math.log(beyond / (size - total)) * beyond / fall
        rate += step
        if abs(step) <= 1e-14 * rate:
            return rate
    raise RuntimeError("the sampling rate did not settle")


def ss_weight(rate: float, frame: Frame = Frame()) -> Column:
    """Inverse inclusion probability at degree d (null for degree 0)."""
    return ratio(F.lit(1.0), -F.expm1(-F.lit(rate) * F.col(frame.degree)))


def ss_estimate(df: DataFrame, size: float, frame: Frame = Frame()) -> DataFrame:
    """Without-replacement estimate for a population of ``size`` (Gile 2011, mean-field form)."""
    known = usable(df, frame)
    w = ss_weight(ss_rate(known, size, frame), frame)
    return known.agg(ratio(F.sum(w * F.col(frame.outcome)), F.sum(w)).alias("estimate")).select(
        F.lit("SS").alias("estimator"), "estimate"
    )


@dataclass(frozen=True)
class Homophily:
    """Solution of the homophily configuration-graph model."""

    levels: list
    sizes: np.ndarray
    rates: np.ndarray
    mixing: np.ndarray
    settled: bool


def hcg_fit(df: DataFrame, size: float, frame: Frame = Frame(), slices: int = 50) -> Homophily:
    """Group sizes under time-ordered, without-replacement sampling with homophily.

    Within a group, people leave the pool in proportion to degree; a recruiter's choice of group
    follows the mixing matrix, discounted by how much of each group's degree is already used up at
    that time. Spark reduces the data to a (time slice, group, degree) histogram and (time slice,
    group, group) recruitment counts; the fixed point is solved on those.
    """
    hist, moves = _timed_cells(_with_slice(usable(df, frame), frame, slices), frame)
    fit = _hcg_solve(_bounded(hist), _bounded(moves), size, slices)
    if not fit.settled:
        raise RuntimeError("the homophily model did not settle on this sample")
    return fit


def _timed_cells(
    sliced: DataFrame, frame: Frame, by: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Histogram (slice, level, d, n) and recruitments (slice, g, h, r), per ``by``.

    A recruitment falls in the later of its two ends' slices: it exists once both are in the sample.
    """
    by = by or []
    d, y = F.col(frame.degree).alias("d"), F.col(frame.outcome)
    hist = sliced.groupBy(*by, "slice", y.alias("level"), d).agg(F.count("*").alias("n"))
    owners = sliced.select(F.col(frame.id).alias("__o"), y.alias("g"), F.col("slice").alias("__gs"))
    made = (
        sliced.where(F.col(frame.recruiter).isNotNull())
        .groupBy(*by, F.col(frame.recruiter).alias("__o"), y.alias("h"), "slice")
        .agg(F.count("*").alias("__n"))
    )
    moves = (
        made.join(owners, "__o")
        .withColumn("slice", F.greatest("slice", "__gs"))
        .groupBy(*by, "slice", "g", "h")
        .agg(F.sum("__n").alias("r"))
    )
    return hist, moves


def _hcg_solve(
    hist: pd.DataFrame, moves: pd.DataFrame, size: float, slices: int, rounds: int = 500
) -> Homophily:
    levels = sorted(hist["level"].unique().tolist())
    k, at = len(levels), {v: i for i, v in enumerate(levels)}
    r = np.zeros((slices, k, k))
    for g, h, s, n in moves[["g", "h", "slice", "r"]].itertuples(index=False):
        r[int(s) - 1, at[g], at[h]] += n
    taken = np.zeros((slices, k))
    for s, v, n in hist[["slice", "level", "n"]].itertuples(index=False):
        taken[int(s) - 1, at[v]] += n
    by_degree = [hist[hist["level"] == v].groupby("d")["n"].sum().reset_index() for v in levels]
    degree = [b["d"].to_numpy(float) for b in by_degree]
    count = [b["n"].to_numpy(float) for b in by_degree]
    n = np.array([c.sum() for c in count])
    sizes = size * n / n.sum()
    mixing = r.sum(axis=0) + 1e-9
    mixing /= mixing.sum(axis=1, keepdims=True)
    rates, volume, done = np.zeros(k), np.zeros(k), False
    for _ in range(rounds):
        left, heads = np.ones((slices, k)), np.zeros(k)
        for h in range(k):
            rates[h] = _solve_rate(degree[h], count[h], max(sizes[h], n[h]))
            pool = count[h] / -np.expm1(-degree[h] * rates[h])
            heads[h], volume[h] = pool.sum(), (pool * degree[h]).sum()
            drawn = np.concatenate([[0.0], np.cumsum(taken[:, h])[:-1]])
            left[:, h] = _degree_left(pool, degree[h], drawn, rates[h]) / volume[h]
        for _ in range(20):
            offer = np.einsum("sl,gl->sg", left, mixing)
            weight = np.einsum("sg,sh->gh", r.sum(axis=2) / np.maximum(offer, 1e-300), left)
            mixing = (r.sum(axis=0) + 1e-9) / np.maximum(weight, 1e-300)
            mixing /= mixing.sum(axis=1, keepdims=True)
        a = np.vstack([mixing.T - np.eye(k), np.ones(k)])
        flow, *_ = np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)
        target = np.clip(flow, 1e-12, None) / (volume / heads)
        new = _at_least(target, n, size)
        done = np.max(np.abs(new - sizes)) < 1e-8 * size
        sizes = (sizes + new) / 2
        if done:
            break
    return Homophily(levels, sizes, rates, mixing, bool(done))


def _at_least(target: np.ndarray, floor: np.ndarray, total: float) -> np.ndarray:
    """Rescale ``target`` to ``total`` with no group below ``floor``."""
    lo, hi = 0.0, total / target.sum()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.maximum(mid * target, floor).sum() < total else (lo, mid)
    return np.maximum(hi * target, floor)


def _degree_left(pool, degree, drawn, last_rate):
    """Degree still in the pool after each cumulative number of draws."""
    lo, hi = np.zeros(len(drawn)), np.full(len(drawn), max(last_rate, 1e-18))
    for _ in range(60):
        mid = (lo + hi) / 2
        gone = -np.expm1(-np.outer(mid, degree)) @ pool
        lo, hi = np.where(gone < drawn, mid, lo), np.where(gone < drawn, hi, mid)
    return np.exp(-np.outer((lo + hi) / 2, degree)) @ (pool * degree)


def hcg_estimate(df: DataFrame, size: float, frame: Frame = Frame()) -> DataFrame:
    """Share of every outcome level under the homophily configuration-graph model."""
    fit = hcg_fit(df, size, frame)
    kind = df.schema[frame.outcome].dataType.simpleString()
    rows = [(v, float(s / size)) for v, s in zip(fit.levels, fit.sizes)]
    return df.sparkSession.createDataFrame(rows, f"level {kind}, estimate double")


def weights(df: DataFrame, size: float, frame: Frame = Frame()) -> DataFrame:
    """RDS-I, RDS-II and SS weight per respondent, each scaled to mean 1 over the usable ones.

    Respondents without a known outcome or a positive degree keep their row, with null weights.
    """
    known = usable(df, frame)
    levels = _level_table(known, frame)
    rate = ss_rate(known, size, frame)
    # one row of totals
    sums = known.agg(
        F.count("*").alias("n"), F.sum(_inverse(F.col(frame.degree))).alias("inv"),
        F.sum(ss_weight(rate, frame)).alias("ss"),
    ).first()
    kind = df.schema[frame.outcome].dataType.simpleString()
    rows = [
        (v, float(p * sums["n"] / n))
        for v, p, n in zip(levels["level"].tolist(), levels["share"], levels["n"])
    ]
    # one row per level, already checked to be few
    table = F.broadcast(df.sparkSession.createDataFrame(rows, f"__l {kind}, w_rds_i double"))
    out = df.join(table, df[frame.outcome] == table["__l"], "left").drop("__l")
    fits = F.col(frame.outcome).isNotNull() & _known_degree(frame)
    return out.withColumns(
        {
            "w_rds_i": F.when(fits, F.col("w_rds_i")),
            "w_rds_ii": F.when(fits, _inverse(F.col(frame.degree)) * (sums["n"] / sums["inv"])),
            "w_ss": F.when(fits, ss_weight(rate, frame) * (sums["n"] / sums["ss"])),
        }
    )


def hcg_weights(df: DataFrame, size: float, frame: Frame = Frame()) -> DataFrame:
    """Homophily-model weight per respondent, scaled to mean 1."""
    fit = hcg_fit(df, size, frame)
    total = usable(df, frame).agg(F.count("*").alias("n")).first()["n"]
    weight = _hcg_row_weight(fit, frame) * (total / size)
    return df.withColumn("w_hcg", F.when(_known_degree(frame), weight))


def convergence(df: DataFrame, frame: Frame = Frame(), by: list[str] | None = None) -> DataFrame:
    """RDS-II estimate on the first m respondents for every m (per ``by`` when given)."""
    by = by or []
    d = F.col(frame.degree)
    roles = [frame.id, frame.order, frame.degree, frame.outcome]
    ran = running_sums(
        checkpointed(df.select(*dict.fromkeys([*by, *roles]))),
        by,
        [F.col(frame.order), F.col(frame.id)],
        {"m": F.lit(1), "__wy": F.col(frame.outcome) * _inverse(d), "__w": _inverse(d)},
    )
    return ran.select(*by, frame.id, "m", ratio(F.col("__wy"), F.col("__w")).alias("estimate"))


def convergence_rds_i(
    df: DataFrame, frame: Frame = Frame(), by: list[str] | None = None
) -> DataFrame:
    """RDS-I estimate of a 0/1 outcome on the first m respondents for every m (per ``by`` when given).

    A recruitment counts from the later of its two ends on. Everything RDS-I needs is a running sum:
    recruitments between the groups, group sizes and inverse degrees. Null while a group is empty or
    has recruited nobody.
    """
    by = by or []
    i, t = F.col(frame.id), F.col(frame.order)
    roles = [frame.id, frame.recruiter, frame.order, frame.degree, frame.outcome]
    src = checkpointed(usable(df, frame).select(*dict.fromkeys([*by, *roles])))
    owners = src.select(i.alias("__o"), F.struct(t, i).alias("__made"), F.col(frame.outcome).alias("__g"))
    moves = {(g, h): f"__r{g}{h}" for g in (0, 1) for h in (0, 1)}
    ends = (
        src.where(F.col(frame.recruiter).isNotNull())
        .join(owners, F.col(frame.recruiter) == F.col("__o"))
        .select(F.greatest(F.struct(t, i), F.col("__made")).alias("__at"), "__g", F.col(frame.outcome).alias("__h"))
        .groupBy(F.col("__at")[frame.id].alias("__e"))
        .agg(*[F.count_if((F.col("__g") == g) & (F.col("__h") == h)).alias(c) for (g, h), c in moves.items()])
    )
    rows = src.join(ends, i == F.col("__e"), "left").drop("__e").fillna(0, [*moves.values()])
    mine = {g: F.col(frame.outcome) == g for g in (0, 1)}
    sums = {"m": F.lit(1), **{f"s{c}": F.col(c) for c in moves.values()}}
    for g in (0, 1):
        sums[f"__n{g}"] = F.when(mine[g], 1).otherwise(0)
        sums[f"__inv{g}"] = F.when(mine[g], _inverse(F.col(frame.degree))).otherwise(0.0)
    ran = running_sums(checkpointed(rows), by, [t, i], sums)
    col = {c: F.col(f"s__r{c}") for c in ("00", "01", "10", "11")}
    ran = ran.withColumns(
        {
            "s01": ratio(col["01"], col["00"] + col["01"]),
            "s10": ratio(col["10"], col["10"] + col["11"]),
            "d0": ratio(F.col("__n0"), F.col("__inv0")),
            "d1": ratio(F.col("__n1"), F.col("__inv1")),
        }
    )
    return ran.select(*by, frame.id, "m", _rds_i_expr("d0", "d1").alias("estimate"))


def _with_slice(
    df: DataFrame, frame: Frame, points: int, by: list[str] | None = None
) -> DataFrame:
    """Equal parts 1..points of the sample in recruitment order (of each ``by`` group)."""
    by = by or []
    roles = [frame.id, frame.recruiter, frame.degree, frame.outcome, frame.order]
    src = checkpointed(df.select(*dict.fromkeys([*by, *roles])))
    ranked = running_sums(src, by, [F.col(frame.order), F.col(frame.id)], {"__rn": F.lit(1)}, True)
    cut = F.ceil(F.col("__rn") * points / F.col("__rn_total")).cast("int")
    return ranked.withColumn("slice", cut).drop("__rn", "__rn_total")


def convergence_grid(
    df: DataFrame,
    size: float,
    frame: Frame = Frame(),
    points: int = 20,
    by: list[str] | None = None,
    timed: bool = False,
) -> DataFrame:
    """RDS-I and SS (and HCG when ``timed``) on the first 1/points, 2/points, ... of the sample.

    With ``by`` (say the seed) every group is followed on its own. Spark reduces respondents to counts
    per slice; each slice then adds to every later cut point, and the small count table of one cut
    point is what the solvers see.
    """
    by = by or []
    keys = [*by, "cut_point"]
    hist, moves = _timed_cells(_with_slice(usable(df, frame), frame, points, by), frame, by)
    # both count tables feed several steps
    hist, moves = checkpointed(hist), checkpointed(moves)
    later = F.explode(F.sequence(F.col("slice"), F.lit(points))).alias("cut_point")
    deg = hist.select(*by, "slice", "level", "d", "n", later)
    rec = moves.select(*by, "slice", "g", "h", "r", later)
    inv = lambda lvl: F.sum(F.when(F.col("level") == lvl, F.col("n") * _inverse(F.col("d"))))
    num = lambda lvl: F.sum(F.when(F.col("level") == lvl, F.col("n")))
    went = lambda g, h: F.coalesce(
        F.sum(F.when((F.col("g") == g) & (F.col("h") == h), F.col("r"))), F.lit(0))
    groups = deg.groupBy(*keys).agg(
        F.sum("n").alias("m"),
        *[ratio(num(lvl), inv(lvl)).alias(f"harmonic_degree{lvl}") for lvl in (0, 1)],
    )
    flows = rec.groupBy(*keys).agg(*[went(g, h).alias(f"r{g}{h}") for g in (0, 1) for h in (0, 1)])
    first = join_null_safe(groups, flows, keys, "left").withColumns(
        {
            "s01": ratio(F.col("r01"), F.col("r00") + F.col("r01")),
            "s10": ratio(F.col("r10"), F.col("r10") + F.col("r11")),
        }
    ).select(*keys, "m", _rds_i_expr().alias("rds_i"))
    kinds = {f.name: f.dataType.simpleString() for f in deg.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def ss_of(key, part):
        flat = part.groupby(["level", "d"])["n"].sum().reset_index()
        d, n = flat["d"].to_numpy(float), flat["n"].to_numpy(float)
        w = n / -np.expm1(-d * _solve_rate(d, n, size))
        share = float((w * flat["level"].to_numpy(float)).sum() / w.sum())
        return pd.DataFrame([[*key, share]], columns=[*keys, "ss"])

    def hcg_of(key, part, made):
        fit = _hcg_solve(part, made, size, points)
        share = sum(v * s for v, s in zip(fit.levels, fit.sizes)) / size
        # no estimate where the model does not settle
        return pd.DataFrame([[*key, float(share) if fit.settled else None]], columns=[*keys, "hcg"]).astype({"hcg": float})

    # one group is the count table of one cut point: slices x levels x distinct degrees; solving is
    # the cost, so groups are spread over all cores however small the tables are
    cores = df.sparkSession.sparkContext.defaultParallelism
    deg, rec = deg.repartition(cores, *keys), rec.repartition(cores, *keys)
    out = join_null_safe(
        first, deg.groupBy(*keys).applyInPandas(ss_of, f"{schema}, ss double"), keys, "inner"
    )
    if timed:
        both = deg.groupBy(*keys).cogroup(rec.groupBy(*keys))
        out = join_null_safe(
            out, both.applyInPandas(hcg_of, f"{schema}, hcg double"), keys, "inner"
        )
    return out


def _hcg_row_weight(fit: Homophily, frame: Frame) -> Column:
    """Inverse inclusion probability by group and degree."""
    w = F.lit(None).cast("double")
    for v, rate in zip(fit.levels, fit.rates):
        w = F.when(F.col(frame.outcome) == v, ss_weight(float(rate), frame)).otherwise(w)
    return w


def weighted_degrees(
    df: DataFrame, size: float, frame: Frame = Frame(), timed: bool = False
) -> DataFrame:
    """Mean degree per 0/1 group under each weight type, and its ratio (differential activity)."""
    d, y = F.col(frame.degree), F.col(frame.outcome)
    w = ss_weight(ss_rate(df, size, frame), frame)
    types = {"RDS-I": F.lit(1.0), "RDS-II": _inverse(d), "SS": w}
    if timed:
        types["HCG"] = _hcg_row_weight(hcg_fit(df, size, frame), frame)
    aggs = []
    for name, weight in types.items():
        for lvl in (0, 1):
            here = lambda c: F.sum(F.when(y == lvl, c))  # noqa: E731,B023
            aggs.append(ratio(here(weight * d), here(weight)).alias(f"{name}_{lvl}"))
    rows = [
        F.struct(
            F.lit(t).alias("weight_type"),
            F.col(f"`{t}_0`").alias("degree_0"),
            F.col(f"`{t}_1`").alias("degree_1"),
            ratio(F.col(f"`{t}_1`"), F.col(f"`{t}_0`")).alias("differential_activity"),
        )
        for t in types
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def recruitment_homophily(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Same-group recruitments over their number expected from the margins."""
    counts = recruitment_counts(df, frame)
    side = F.array(
        F.struct(F.col("g").alias("level"), F.col("r").alias("out"), F.lit(0).cast("long").alias("inn"),
                 F.when(F.col("g") == F.col("h"), F.col("r")).otherwise(0).alias("same")),
        F.struct(F.col("h").alias("level"), F.lit(0).cast("long").alias("out"), F.col("r").alias("inn"),
                 F.lit(0).cast("long").alias("same")),
    )
    margins = counts.select(F.inline(side)).groupBy("level").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("out", "inn", "same")]
    )
    return margins.agg(
        ratio(F.sum("same"), ratio(F.sum(F.col("out") * F.col("inn")), F.sum("out"))).alias("homophily")
    )


def population_homophily(
    df: DataFrame, size: float, frame: Frame = Frame(), timed: bool = False
) -> DataFrame:
    """Discordant ties expected without homophily over those expected with the observed mixing."""
    row = _two_group_row(recruitment_counts(df, frame), group_degrees(df, frame))
    two = df.agg(
        ratio(F.sum(F.col(frame.outcome) * _inverse(F.col(frame.degree))), F.sum(_inverse(F.col(frame.degree)))).alias("p_ii")
    )
    w = ss_weight(ss_rate(df, size, frame), frame)
    d, y = F.col(frame.degree), F.col(frame.outcome)
    ss = df.agg(
        ratio(F.sum(w * y), F.sum(w)).alias("p_ss"),
        *[ratio(F.sum(F.when(y == v, w * d)), F.sum(F.when(y == v, w))).alias(f"d_ss{v}") for v in (0, 1)],
    )
    parts = [row, two, ss]
    types = [
        ("RDS-I", "p_i", "mean_degree1", "mean_degree0"),
        ("RDS-II", "p_ii", "harmonic_degree1", "harmonic_degree0"),
        ("SS", "p_ss", "d_ss1", "d_ss0"),
    ]
    if timed:
        v = _hcg_row_weight(hcg_fit(df, size, frame), frame)
        hcg = df.agg(
            ratio(F.sum(v * y), F.sum(v)).alias("p_hcg"),
            *[ratio(F.sum(F.when(y == g, v * d)), F.sum(F.when(y == g, v))).alias(f"d_hcg{g}")
              for g in (0, 1)],
        )
        parts.append(hcg)
        types.append(("HCG", "p_hcg", "d_hcg1", "d_hcg0"))
    wide = side_by_side(*parts).withColumn("p_i", _rds_i_expr())
    rows = []
    for name, p, d1, d0 in types:
        a, b = F.col(p) * F.col(d1), (1 - F.col(p)) * F.col(d0)
        mixed = (a * F.col("s10") + b * F.col("s01")) / 2
        rows.append(
            F.struct(F.lit(name).alias("weight_type"), ratio(ratio(a * b, a + b), mixed).alias("homophily"))
        )
    return wide.select(F.inline(F.array(*rows)))


def sampling_fraction(df: DataFrame, size: float) -> DataFrame:
    return df.agg(F.count("*").alias("n"), (F.count("*") / F.lit(float(size))).alias("fraction"))


def seed_dependence(df: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Share of each level among seeds next to its inverse-degree weighted share."""
    seed = F.col(frame.recruiter).isNull()
    by = df.groupBy(F.col(frame.outcome).alias("level")).agg(
        F.count_if(seed).alias("n_seed"), F.sum(_inverse(F.col(frame.degree))).alias("w")
    )
    seeds, total = F.sum("n_seed").over(W.partitionBy()), F.sum("w").over(W.partitionBy())  # one row per level
    out = by.select(
        "level", ratio(F.col("n_seed"), seeds).alias("seed_share"), ratio(F.col("w"), total).alias("share")
    )
    return out.withColumn("difference", F.col("seed_share") - F.col("share"))


def compare(
    df: DataFrame, size: float, frame: Frame = Frame(), timed: bool = False
) -> DataFrame:
    """RDS-I, RDS-II and SS estimates of a 0/1 outcome side by side; HCG too when ``timed``."""
    parts = [rds_i_binary(df, frame), rds_ii(df, frame), ss_estimate(df, size, frame)]
    if timed:
        hcg = hcg_estimate(df, size, frame).where("level = 1")
        parts.append(hcg.select(F.lit("HCG").alias("estimator"), "estimate"))
    return reduce(DataFrame.unionByName, parts)


# How each estimator copes with a condition of the study.
SUITABILITY = {
    "population size unknown": ("ok", "ok", "no", "no"),
    "large sampling fraction": ("biased", "biased", "ok", "ok"),
    "short waves": ("biased", "biased", "ok", "ok"),
    "recruitment time unknown": ("ok", "ok", "ok", "no"),
    "high homophily": ("slightly biased", "biased", "biased", "ok"),
    "seed dependence": ("slightly biased", "biased", "slightly biased", "ok"),
    "high differential activity": ("no", "no", "ok", "ok"),
    "continuous outcome": ("no", "ok", "ok", "ok"),
}
ESTIMATORS = ("RDS-I", "RDS-II", "SS", "HCG")


@dataclass(frozen=True)
class Limits:
    """Where a diagnostic starts to count as a problem."""

    fraction: float = 0.5
    waves: int = 4
    homophily: float = 1.5
    seeds: float = 0.1
    activity: float = 1.5


def suitability(
    df: DataFrame,
    size: float | None,
    frame: Frame = Frame(),
    continuous: bool = False,
    limits: Limits = Limits(),
) -> DataFrame:
    """Which study conditions hold, and what each means for every estimator."""
    waves = with_waves(df, frame).agg(F.max("wave").alias("wave"), F.count("*").alias("n"))
    homo = recruitment_homophily(df, frame)
    seeds = seed_dependence(df, frame).agg(F.max(F.abs("difference")).alias("seeds"))
    activity = df.agg(
        ratio(
            F.avg(F.when(F.col(frame.outcome) == 1, F.col(frame.degree))),
            F.avg(F.when(F.col(frame.outcome) == 0, F.col(frame.degree))),
        ).alias("activity")
    )
    wide = side_by_side(waves, homo, seeds, activity)
    act = F.col("activity")
    present = {
        "population size unknown": F.lit(size is None),
        "large sampling fraction": F.col("n") > limits.fraction * (size or float("inf")),
        "short waves": F.col("wave") < limits.waves,
        "recruitment time unknown": F.lit(frame.order is None),
        "high homophily": F.col("homophily") > limits.homophily,
        "seed dependence": F.col("seeds") > limits.seeds,
        "high differential activity": (act > limits.activity) | (act < 1 / limits.activity),
        "continuous outcome": F.lit(continuous),
    }
    rows = []
    for name, verdicts in SUITABILITY.items():
        for est, verdict in zip(ESTIMATORS, verdicts):
            there = F.coalesce(present[name], F.lit(False))
            rows.append(
                F.struct(
                    F.lit(name).alias("condition"),
                    F.lit(est).alias("estimator"),
                    there.alias("present"),
                    F.when(there, F.lit(verdict)).otherwise("ok").alias("verdict"),
                )
            )
    return wide.select(F.inline(F.array(*rows)))


def _uniform(seed: int, replicate: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Draws in [0, 1) that depend on (seed, replicate, step) alone."""
    with np.errstate(over="ignore"):
        x = np.full(len(step), seed, np.uint64)
        for part in (replicate, step):
            x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ part.astype(np.uint64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


@dataclass(frozen=True)
class Replicates:
    """Redrawn samples: per replicate the moves between levels (row by row), inverse degrees and shares."""

    levels: list
    rows: DataFrame
    n: int


def _replicates(
    df: DataFrame, frame: Frame, replicates: int, seed: int, size: float | None, chain: int
) -> Replicates:
    """Chains redrawn in parallel, for any number of levels of the outcome (few, checked).

    A piece of ``chain`` draws is a map: from every level it may start in to the level it ends in and the
    moves it makes on the way. Pieces are drawn side by side and a replicate's maps are then followed one
    after the other. The draw of a step is a hash of (seed, replicate, step), so neither piece length nor
    partitioning changes a result.
    """
    cells = _bounded(recruitment_counts(df, frame, [frame.degree])).rename(
        columns={frame.degree: "d"}
    ).sort_values(["g", "h", "d"])
    pool = _bounded(df.groupBy(F.col(frame.outcome).alias("h")).agg(F.count("*").alias("n"))).sort_values("h")
    levels = pool["h"].tolist()
    k, at = len(levels), {v: i for i, v in enumerate(levels)}
    start = pool["n"].to_numpy(float)
    n = int(start.sum())
    start = start / max(n, 1)
    counts, draws = np.zeros((k, k)), {}
    for (g, h), part in cells.groupby(["g", "h"]):
        counts[at[g], at[h]] = part["r"].sum()
        draws[at[g], at[h]] = (part["d"].to_numpy(float), part["r"].to_numpy(float) / part["r"].sum())
    rows = counts.sum(axis=1, keepdims=True)
    # a level that recruited nobody is followed by the sample's mix
    share = np.where(rows > 0, counts / np.maximum(rows, 1), start)
    # shares add up from the last level down
    below = np.cumsum(share[:, ::-1], axis=1)[:, :-1]
    first = np.cumsum(start[::-1])[:-1]
    pieces = max(1, math.ceil(n / chain))

    def picked(u, bounds):
        return k - 1 - (u[..., None] >= bounds).sum(axis=-1)

    def simulate(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            for lo in range(0, len(ids), 256):
                unit = ids[lo : lo + 256]
                rep, piece = unit // pieces, unit % pieces
                length = np.where(piece == pieces - 1, n - chain * (pieces - 1), chain)
                # all levels the piece may start in
                state = np.tile(np.arange(k), (len(unit), 1))
                moved = np.zeros((len(unit), k, k * k), np.int64)
                here = np.arange(len(unit))
                for step in range(1, int(length.max()) + 1):
                    live = step <= length
                    u = _uniform(seed, rep, piece * chain + step)
                    nxt = picked(np.broadcast_to(u[:, None], state.shape), below[state])
                    for j in range(k):
                        moved[here, j, k * state[:, j] + nxt[:, j]] += live
                    state = np.where(live[:, None], nxt, state)
                begin = picked(_uniform(seed, rep, np.zeros_like(rep)), first)
                yield pd.DataFrame(
                    {"rep": rep, "piece": piece, "begin": begin, "ends": list(state), "moved": list(moved.reshape(len(unit), -1))}
                )

    def compose(part):
        """Follow the pieces of one replicate, each from the level the one before ended in."""
        part = part.sort_values("piece")
        level, total = int(part["begin"].iloc[0]), np.zeros(k * k, np.int64)
        for ends, moved in zip(part["ends"], part["moved"], strict=True):
            total += np.asarray(moved)[level * k * k : (level + 1) * k * k]
            level = int(ends[level])
        return pd.DataFrame({"rep": [part["rep"].iloc[0]], "moved": [total]})

    def attach_degrees(batches):
        for batch in batches:
            out = []
            for rep, moved in zip(batch["rep"], batch["moved"], strict=True):
                level, degree, times = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)]
                for cell, m in enumerate(np.asarray(moved).tolist()):
                    g, h = divmod(cell, k)
                    if m and (g, h) in draws:
                        gen = np.random.default_rng([seed, int(rep), 1_000_000_007, cell])
                        d, q = draws[g, h]
                        level.append(np.full(len(d), h))
                        degree.append(d)
                        times.append(gen.multinomial(m, q).astype(float))
                h, d, c = np.concatenate(level), np.concatenate(degree), np.concatenate(times)
                inverse = np.bincount(h, c / d, k)
                ss = None
                if size and len(h):
                    w = c / -np.expm1(-d * _solve_rate(d, c, max(size, c.sum())))
                    ss = np.bincount(h, w, k) / w.sum()
                table = np.asarray(moved, float).reshape(k, k)
                drawn = table.sum(axis=0)
                mean = np.divide(drawn, inverse, out=np.ones(k), where=inverse > 0)
                made = pd.DataFrame(
                    [(i, j, table[i, j]) for i in range(k) for j in range(k)], columns=["g", "h", "r"]
                )
                pi = np.where(drawn > 0, _stationary(made, list(range(k))) / mean, 0.0)
                out.append((rep, moved, inverse, ss, pi / pi.sum() if pi.sum() else None))
            yield pd.DataFrame(out, columns=["rep", "moved", "inverse", "ss", "rds_i"])

    spark = df.sparkSession
    simulated = spark.range(replicates * pieces if n else 0).mapInPandas(
        simulate, "rep long, piece long, begin int, ends array<int>, moved array<long>"
    )
    # one row per piece of ``chain`` draws
    summed = simulated.groupBy("rep").applyInPandas(compose, "rep long, moved array<long>")
    # a few rows, but real work per row: spread them whatever their size
    spread = summed.repartition(spark.sparkContext.defaultParallelism, "rep").mapInPandas(
        attach_degrees,
        "rep long, moved array<long>, inverse array<double>, ss array<double>, rds_i array<double>",
    )
    return Replicates(levels, spread, n)


def _limits(points: DataFrame, spread: DataFrame, keys: list[str], n: int, size: float | None, conf: float) -> DataFrame:
    """Estimates with standard error and limits; RDS-I and RDS-II carry the finite-population factor."""
    z = M.z_value(conf)
    shrink = math.sqrt(1 - n / size) if size else 1.0
    se = F.col("se") * F.when(F.col("estimator") == "SS", 1.0).otherwise(shrink)
    return points.join(spread, keys).select(
        *keys,
        "estimate",
        se.alias("se"),
        (F.col("estimate") - z * se).alias("low"),
        (F.col("estimate") + z * se).alias("high"),
    )


def bootstrap(
    df: DataFrame,
    frame: Frame = Frame(),
    replicates: int = 500,
    seed: int = 1,
    size: float | None = None,
    conf: float = 0.95,
    chain: int = 5000,
) -> DataFrame:
    """Chain bootstrap intervals for RDS-I and RDS-II (Salganik 2006), replicates in parallel.

    With a population ``size`` the SS estimate is replicated too, and RDS-I and RDS-II intervals carry
    the finite-population factor.

    A replicate redraws the whole sample as one chain: the next respondent's group follows the recruits
    of the current group, and the degree is drawn among those recruits. Only recruitment cells
    (recruiter group, group, degree) are shipped to the tasks. The outcome must be 0 or 1;
    ``bootstrap_levels`` takes any.
    """
    df = usable(df, frame)
    made = _replicates(df, frame, replicates, seed, size, chain)
    if not set(made.levels) <= {0, 1}:
        raise ValueError("the chain bootstrap needs an outcome of 0 and 1")
    if len(made.levels) == 1:
        raise ValueError("the chain bootstrap needs both groups in the sample")
    moves = {f"r{g}{h}": F.col("moved")[2 * g + h] for g in (0, 1) for h in (0, 1)}
    reps = made.rows.select(
        *[c.alias(name) for name, c in moves.items()],
        F.col("inverse")[0].alias("inv0"),
        F.col("inverse")[1].alias("inv1"),
        F.col("ss")[1].alias("ss"),
    )
    reps = reps.withColumns(
        {
            "s01": ratio(F.col("r01"), F.col("r00") + F.col("r01")),
            "s10": ratio(F.col("r10"), F.col("r10") + F.col("r11")),
            "d0": ratio(F.col("r00") + F.col("r10"), F.col("inv0")),
            "d1": ratio(F.col("r01") + F.col("r11"), F.col("inv1")),
        }
    )
    two = ratio(F.col("inv1"), F.col("inv0") + F.col("inv1"))
    names = ["RDS-I", "RDS-II", *(["SS"] if size else [])]
    spread = reps.select(
        _rds_i_expr("d0", "d1").alias("RDS-I"), two.alias("RDS-II"), F.col("ss").alias("SS")
    ).agg(*[F.stddev(c).alias(c) for c in names]).unpivot([], names, "estimator", "se")
    points = rds_i_binary(df, frame).unionByName(rds_ii(df, frame))
    if size:
        points = points.unionByName(ss_estimate(df, size, frame))
    return _limits(points, spread, ["estimator"], made.n, size, conf)


def bootstrap_levels(
    df: DataFrame,
    frame: Frame = Frame(),
    replicates: int = 500,
    seed: int = 1,
    size: float | None = None,
    conf: float = 0.95,
    chain: int = 5000,
) -> DataFrame:
    """The same intervals for every level of a categorical outcome: estimator, level, estimate, se, low, high.

    A level that a replicate does not draw has a share of zero in it.
    """
    df = usable(df, frame)
    made = _replicates(df, frame, replicates, seed, size, chain)
    kind = df.schema[frame.outcome].dataType.simpleString()
    inverse = F.aggregate("inverse", F.lit(0.0), lambda a, b: a + b)
    shares = {"RDS-I": F.col("rds_i"), "RDS-II": F.transform("inverse", lambda x: x / inverse)}
    points = [rds_i(df, frame).withColumn("estimator", F.lit("RDS-I")),
              rds_ii_levels(df, frame).withColumn("estimator", F.lit("RDS-II"))]
    if size:
        shares["SS"] = F.col("ss")
        w = ss_weight(ss_rate(df, size, frame), frame)
        sums = df.groupBy(F.col(frame.outcome).alias("level")).agg(F.sum(w).alias("w"))
        # one row per level
        points.append(sums.select("level", (F.col("w") / F.sum("w").over(W.partitionBy())).alias("estimate"),
                                  F.lit("SS").alias("estimator")))
    long = reduce(DataFrame.unionByName, [
        made.rows.select(F.lit(name).alias("estimator"), F.posexplode(c).alias("at", "share")) for name, c in shares.items()
    ])
    names = df.sparkSession.createDataFrame(list(enumerate(made.levels)), f"at int, level {kind}")
    spread = long.groupBy("estimator", "at").agg(F.stddev("share").alias("se")).join(names, "at").drop("at")
    both = reduce(DataFrame.unionByName, [x.select("estimator", "level", "estimate") for x in points])
    return _limits(both, spread, ["estimator", "level"], made.n, size, conf)
