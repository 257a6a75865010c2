"""Blending, calibrating and scaling prediction streams.

A stream table is long: (stream, date_id, time_id, symbol_id, y, w, pred).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.scalars import vol_scale
from tidewheel.names import DATE, KEYS, SYMBOL
from tidewheel.operators.correlation import stream_correlation
from tidewheel.operators.moments import gram, gram_matrix
from tidewheel.operators.scores import r2, r2_expr, weighted_mean
from tidewheel.sources.panel import ranked_dates

# ---- fixed values --------------------------------------------------------
LOOKBACK_DATES = 20
MIN_HISTORY_ROWS = 500
RIDGE = 3.0
ALPHA_RANGE = (0.0, 1.5)
GAMMAS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.4)
# --------------------------------------------------------------------------


def align(streams: DataFrame, names: list[str]) -> DataFrame:
    """One row per key with a column per stream, beside y and w."""
    return streams.groupBy(*KEYS).agg(
        F.max("y").alias("y"), F.max("w").alias("w"),
        *[F.max(F.when(F.col("stream") == n, F.col("pred"))).alias(n) for n in names])


def blend(streams: DataFrame, names: Iterable[str], label: str) -> DataFrame:
    """Equal-weight mean of the named streams as one new stream."""
    return (streams.where(F.col("stream").isin(list(names))).groupBy(*KEYS)
            .agg(F.max("y").alias("y"), F.max("w").alias("w"), F.avg("pred").alias("pred"))
            .select(F.lit(label).alias("stream"), *KEYS, "y", "w", "pred"))


def nested_blend(streams: DataFrame, bags: dict[str, list[str]], label: str) -> DataFrame:
    """Members of a bag share one vote: mean inside the bags, then over them."""
    bag_of = F.col("stream")
    for bag, members in bags.items():
        bag_of = F.when(F.col("stream").isin(members), F.lit(bag)).otherwise(bag_of)
    votes = streams.groupBy(bag_of.alias("_bag"), *KEYS).agg(
        F.max("y").alias("y"), F.max("w").alias("w"), F.avg("pred").alias("pred"))
    return (votes.groupBy(*KEYS).agg(F.max("y").alias("y"), F.max("w").alias("w"), F.avg("pred").alias("pred"))
            .select(F.lit(label).alias("stream"), *KEYS, "y", "w", "pred"))


def weighted_blend(streams: DataFrame, weights: dict[str, float], label: str) -> DataFrame:
    """Weighted mean over the streams present at a row, weights renormalised."""
    share = F.lit(None).cast("double")
    for n, v in weights.items():
        share = F.when(F.col("stream") == n, F.lit(float(v))).otherwise(share)
    rows = streams.withColumn("_v", share).where(F.col("_v").isNotNull() & F.col("pred").isNotNull())
    return (rows.groupBy(*KEYS).agg(
        F.max("y").alias("y"), F.max("w").alias("w"),
        (F.sum(F.col("_v") * F.col("pred")) / F.greatest(F.sum("_v"), F.lit(1e-12))).alias("pred"))
        .select(F.lit(label).alias("stream"), *KEYS, "y", "w", "pred"))


def blends(streams: DataFrame, combos: dict[str, list[str]]) -> DataFrame:
    """Several equal-weight blends as streams, from one alignment of the rows."""
    names = sorted({m for ms in combos.values() for m in ms})
    wide = align(streams.where(F.col("stream").isin(names)), names)
    made = [F.struct(F.lit(label).alias("stream"), F.try_divide(
        sum((F.coalesce(m, F.lit(0.0)) for m in ms), F.lit(0.0)),
        sum((F.col(m).isNotNull().cast("double") for m in ms), F.lit(0.0))).alias("pred")) for label, ms in combos.items()]
    return (wide.select(*KEYS, "y", "w", F.explode(F.array(*made)).alias("_b")).select("_b.stream", *KEYS, "y", "w", "_b.pred")
            .where(F.col("pred").isNotNull()))


# -- trailing per-symbol calibration ---------------------------------------

def trailing_history(streams: DataFrame, lookback: int = LOOKBACK_DATES) -> DataFrame:
    """Per (stream, symbol, date): rows, sum w p y, sum w p^2 and sum w y^2 over the
    ``lookback`` present dates before it.

    The panel is reduced to one row per symbol and date before the window.
    """
    daily = streams.groupBy("stream", SYMBOL, DATE).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("pred") * F.col("y")).alias("py"),
        F.sum(F.col("w") * F.col("pred") * F.col("pred")).alias("pp"),
        F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"))
    daily = daily.join(ranked_dates(streams).select(DATE, "date_rank"), DATE)
    w = Window.partitionBy("stream", SYMBOL).orderBy("date_rank").rangeBetween(-lookback, -1)
    return daily.select("stream", SYMBOL, DATE, *[
        F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"hist_{c}") for c in ("n", "py", "pp", "yy")])


def shrunk_alpha(num: Column, den: Column, ridge: float = RIDGE) -> Column:
    """Shrinkage toward 1 whose strength is proportional to ``den``.

    The proportional ridge cancels: alpha = (a + ridge) / (1 + ridge), clipped,
    with a = num/(den+1e-12).  Without energy the stream is left as it is.
    """
    a = num / (den + F.lit(1e-12))
    shrunk = (a * den + ridge * den) / (den + ridge * den)
    return F.when(den > 0, F.least(F.greatest(shrunk, F.lit(ALPHA_RANGE[0])), F.lit(ALPHA_RANGE[1]))).otherwise(1.0)


def calibrate(streams: DataFrame, lookback: int = LOOKBACK_DATES, min_rows: int = MIN_HISTORY_ROWS,
              ridge: float = RIDGE) -> DataFrame:
    """Each symbol's predictions times its trailing alpha (1 with little history)."""
    h = trailing_history(streams, lookback)
    alpha = F.when(F.col("hist_n") >= min_rows, shrunk_alpha(F.col("hist_py"), F.col("hist_pp"), ridge)).otherwise(1.0)
    return (streams.join(h.select("stream", SYMBOL, DATE, alpha.alias("alpha")), ["stream", SYMBOL, DATE])
            .withColumn("pred", F.col("pred") * F.col("alpha")))


def damped(streams: DataFrame, lookback: int = LOOKBACK_DATES, min_rows: int = MIN_HISTORY_ROWS,
           factor: float = 0.3) -> DataFrame:
    """Hard gate: predictions of symbols with negative trailing R2 times factor."""
    h = trailing_history(streams, lookback)
    # R2 < 0  <=>  sum w (p-y)^2 > sum w y^2  <=>  pp > 2 py
    gate = F.when((F.col("hist_n") >= min_rows) & (F.col("hist_pp") > 2 * F.col("hist_py")), F.lit(factor)).otherwise(1.0)
    return (streams.join(h.select("stream", SYMBOL, DATE, gate.alias("gate")), ["stream", SYMBOL, DATE])
            .withColumn("pred", F.col("pred") * F.col("gate")))


# -- volatility scaling ----------------------------------------------------

def gamma_scores(rows: DataFrame, split_date: int, gammas: Iterable[float] = GAMMAS, vol: str = "vol",
                 by: Iterable[str] = ()) -> DataFrame:
    """(by, gamma, r2_h1, r2_h2, r2_full) of pred * (vol / mean vol)^gamma.

    The mean volatility is the weighted mean over half 1.  All gammas are
    scored in one pass as separate sums; rows are not multiplied.
    """
    gammas, by = list(gammas), list(by)
    h1 = F.col(DATE) <= split_date
    mean_vol = rows.where(h1).agg(weighted_mean(vol, "w")).first()[0]
    scaled = rows.withColumns({f"_g{i}": vol_scale("pred", vol, mean_vol, g) for i, g in enumerate(gammas)})
    scaled = scaled.withColumns({"_w_h1": F.when(h1, F.col("w")), "_w_h2": F.when(~h1, F.col("w")), "_w_full": F.col("w")})
    parts = ("h1", "h2", "full")
    wide = scaled.groupBy(*by).agg(*[r2_expr(pred=f"_g{i}", w=f"_w_{p}").alias(f"_{p}{i}")
                                     for i in range(len(gammas)) for p in parts])
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(float(g)).alias("gamma"), *[F.col(f"_{p}{i}").alias(f"r2_{p}") for p in parts])
        for i, g in enumerate(gammas)])).alias("_r")).select(*by, "_r.*")


def best_gamma(scores: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """The row with the best half-1 score; the smallest gamma wins a tie."""
    by = list(by)
    return scores.groupBy(*by).agg(F.max_by(F.struct("gamma", "r2_h1", "r2_h2", "r2_full"),
                               F.struct("r2_h1", -F.col("gamma"))).alias("_b")).select(*by, "_b.*")


# -- simplex weights -------------------------------------------------------

def simplex_optimum(q: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """The a >= 0 with sum 1 that minimises a'qa / 2 - b'a, by an active set.

    On the free weights the equality-constrained system is solved exactly; a
    weight that would turn negative leaves at the point where it reaches 0, and
    one whose reduced gradient is negative enters.  Ends when the optimality
    conditions hold.
    """
    m = len(b)
    scale = max(1.0, float(np.abs(q).max(initial=0)), float(np.abs(b).max(initial=0)))
    best = int(np.argmin(np.diag(q) / 2 - b))
    a, free = np.zeros(m), [best]
    a[best] = 1.0
    while True:
        k = len(free)
        system = np.zeros((k + 1, k + 1))
        system[:k, :k], system[:k, k], system[k, :k] = q[np.ix_(free, free)], 1.0, 1.0
        target = np.linalg.lstsq(system, np.append(b[free], 1.0), rcond=None)[0][:k]
        move = target - a[free]
        falls = move < 0
        ratio = np.where(falls & (target < 0), a[free] / np.where(falls, -move, 1.0), np.inf)
        if ratio.min() < 1.0:
            out = int(np.argmin(ratio))
            a[free] = np.maximum(a[free] + ratio[out] * move, 0.0)
            a[free.pop(out)] = 0.0
            continue
        a[free] = np.maximum(target, 0.0)
        gradient = q @ a - b
        reduced = gradient - gradient[free].mean()
        reduced[free] = 0.0
        enter = int(np.argmin(reduced))
        if reduced[enter] >= -tol * scale:
            return a / a.sum()
        free.append(enter)


def simplex_weights(streams_wide: DataFrame, names: list[str], first_half: Column) -> np.ndarray:
    """Non-negative weights summing to 1 with the least weighted squared error on the first half.

    Rows enter only through the m x m weighted Gram table; without rows all weights are equal.
    """
    m = len(names)
    g = gram_matrix(gram(streams_wide.where(first_half & F.col("y").isNotNull()), [*names, "y"], "w"), m + 1)
    if not g[:m, :m].any():
        return np.full(m, 1.0 / m)
    return simplex_optimum(g[:m, :m], g[:m, m])


def simplex_report(streams_wide: DataFrame, names: list[str], first_half: Column) -> DataFrame:
    """Simple mean and simplex blend, scored on both halves and in full."""
    weights = simplex_weights(streams_wide, names, first_half)
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    mixed = sum((F.col(n) * F.lit(float(v)) for n, v in zip(names, weights)), F.lit(0.0))
    rows = streams_wide.select("*", mean.alias("_mean"), mixed.alias("_mix"), first_half.alias("_h"))
    parts = F.array(*[F.struct(F.lit(b).alias("blend"), F.col(c).alias("pred"))
                      for b, c in (("mean", "_mean"), ("simplex", "_mix"))])
    rows = rows.select("y", "w", "_h", F.explode(parts).alias("_p")).select("y", "w", "_h", "_p.*")
    halves = F.explode(F.array(F.lit("full"), F.when(F.col("_h"), F.lit("half1")).otherwise("half2")))
    return rows.withColumn("part", halves).groupBy("blend", "part").agg(r2_expr().alias("r2"))


# -- stacker features ------------------------------------------------------

def stack_features(streams_wide: DataFrame, names: list[str], base: str | None = None) -> tuple[DataFrame, list[str]]:
    """Direct: the predictions.  With a base: also their deviation from it."""
    if base is None:
        return streams_wide, list(names)
    others = [n for n in names if n != base]
    out = streams_wide.withColumns({f"{n}_minus_base": F.col(n) - F.col(base) for n in others})
    return out, [base, *[c for n in others for c in (n, f"{n}_minus_base")]]


# -- admission -------------------------------------------------------------

def admission(streams: DataFrame, candidate: str, incumbents: list[str], max_corr: float = 0.9) -> DataFrame:
    """Solo score >= 0, close to no incumbent, and the blend gains by it."""
    wide = align(streams, [candidate, *incumbents])
    mean_without = sum((F.col(n) for n in incumbents), F.lit(0.0)) / len(incumbents)
    mean_with = (sum((F.col(n) for n in incumbents), F.lit(0.0)) + F.col(candidate)) / (len(incumbents) + 1)
    rows = wide.where(F.col("y").isNotNull() & F.col(candidate).isNotNull() & mean_without.isNotNull()).select(
        "y", "w", F.col(candidate).alias("pred"), mean_with.alias("_with"), mean_without.alias("_without"), *incumbents)
    out = rows.agg(r2_expr(pred="pred").alias("solo"), r2_expr(pred="_with").alias("blend_with"),
                   r2_expr(pred="_without").alias("blend_without"),
                   F.greatest(*[F.corr("pred", n) for n in incumbents], F.lit(-1.0)).alias("max_corr"))
    return out.withColumn("admit", (F.col("solo") >= 0) & (F.col("max_corr") < max_corr)
                          & (F.col("blend_with") > F.col("blend_without")))


def singles(streams: DataFrame) -> DataFrame:
    return r2(streams, ["stream"])


def pairwise(streams: DataFrame, names: list[str]) -> DataFrame:
    return stream_correlation(align(streams, names), names)
