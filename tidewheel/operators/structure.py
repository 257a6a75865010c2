"""How a column's variance is arranged: across symbols, over the day, overnight."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scalars import unpivot_stats, zero_fill
from tidewheel.names import DATE, STEP, SYMBOL, TIME
from tidewheel.operators.chunks import CHUNK_ROWS, Along, Stage, over_symbol
from tidewheel.operators.lags import overnight_pairs


def market_share(df: DataFrame, cols: Iterable[str], min_symbols: int = 3) -> DataFrame:
    """Share of variance explained by the per-step market mean.

    Input: complete series; missing = 0; dates with fewer symbols are left out.
    Steps are pre-aggregated, then dates, so nothing is joined back.
    """
    cols = list(cols)
    step = df.groupBy(*STEP).agg(F.count(F.lit(1)).alias("_n"), *[
        f(x).alias(f"_{p}_{c}") for c in cols for x in [zero_fill(c)]
        for p, f in (("s", F.sum), ("q", lambda v: F.sum(v * v)))])
    day = (step.groupBy(DATE).agg(
        F.sum("_n").alias("_rows"), F.max("_n").alias("_sym"),
        *[e.alias(f"_{p}_{c}") for c in cols for p, e in (
            ("s", F.sum(f"_s_{c}")), ("q", F.sum(f"_q_{c}")),
            ("b", F.sum(F.col(f"_s_{c}") * F.col(f"_s_{c}") / F.col("_n"))))])
        .where(F.col("_sym") >= min_symbols))
    # sum over steps of n (mean_t - mean)^2  =  sum s_t^2/n_t - s^2/rows
    wide = day.agg(*[e.alias(f"_{p}_{c}") for c in cols for p, e in (
        ("num", F.sum(F.col(f"_b_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}") / F.col("_rows"))),
        ("den", F.sum(F.col(f"_q_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}") / F.col("_rows"))))])
    return unpivot_stats(wide, {c: {"market_share": F.when(
        F.col(f"_den_{c}") > 0, F.try_divide(F.col(f"_num_{c}"), F.col(f"_den_{c}")))} for c in cols})


def intraday_share(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Share of variance due to the time-of-day profile (missing = 0)."""
    cols = list(cols)
    by_time = df.groupBy(TIME).agg(F.count(F.lit(1)).alias("_n"), *[
        f(x).alias(f"_{p}_{c}") for c in cols for x in [zero_fill(c)]
        for p, f in (("m", F.avg), ("s", F.sum), ("q", lambda v: F.sum(v * v)))])
    wide = by_time.agg(F.sum("_n").alias("_rows"), *[e.alias(f"_{p}_{c}") for c in cols for p, e in (
        ("p", F.var_pop(f"_m_{c}")), ("s", F.sum(f"_s_{c}")), ("q", F.sum(f"_q_{c}")))])
    out = {}
    for c in cols:
        mean = F.col(f"_s_{c}") / F.col("_rows")
        total = F.col(f"_q_{c}") / F.col("_rows") - mean * mean
        out[c] = {"intraday_share": F.when(total > 1e-12, F.try_divide(F.col(f"_p_{c}"), total))}
    return unpivot_stats(wide, out)


def overnight_continuity(df: DataFrame, cols: Iterable[str], min_pairs: int = 30) -> DataFrame:
    """corr(last value of d, first value of d+1), NULL with too few pairs."""
    cols = list(cols)
    pairs = overnight_pairs(df, cols)
    aggs = []
    for c in cols:
        a = F.when(F.col(f"{c}_first").isNotNull(), F.col(f"{c}_last"))
        b = F.when(F.col(f"{c}_last").isNotNull(), F.col(f"{c}_first"))
        aggs += [F.count(a + b).alias(f"_n_{c}"), F.corr(a, b).alias(f"_r_{c}"),
                 F.stddev_pop(a).alias(f"_a_{c}"), F.stddev_pop(b).alias(f"_b_{c}")]
    wide = pairs.agg(*aggs)
    return unpivot_stats(wide, {c: {
        "n_pairs": F.col(f"_n_{c}"),
        "continuity": F.when((F.col(f"_n_{c}") >= min_pairs) & (F.col(f"_a_{c}") >= 1e-9)
                             & (F.col(f"_b_{c}") >= 1e-9), F.col(f"_r_{c}"))} for c in cols})


def increment_stats(df: DataFrame, cols: Iterable[str], chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Variance of first differences and their lag-1 autocorrelation, averaged
    over symbols; differences run across dates."""
    cols = list(cols)

    def build(rows: DataFrame, along: Along) -> DataFrame:
        rows = rows.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(along.order) for c in cols})
        return rows.withColumns({f"_e_{c}": F.lag(f"_d_{c}").over(along.order) for c in cols})

    per = over_symbol(df, Stage(build, back=2), chunk_rows=chunk_rows).groupBy(SYMBOL).agg(*[
        e.alias(f"_{p}_{c}") for c in cols for p, e in (
            ("v", F.var_samp(f"_d_{c}")),
            ("r", F.corr(f"_d_{c}", f"_e_{c}")))])
    wide = per.agg(*[F.avg(f"_{p}_{c}").alias(f"_{p}_{c}") for c in cols for p in "vr"])
    return unpivot_stats(wide, {c: {
        "returns_var": F.coalesce(F.col(f"_v_{c}"), F.lit(0.0)),
        "autocorr_lag1": F.coalesce(F.col(f"_r_{c}"), F.lit(0.0))} for c in cols})


def day_volatility(df: DataFrame, col: str = "responder_8", name: str = "day_vol") -> DataFrame:
    """Mean |label| per (symbol, date); missing = 0."""
    return df.groupBy(SYMBOL, DATE).agg(F.avg(F.abs(zero_fill(col))).alias(name))


def symbol_profile(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Mean feature vector per symbol, z-scored across symbols."""
    cols = list(cols)
    prof = df.groupBy(SYMBOL).agg(*[zero_fill(F.avg(c)).alias(c) for c in cols])
    stats = prof.agg(*[f(c).alias(f"_{p}_{c}") for c in cols for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    one = F.lit(1).alias("_one")
    return (prof.select("*", one).join(stats.select("*", one), "_one")
            .select(SYMBOL, *[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9)).alias(c) for c in cols]))
