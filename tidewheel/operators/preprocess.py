"""Clip, standardise and zero-fill with statistics frozen on training dates."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scalars import clip, finite
from tidewheel.names import DATE
from tidewheel.operators.moments import VAR_FLOOR, column_stats, daily_moments, running_moments
from tidewheel.operators.quantiles import exact_quantiles
from tidewheel.sources.panel import ranked_dates

LOW, HIGH = 0.001, 0.999


@dataclass(frozen=True)
class FeatureStats:
    """What a column needs to be transformed: clip range, mean, deviation."""

    lo: float
    hi: float
    mean: float
    std: float


def every_kth_date(df: DataFrame, k: int) -> DataFrame:
    """Rows of every k-th present date, the first included."""
    dates = ranked_dates(df).where((F.col("date_rank") - 1) % k == 0).select(DATE)
    return df.join(dates, DATE, "left_semi")


def clip_ranges(df: DataFrame, cols: Iterable[str], low: float = LOW, high: float = HIGH) -> dict[str, tuple]:
    """Linear-interpolated clip quantiles per column."""
    q = exact_quantiles(df, {c: [low, high] for c in cols})
    return {c: tuple(v) for c, v in q.items()}


def clip_columns(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in ranges.items() if lo is not None})


def fit(df: DataFrame, cols: list[str], train_until: int, every: int = 1) -> dict[str, FeatureStats]:
    """Fit on training dates only; the tail never enters the statistics."""
    train = df.where(F.col(DATE) <= train_until).select(DATE, *cols)
    if every > 1:
        train = every_kth_date(train, every)
    ranges = clip_ranges(train, cols)
    stats = {r["feature"]: r for r in column_stats(clip_columns(train, ranges), cols).collect()}
    # One valid count serves every column: the running state is shared.
    valid = float(np.median([stats[c]["n"] for c in cols]))
    out = {}
    for c in cols:
        lo, hi = ranges[c]
        if lo is None:
            out[c] = FeatureStats(float("-inf"), float("inf"), 0.0, VAR_FLOOR ** 0.5)
            continue
        # sum of squares = var * count and back: the shared count cancels at fit.
        var = stats[c]["var"] if valid > 0 else 0.0
        out[c] = FeatureStats(lo, hi, stats[c]["mean"], max(var, VAR_FLOOR) ** 0.5)
    return out


def stats_table(spark, stats: dict[str, FeatureStats]) -> DataFrame:
    return spark.createDataFrame(
        [(c, s.lo, s.hi, s.mean, s.std) for c, s in stats.items()],
        "feature string, lo double, hi double, mean double, std double")


def standardise(c: str, lo: float, hi: float, mean: Column, std: Column) -> Column:
    """clip -> z-score -> 0 for anything missing or not finite."""
    return F.coalesce(finite((clip(c, lo, hi) - mean) / std), F.lit(0.0))


def transform(df: DataFrame, stats: dict[str, FeatureStats]) -> DataFrame:
    """Apply frozen statistics: literals in the projection, no join."""
    return df.withColumns({c: standardise(c, s.lo, s.hi, F.lit(s.mean), F.lit(s.std)) for c, s in stats.items()})


def transform_adapting(df: DataFrame, cols: list[str], stats_ranges: dict[str, tuple], first: int) -> DataFrame:
    """Standardise each date with statistics merged over all earlier dates.

    Daily moments are merged by one window over the calendar; a date's state
    ends at the previous present date.  Dates before ``first`` only feed it.
    """
    clipped = clip_columns(df, stats_ranges)
    state = running_moments(daily_moments(clipped, cols), lagged=True)
    wide = state.groupBy(DATE).agg(*[F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"_{v}_{c}")
                                     for c in cols for v in ("mean", "std")])
    rows = df.where(F.col(DATE) >= first).join(wide, DATE)
    rows = rows.withColumns({c: standardise(c, *stats_ranges[c], F.col(f"_mean_{c}"), F.col(f"_std_{c}")) for c in cols})
    return rows.drop(*[f"_{v}_{c}" for c in cols for v in ("mean", "std")])
