"""The feature builder: every engineered column of the recipe in two exchanges
of the panel (per symbol chunk, per key) plus small per-step aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.names import (CATEGORICAL, DATE, FEATURES, FIRST_STABLE_DATE, LAG_DIFFERENCES, ROLLED_FEATURES,
                             ROLLING_ROWS, SYMBOL, TARGET, TIME, ewma_name, lag_name, market_avg, rank_name, rolling_diff,
                             rolling_std)
from tidewheel.operators.chunks import CHUNK_ROWS, over_symbol
from tidewheel.operators.crosssection import market_average, rank_average
from tidewheel.operators.ewma import ewma
from tidewheel.operators.lags import previous_day
from tidewheel.operators.rolling import as_features, rolling_stage
from tidewheel.operators.shifts import lag_differences, realized_stage, synthetic_stage
from tidewheel.sources.panel import between_dates


@dataclass
class FeaturePlan:
    """Which features to build; defaults are the data model's own."""

    raw: list[str] = field(default_factory=lambda: list(FEATURES))
    rolled: list[str] = field(default_factory=lambda: list(ROLLED_FEATURES))
    rolling_rows: int = ROLLING_ROWS
    min_date: int | None = FIRST_STABLE_DATE
    max_date: int | None = None
    lagged: list[int] = field(default_factory=list)
    differences: bool = False
    realized: bool = False
    synthetic: bool = True
    extra: list[str] = field(default_factory=list)  # names in EXTRA_GROUPS
    target: str = TARGET
    chunk_rows: int | None = CHUNK_ROWS
    symbol_rows: int | None = None  # no symbol has more rows, if that is known

    @property
    def whole_symbols(self) -> bool:
        """A symbol is no longer than a chunk, or than a task holds: one exchange by symbol serves every step along it, without margins."""
        return self.symbol_rows is not None and self.chunk_rows is not None and self.symbol_rows <= max(self.chunk_rows, CHUNK_ROWS)

    def columns(self) -> list[str]:
        """Model inputs in order, categoricals left out."""
        t = self.rolling_rows
        cols = [*self.raw, *[rolling_diff(c, t) for c in self.rolled], *[rolling_std(c, t) for c in self.rolled],
                *[market_avg(c) for c in self.rolled], "feature_time_id"]
        if "rank_per_time" in self.extra:
            cols += [rank_name(c) for c in self.rolled]
        if "ewma_per_symbol" in self.extra:
            cols += [ewma_name(c) for c in self.rolled]
        cols += [lag_name(r) for r in self.lagged]
        if self.differences:
            cols += list(LAG_DIFFERENCES)
        return [c for c in cols if c not in CATEGORICAL]


EXTRA_GROUPS: dict[str, Callable[..., DataFrame]] = {
    "rank_per_time": rank_average,
    "ewma_per_symbol": ewma,
}


def build_features(panel: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Panel with every engineered column of the plan.

    The panel is read once per narrow aggregate (date counts, step means)
    besides the main pass: hand in a stored or persisted one.
    """
    unknown = set(plan.extra) - set(EXTRA_GROUPS)
    if unknown:
        raise ValueError(f"unknown feature groups {sorted(unknown)}; have {sorted(EXTRA_GROUPS)}")
    source = between_dates(panel, plan.min_date, plan.max_date)
    df = source
    # Steps that shuffle come first, while rows are narrow; the rolling stage,
    # which adds most columns, is the last exchange and the averages broadcast.
    for group in plan.extra:
        bound = {"symbol_rows": plan.symbol_rows} if group == "ewma_per_symbol" and plan.whole_symbols else {}
        df = EXTRA_GROUPS[group](df, plan.rolled, **bound)
    if plan.whole_symbols and "ewma_per_symbol" not in plan.extra:
        df = df.repartition(SYMBOL)
    if plan.lagged:
        df = previous_day(df, plan.lagged)
    stages = [rolling_stage(plan.rolled, plan.rolling_rows)]
    if plan.synthetic:
        stages.append(synthetic_stage())
    if plan.realized:
        stages.append(realized_stage())
    df = as_features(over_symbol(df, *stages, chunk_rows=None if plan.whole_symbols else plan.chunk_rows, source=source),
                     plan.rolled, plan.rolling_rows)
    df = market_average(df, plan.rolled, source, measured=True)
    df = df.withColumn("feature_time_id", F.col(TIME).cast("float"))
    return lag_differences(df) if plan.differences else df


def model_input(df: DataFrame, plan: FeaturePlan, keep: list[str]) -> DataFrame:
    """Keys, label, weight and the model columns, stored as floats."""
    return df.select(*keep, *[F.col(c).cast("float").alias(c) for c in plan.columns()])


def scoring_rows(df: DataFrame, valid_lo: int) -> DataFrame:
    """Drop the warm-up dates once the windows are filled."""
    return df.where(F.col(DATE) >= valid_lo)
