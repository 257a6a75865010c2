"""Column expressions: null handling, clips, combos and row-wise blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_FLOAT_MAX = 65504.0  # largest finite half-precision value


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN and NULL both mean missing; keep NULL only."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c: str | Column) -> Column:
    """NULL for NaN and both infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def zero_fill(c: str | Column) -> Column:
    return F.coalesce(nan_to_null(c), F.lit(0.0))


def clean_panel(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Turn NaN into NULL in the given floating-point columns."""
    return df.withColumns({c: nan_to_null(c) for c in cols})


def clip(c: str | Column, lo, hi) -> Column:
    """Clip to [lo, hi]; a missing value stays missing."""
    c = col(c)
    bound = F.least(F.greatest(c, F.lit(lo) if not isinstance(lo, Column) else lo),
                    F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(c.isNotNull(), bound)


def saturate_half(c: str | Column) -> Column:
    """Saturating cast to the half-precision value range, stored as float."""
    return clip(c, -HALF_FLOAT_MAX, HALF_FLOAT_MAX).cast("float")


def clip_prediction(c: str | Column, bound: float = 5.0) -> Column:
    return clip(c, -bound, bound)


def downcast(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Store doubles as floats (Spark has no half type)."""
    return df.withColumns({c: F.col(c).cast("float") for c in cols})


def drop_incomplete(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep rows whose listed columns are all present and finite."""
    keep = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in cols])
    return df.where(keep)


# -- pair combos -----------------------------------------------------------

def _guarded_ratio(a: Column, b: Column) -> Column:
    """a/b with |b| held at 0.1 or more: sign kept, zero counts as positive."""
    floor = F.when(b < 0, F.lit(-0.1)).otherwise(F.lit(0.1))
    return a / F.when(F.abs(b) < 0.1, floor).otherwise(b)


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


COMBOS: dict[str, Callable[[Column, Column], Column]] = {
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": _guarded_ratio,
    "min": lambda a, b: _both(a, b, F.least(a, b)),
    "max": lambda a, b: _both(a, b, F.greatest(a, b)),
}


def combo(op: str, a: str | Column, b: str | Column) -> Column:
    return COMBOS[op](col(a), col(b))


def combo_name(op: str, a: str, b: str) -> str:
    return f"{op}({a},{b})"


# -- scaling ---------------------------------------------------------------

def log_abs(c: str | Column) -> Column:
    """log1p|x|, the volatility-model target."""
    return F.log1p(F.abs(col(c)))


def vol_from_log(c: str | Column, floor: float = 0.05) -> Column:
    """Back from log1p|x| to a volatility, floored."""
    return F.greatest(F.expm1(col(c)), F.lit(floor))


def vol_scale(pred: str | Column, vol: str | Column, mean_vol, gamma) -> Column:
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    m = mean_vol if isinstance(mean_vol, Column) else F.lit(float(mean_vol))
    return col(pred) * F.pow(col(vol) / m, g)


def regime(c: str | Column, threshold) -> Column:
    """calm below the threshold, storm at or above it."""
    return F.when(col(c) < threshold, F.lit("calm")).otherwise(F.lit("storm"))


def recency_weight(weight: str | Column, date: str | Column, anchor: int, halflife: float) -> Column:
    """weight * 0.5 ** (age / halflife), age counted back from the anchor date."""
    return col(weight) * F.pow(F.lit(0.5), (F.lit(anchor) - col(date)) / F.lit(float(halflife)))


def one_hot(df: DataFrame, key: str, values: list, prefix: str) -> DataFrame:
    """One 0/1 column per listed value; an unknown value is all zero."""
    return df.withColumns({
        f"{prefix}_{v}": F.when(F.col(key) == F.lit(v), 1.0).otherwise(0.0) for v in values
    })


def null_count(cols: Iterable[str]) -> Column:
    """How many of the listed columns are missing in the row."""
    return reduce(lambda a, b: a + b, [F.isnull(c).cast("int") for c in cols])


def interaction_block(df: DataFrame, feats: list[str], bucket: str, levels: list[int]) -> DataFrame:
    """feature x bucket-dummy columns."""
    return df.withColumns({
        f"{f}_x_{bucket}_{k}": F.when(F.col(bucket) == k, F.col(f)).otherwise(0.0)
        for f in feats for k in levels
    })


def row_sum(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


# -- long output -----------------------------------------------------------

def unpivot_stats(df: DataFrame, items: dict[str, dict[str, Column]], key: str = "feature",
                  keep: Iterable[str] = ()) -> DataFrame:
    """One output row per item from a (small) wide row: {item: {stat: column}}."""
    rows = F.array(*[
        F.struct(F.lit(name).alias(key), *[c.alias(s) for s, c in stats.items()])
        for name, stats in items.items()
    ])
    return df.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.*")
