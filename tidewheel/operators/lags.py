"""Previous-day labels and other equi-joins on date arithmetic.

"Yesterday" is ``date_id - 1``, never the previous date that happens to exist,
so these joins cannot look ahead.  Keys are unique per panel row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.scalars import zero_fill
from tidewheel.names import DATE, KEYS, RESPONDERS, SERIES, SYMBOL, TIME, lag_name


def previous_day(df: DataFrame, responders: Iterable[int], source: DataFrame | None = None) -> DataFrame:
    """responder_{r} of (symbol, date-1, time) as a feature; missing -> 0.

    The row before in the series of one symbol and step is yesterday's if it is
    one date older, so the panel is shuffled once at most and read once.  Labels
    of another table, ``source``, are joined.
    """
    rs = list(responders)
    if source is None:
        series = Window.partitionBy(SYMBOL, TIME).orderBy(DATE)
        known = F.col(SYMBOL).isNotNull() & F.col(TIME).isNotNull() & (F.lag(DATE).over(series) == F.col(DATE) - 1)
        return df.withColumns({lag_name(r): zero_fill(F.when(known, F.lag(f"responder_{r}").over(series))) for r in rs})
    lagged = source.select(
        SYMBOL, (F.col(DATE) + 1).alias(DATE), TIME, *[F.col(f"responder_{r}").alias(lag_name(r)) for r in rs])
    return (df.join(lagged, KEYS, "left")
            .withColumns({lag_name(r): zero_fill(lag_name(r)) for r in rs}))


def day_lags_wide(df: DataFrame, cols: Iterable[str] = RESPONDERS, days: int = 5) -> DataFrame:
    """``{c}_lag{k}`` for k = 1..days from one shuffle: copies are moved forward
    k days and gathered per target row; missing -> 0."""
    cols = list(cols)
    moved = (df.select(*KEYS, *cols, F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_k"))
             .withColumn(DATE, F.col(DATE) + F.col("_k")))
    wide = moved.groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{c}_lag{k}")
        for k in range(1, days + 1) for c in cols])
    out = df.join(wide, KEYS, "left")
    return out.withColumns({f"{c}_lag{k}": zero_fill(f"{c}_lag{k}") for k in range(1, days + 1) for c in cols})


def attach_map(df: DataFrame, mapping: DataFrame, value: str, default) -> DataFrame:
    """symbol -> value map; a symbol outside the map gets the default."""
    return (df.join(mapping.select(SYMBOL, value), SYMBOL, "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(default))))


def attach_labels(pool: DataFrame, labels: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Labels joined to pool rows by key."""
    return pool.join(labels.select(*KEYS, *cols), KEYS)


def lag_series_value(df: DataFrame, value: str, alias: str, default: Column | float) -> DataFrame:
    """A per-(symbol, date) value moved to the next date of the same symbol."""
    moved = df.select(SYMBOL, (F.col(DATE) + 1).alias(DATE), F.col(value).alias(alias))
    fill = default if isinstance(default, Column) else F.lit(default)
    return df.join(moved, SERIES, "left").withColumn(alias, F.coalesce(F.col(alias), fill))


def day_edges(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Value at the first and at the last step per (symbol, date); may be NULL."""
    return df.groupBy(*SERIES).agg(
        *[F.min_by(c, TIME).alias(f"{c}_first") for c in cols],
        *[F.max_by(c, TIME).alias(f"{c}_last") for c in cols])


def overnight_pairs(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Last value of date d beside the first value of date d+1, per symbol."""
    cols = list(cols)
    edges = day_edges(df, cols)
    tail = edges.select(SYMBOL, (F.col(DATE) + 1).alias(DATE), *[f"{c}_last" for c in cols])
    return edges.select(*SERIES, *[f"{c}_first" for c in cols]).join(tail, SERIES)


def score_inputs(panel: DataFrame, preds: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Reference predictions beside label and weight."""
    return panel.select(*KEYS, "weight", "responder_6").join(preds.select(*KEYS, *cols), KEYS)
