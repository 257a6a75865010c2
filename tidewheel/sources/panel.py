"""Reading panels: scans, date filters, key checks and row thinning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.names import DATE, KEYS, SERIES, SYMBOL, TIME


def scan_panel(spark: SparkSession, path: str) -> DataFrame:
    """Scan a parquet panel directory; the hive column is not data."""
    return spark.read.parquet(path).drop("partition_id")


def between_dates(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Inclusive date range, open where a bound is None."""
    if lo is not None:
        df = df.where(F.col(DATE) >= lo)
    if hi is not None:
        df = df.where(F.col(DATE) <= hi)
    return df


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"))


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, date range, number of symbols and of steps."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.min(DATE).alias("min_date"),
        F.max(DATE).alias("max_date"),
        F.countDistinct(SYMBOL).alias("n_symbols"),
        F.countDistinct(TIME).alias("n_times"),
    )


def feature_tags(spark: SparkSession, path: str) -> DataFrame:
    """Wide tag CSV (feature, tag_* booleans) -> (feature, tags array)."""
    return tag_lists(spark.read.option("header", True).csv(path))


def tag_lists(wide: DataFrame) -> DataFrame:
    flags = [c for c in wide.columns if c.startswith("tag_")]
    named = F.array(*[F.when(F.lower(F.col(c).cast("string")) == "true", F.lit(c)) for c in flags])
    return wide.select("feature", F.filter(named, lambda t: t.isNotNull()).alias("tags"))


def pick_dates(df: DataFrame, dates: Iterable[int]) -> DataFrame:
    """Rows of the listed dates (a literal list, so partitions are pruned)."""
    return df.where(F.col(DATE).isin([int(d) for d in dates]))


def pick_dates_of(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows whose date stands in the table ``dates``, however often.

    A semi-join: over a panel stored by date Spark reads the table first and
    then only those partitions.  Null dates match nothing.
    """
    return df.join(dates.select(DATE).where(F.col(DATE).isNotNull()), DATE, "left_semi")


def rows_for_draws(df: DataFrame, draws: DataFrame) -> DataFrame:
    """Rows per drawn date; a date drawn twice yields two groups.

    ``draws`` has (occurrence, date_id), one row per draw.
    """
    return df.join(draws.select("occurrence", DATE), DATE)


def lag_frame(df: DataFrame, responders: Iterable[int]) -> DataFrame:
    """Normalise a delayed-label frame to ``responder_{r}`` columns, NULL -> 0.

    Accepts ``responder_{r}_lag_1`` or plain ``responder_{r}``.
    """
    out = []
    for r in responders:
        found = [c for c in (f"responder_{r}_lag_1", f"responder_{r}") if c in df.columns]
        if not found:
            raise ValueError(f"delayed labels lack responder_{r}")
        out.append(F.coalesce(*[F.col(c) for c in found], F.lit(0.0)).alias(f"responder_{r}"))
    keys = [k for k in KEYS if k in df.columns]
    return df.select(*keys, *out)


def with_lookback(df: DataFrame, valid_lo: int, valid_hi: int | None, rows: int,
                  steps_per_day: int) -> DataFrame:
    """Scoring range widened by the dates a rolling window of ``rows`` needs."""
    extra = -(-rows // steps_per_day) + 1
    return between_dates(df, valid_lo - extra, valid_hi)


def thin(df: DataFrame, step: int, by: list[str] = SERIES, order: list[str] | None = None) -> DataFrame:
    """Every ``step``-th row of each series (day length divisible by step)."""
    w = Window.partitionBy(*by).orderBy(*(order or [TIME]))
    return (df.withColumn("_i", F.row_number().over(w))
            .where((F.col("_i") - 1) % step == 0).drop("_i"))


def complete_series(df: DataFrame, steps_per_day: int) -> DataFrame:
    """Keep only (symbol, date) series with exactly ``steps_per_day`` rows."""
    whole = (df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") == steps_per_day).select(*SERIES))
    return df.join(whole, SERIES, "left_semi")


def complete_grid(df: DataFrame, lo: int | None, hi: int | None, steps_per_day: int,
                  symbols: DataFrame | None = None) -> DataFrame:
    """Every symbol at every step of the dates; absent cells null, weight 0.

    The dates are those of the data, widened to [lo, hi] where given, and a day
    has at least ``steps_per_day`` steps, so no row of the listed symbols falls
    outside the slate.
    """
    limits = df.agg(F.least(F.min(DATE), F.lit(lo)).cast("int").alias("_lo"), F.greatest(F.max(DATE), F.lit(hi)).cast("int").alias("_hi"),
                    F.greatest(F.max(TIME), F.lit(steps_per_day - 1)).cast("int").alias("_end"))
    slate = ((symbols if symbols is not None else df).select(SYMBOL).distinct()
             .crossJoin(F.broadcast(limits))  # one row
             .withColumn(DATE, F.explode(F.sequence("_lo", "_hi")))
             .withColumn(TIME, F.explode(F.sequence(F.lit(0), F.col("_end"))))
             .select(*KEYS))
    out = slate.join(df, KEYS, "left")
    if "weight" in df.columns:
        out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return out


def history_tail(df: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` rows of each symbol.

    Whole dates that cannot reach the tail are dropped first, from per-date
    counts, so the ranking window only ever sees about ``rows`` rows.
    """
    newer = Window.partitionBy(SYMBOL).orderBy(F.desc(DATE)).rowsBetween(Window.unboundedPreceding, -1)
    dates = (df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
             .where(F.col("_newer") < rows).select(*SERIES))
    w = Window.partitionBy(SYMBOL).orderBy(F.desc(DATE), F.desc(TIME))
    return (df.join(dates, SERIES, "left_semi")
            .withColumn("_i", F.row_number().over(w))
            .where(F.col("_i") <= rows).drop("_i"))


def distinct_dates(df: DataFrame) -> DataFrame:
    return df.select(DATE).distinct()


def ranked_dates(df: DataFrame) -> DataFrame:
    """(date_id, date_rank 1..n, n_dates); one row per calendar date."""
    w = Window.orderBy(DATE)
    every = Window.partitionBy()
    return (distinct_dates(df)
            .select(DATE, F.row_number().over(w).alias("date_rank"),
                    F.count(F.lit(1)).over(every).alias("n_dates")))


def manifest(df: DataFrame) -> DataFrame:
    """Per-date row ranges [row_start, row_end) in date order."""
    w = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return (df.groupBy(DATE).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("row_end", F.sum("n_rows").over(w))
            .select(DATE, (F.col("row_end") - F.col("n_rows")).alias("row_start"), "row_end", "n_rows"))
