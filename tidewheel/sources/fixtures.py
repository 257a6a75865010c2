"""Panels over the driver's tables (see SURVEY section 7.2).

* ``trades``: line items per supplier and week; 12 weeks make one "date".
  The number of symbols grows with the data.  Only cells with rows exist.
* ``activity``: user events, eight user groups, day x hour, full grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.names import DATE, SYMBOL, TIME, VENUE_A, VENUE_B
from tidewheel.operators.chunks import CHUNK_ROWS
from tidewheel.operators.shifts import forward_mean_labels
from tidewheel.sources.panel import complete_grid

TRADES_T = 12
TRADES_D = 30
ACTIVITY_T = 24
TRADES_FEATURES = [f"feature_{i:02d}" for i in range(6)]
ACTIVITY_FEATURES = [f"feature_{i:02d}" for i in range(5)]
# Signals the labels are built from: (column, centre) per venue.
TRADES_SIGNALS = (("feature_00", 4.2), ("feature_05", 3.8))
ACTIVITY_SIGNALS = (("feature_01", 3.6), ("feature_03", 3.9))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    step = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) / 7).cast("int")
    price = F.col("l_extendedprice")
    return (li.select("*", step.alias("_step"))
            .groupBy(F.col("l_suppkey").alias(SYMBOL),
                     F.floor(F.col("_step") / TRADES_T).cast("int").alias(DATE),
                     (F.col("_step") % TRADES_T).cast("int").alias(TIME))
            .agg(F.sum("l_quantity").alias("weight"),
                 F.log(1 + F.sum(price) / 1000).alias("feature_00"),
                 F.sqrt(0.01 + F.avg("l_discount")).alias("feature_01"),
                 F.log(1 + F.count(F.lit(1)).cast("double")).alias("feature_02"),
                 F.log(F.max(F.when(F.col("l_discount") > 0.015, F.col("l_quantity")))).alias("feature_03"),
                 F.sqrt(0.01 + F.avg("l_tax")).alias("feature_04"),
                 F.log(F.avg(price) / 1000).alias("feature_05")))


def activity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy((F.col("user_id") % 8).alias(SYMBOL),
                       F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias(DATE),
                       F.hour("ts").alias(TIME))
            .agg(F.count(F.lit(1)).cast("double").alias("weight"),
                 F.log(1 + F.sum("value")).alias("feature_00"),
                 F.log(1 + F.avg("value")).alias("feature_01"),
                 F.log(1 + F.count(F.lit(1)).cast("double")).alias("feature_02"),
                 F.log(1 + F.max("value")).alias("feature_03"),
                 F.sqrt(F.sum((F.col("event_type") == "purchase").cast("double"))).alias("feature_04")))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_grid(activity_cells(spark, sf_dir), None, None, ACTIVITY_T)


def _labelled(df: DataFrame, signals, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    (a, ca), (b, cb) = signals
    return (df.withColumns({"_ua": F.col(a) - ca, "_ub": F.col(b) - cb})
            .transform(lambda d: forward_mean_labels(d, {"_ua": VENUE_A, "_ub": VENUE_B}, chunk_rows))
            .drop("_ua", "_ub"))


def trades_steps(spark: SparkSession, sf_dir: str) -> int:
    """Weeks between the first and the last shipping: no supplier has more cells."""
    lo, hi = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return 0 if lo is None else (hi.date() - lo.date()).days // 7 + 2


def trades_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades panel with its labels.

    Where the calendar bounds a supplier's cells by the rows of a chunk, one
    window per supplier does without the counts per date and their join.
    """
    return _labelled(trades(spark, sf_dir), TRADES_SIGNALS, None if trades_steps(spark, sf_dir) <= CHUNK_ROWS else CHUNK_ROWS)


def activity_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(activity(spark, sf_dir), ACTIVITY_SIGNALS)
