"""Residual and regime diagnostics over a scored table (keys, y, w, pred)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.names import DATE, SYMBOL, TIME
from tidewheel.operators.crosssection import rank_average
from tidewheel.operators.quantiles import exact_quantiles, quantile_bucket
from tidewheel.operators.scores import r2_expr, weighted_mean
from tidewheel.operators.structure import market_share


def scored(df: DataFrame) -> DataFrame:
    return df.where(F.col("y").isNotNull() & F.col("pred").isNotNull())


def value_buckets(df: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """Bucket 1..n by exact quantiles of the column; equal values stay together."""
    cuts = exact_quantiles(df, {col: [i / n for i in range(1, n)]})[col]
    if cuts[0] is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, quantile_bucket(F.col(col), cuts))


def calibration_deciles(df: DataFrame, n: int = 10) -> DataFrame:
    """E[y], E[pred] and their ratio per prediction decile."""
    rows = value_buckets(scored(df), "pred", n, "decile")
    out = rows.groupBy("decile").agg(F.count(F.lit(1)).alias("n_rows"), weighted_mean("y", "w").alias("mean_y"),
                                     weighted_mean("pred", "w").alias("mean_pred"))
    return out.withColumn("ratio", F.try_divide(F.col("mean_y"), F.col("mean_pred")))


def residual_persistence(df: DataFrame) -> DataFrame:
    """Correlation of a symbol's mean residual with that of the day before."""
    day = scored(df).groupBy(SYMBOL, DATE).agg(F.avg(F.col("y") - F.col("pred")).alias("e"))
    before = day.select(SYMBOL, (F.col(DATE) + 1).alias(DATE), F.col("e").alias("e0"))
    return day.join(before, [SYMBOL, DATE]).agg(F.count(F.lit(1)).alias("n_pairs"), F.corr("e", "e0").alias("corr"))


def common_residual_share(df: DataFrame) -> DataFrame:
    """Per-step common share of residual variance beside the 1/n floor."""
    rows = scored(df).withColumn("resid", F.col("y") - F.col("pred"))
    floor = (rows.groupBy(DATE, TIME).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.try_divide(F.count(F.lit(1)).cast("double"), F.sum("n").cast("double")).alias("floor")))
    one = F.lit(1).alias("_one")
    return (market_share(rows, ["resid"], min_symbols=1).select(F.col("market_share").alias("share"), one)
            .join(floor.select("floor", one), "_one").drop("_one"))


def tail_share(df: DataFrame, q: float = 0.99) -> DataFrame:
    """Error share, energy share, sign accuracy and size ratio of the largest |y|."""
    rows = scored(df).withColumn("_a", F.abs("y"))
    cut = exact_quantiles(rows, {"_a": [q]})["_a"][0]
    tail = F.col("_a") >= F.lit(cut)
    e2 = F.col("w") * (F.col("pred") - F.col("y")) * (F.col("pred") - F.col("y"))
    y2 = F.col("w") * F.col("y") * F.col("y")
    return rows.agg(
        F.count(F.when(tail, 1)).alias("n_tail"),
        F.try_divide(F.sum(F.when(tail, e2)), F.sum(e2)).alias("error_share"),
        F.try_divide(F.sum(F.when(tail, y2)), F.sum(y2)).alias("energy_share"),
        F.avg(F.when(tail, (F.signum("pred") == F.signum("y")).cast("double"))).alias("sign_accuracy"),
        F.try_divide(F.avg(F.when(tail, F.col("_a"))), F.avg(F.when(tail, F.abs("pred")))).alias("size_ratio"))


def by_regime(df: DataFrame, vol: str, feats: Iterable[str], n: int = 3, time_parts: int | None = None,
              steps_per_day: int = 968) -> DataFrame:
    """Score and feature-label correlation per volatility bucket, optionally
    crossed with the part of the day (cube: NULL means all)."""
    rows = value_buckets(scored(df), vol, n, "vol_bucket")
    aggs = [F.count(F.lit(1)).alias("n_rows"), r2_expr().alias("r2"), *[F.corr(f, "y").alias(f"corr_{f}") for f in feats]]
    if time_parts is None:
        return rows.groupBy("vol_bucket").agg(*aggs)
    part = F.floor(F.col(TIME) * time_parts / steps_per_day).cast("int")
    return rows.withColumn("day_part", part).cube("vol_bucket", "day_part").agg(*aggs)


def market_internals(df: DataFrame, col: str) -> DataFrame:
    """Breadth, dispersion and mean absolute move of yesterday, per date."""
    day = df.groupBy(DATE).agg(F.avg((F.col(col) > 0).cast("double")).alias("breadth"),
                               F.stddev_samp(col).alias("dispersion"), F.avg(F.abs(col)).alias("mean_abs"))
    past = day.select((F.col(DATE) + 1).alias(DATE), *[F.col(c).alias(f"{c}_lag1d") for c in ("breadth", "dispersion", "mean_abs")])
    return day.select(DATE).join(past, DATE, "left")


def score_stability(a: DataFrame, b: DataFrame, score: str = "score", floor: float = 0.0) -> DataFrame:
    """Spearman and sign agreement of a per-feature score between two windows."""
    pair = (a.select("feature", F.col(score).alias("sa")).join(b.select("feature", F.col(score).alias("sb")), "feature")
            .withColumn("_g", F.lit(1)))
    ranked = rank_average(pair, ["sa", "sb"], by=["_g"], method="window", names={"sa": "ra", "sb": "rb"})
    big = (F.abs("sa") > floor) & (F.abs("sb") > floor)
    return ranked.agg(F.corr("ra", "rb").alias("spearman"),
                      F.avg(F.when(big, (F.signum("sa") == F.signum("sb")).cast("double"))).alias("sign_agreement"),
                      F.count(F.lit(1)).alias("n_features"))


def first_max(df: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the largest score; the earliest in ``order`` wins a tie."""
    return df.orderBy(F.desc(score), order).limit(1)


def top_by_abs(df: DataFrame, score: str, n: int = 25, name: str = "feature") -> DataFrame:
    """Top-n report ordered by |score| (take-ordered, no full sort)."""
    return df.orderBy(F.desc(F.abs(F.coalesce(F.col(score), F.lit(0.0)))), name).limit(n)


def ranked_report(df: DataFrame, score: str, n: int, name: str = "feature") -> DataFrame:
    """The top-n rows with their position."""
    top = top_by_abs(df, score, n, name)
    w = Window.orderBy(F.desc(F.abs(F.coalesce(F.col(score), F.lit(0.0)))), name)  # n rows
    return top.withColumn("position", F.row_number().over(w))
