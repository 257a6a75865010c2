"""Weighted zero-mean R2 and weighted summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-38


def loss_expr(y: str = "y", pred: str = "pred", w: str = "w") -> Column:
    """sum w (p-y)^2 / sum w y^2, per unit of weight with a tiny floor."""
    e = F.col(pred) - F.col(y)
    mass = F.sum(w)
    num = F.try_divide(F.sum(F.col(w) * e * e), mass)
    den = F.try_divide(F.sum(F.col(w) * F.col(y) * F.col(y)), mass)
    return num / (den + F.lit(TINY))


def r2_expr(y: str = "y", pred: str = "pred", w: str = "w") -> Column:
    return 1 - loss_expr(y, pred, w)


def weighted_mean(x: str | Column, w: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    w = F.col(w) if isinstance(w, str) else w
    return F.try_divide(F.sum(w * x), F.sum(w))


def r2(df: DataFrame, by: Iterable[str] = (), y: str = "y", pred: str = "pred", w: str = "w",
       name: str = "r2") -> DataFrame:
    """R2 per group; rows without label or prediction do not count."""
    rows = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    return rows.groupBy(*by).agg(r2_expr(y, pred, w).alias(name))


def daily_report(df: DataFrame, by: Iterable[str] = ("stream", "date_id")) -> DataFrame:
    """Per-day score with the mean, deviation and largest size of predictions."""
    return (df.where(F.col("y").isNotNull() & F.col("pred").isNotNull()).groupBy(*by)
            .agg(r2_expr().alias("r2"), F.avg("pred").alias("pred_mean"),
                 F.stddev_pop("pred").alias("pred_std"), F.max(F.abs("pred")).alias("pred_max_abs"),
                 F.count(F.lit(1)).alias("n_rows")))


def variant_scores(df: DataFrame, preds: dict[str, str]) -> DataFrame:
    """(variant, r2) of several prediction expressions in one pass."""
    rows = df.withColumns({f"_p{i}": F.expr(e) for i, e in enumerate(preds.values())})
    wide = rows.agg(*[r2_expr(pred=f"_p{i}").alias(f"_r{i}") for i in range(len(preds))])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(f"_r{i}").alias("r2")) for i, n in enumerate(preds)])).alias("_r")).select("_r.*")


def delta_vs_base(results: DataFrame, base: str, variant: str = "variant", score: str = "r2") -> DataFrame:
    """Score difference of each variant to the base variant (a handful of rows)."""
    ref = results.where(F.col(variant) == base).agg(F.first(score).alias("_base"))
    return (results.withColumn("_one", F.lit(1)).join(ref.withColumn("_one", F.lit(1)), "_one")
            .withColumn("delta_vs_base", F.col(score) - F.col("_base")).drop("_one", "_base"))
