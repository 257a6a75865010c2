"""Blend report: singles, pairwise correlation, raw / calibrated / scaled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.names import DATE, KEYS
from tidewheel.operators.ensemble import (GAMMAS, LOOKBACK_DATES, MIN_HISTORY_ROWS, best_gamma, blends, calibrate,
                                          gamma_scores, pairwise, singles)
from tidewheel.operators.scores import r2_expr


def blend_report(streams: DataFrame, combos: dict[str, list[str]], vol: DataFrame, split_date: int,
                 lookback: int = LOOKBACK_DATES, min_rows: int = MIN_HISTORY_ROWS,
                 gammas: tuple[float, ...] = GAMMAS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(singles, pairwise correlations, one row per combo).

    ``vol`` has the keys and a volatility column.  Gamma is chosen on dates up
    to ``split_date`` and judged on the later ones.
    """
    made = blends(streams, combos).persist()  # read by the history, the scores and the gamma search
    raw = made.groupBy("stream").agg(r2_expr().alias("raw_full"))
    cal = calibrate(made, lookback, min_rows).drop("alpha").persist()
    late = F.when(F.col(DATE) > split_date, F.col("w"))
    scored = (cal.withColumn("_w2", late).groupBy("stream")
              .agg(r2_expr().alias("cal_full"), r2_expr(w="_w2").alias("cal_h2")))
    scores = gamma_scores(cal.join(vol.select(*KEYS, "vol"), KEYS), split_date, gammas, by=["stream"])
    rows = best_gamma(scores, ["stream"]).select(
        "stream", "gamma", F.col("r2_full").alias("cal_vol_full"), F.col("r2_h2").alias("cal_vol_h2"))
    names = sorted({m for ms in combos.values() for m in ms})
    return singles(streams), pairwise(streams, names), raw.join(scored, "stream").join(rows, "stream")


def bag(members: dict[str, DataFrame]) -> DataFrame:
    """Union of members' predictions as one long stream table."""
    return reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(name).alias("stream"), *KEYS, "y", "w", "pred") for name, df in members.items()])
