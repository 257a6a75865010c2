"""Walk-forward evaluation as prefix sums instead of a day loop.

Predicting date d with everything up to d-1 needs only the Gram table of those
dates.  Daily Gram tables are summed along the calendar, each date's system is
solved on its own, and the coefficients are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.scalars import clip_prediction
from tidewheel.names import DATE
from tidewheel.operators.moments import gram, linear_score
from tidewheel.operators.scores import r2


def daily_gram(df: DataFrame, cols: list[str], y: str = "y", w: str = "w") -> DataFrame:
    return gram(df.where(F.col(y).isNotNull()), [*cols, y], w, by=[DATE])


def gram_state(daily: DataFrame, dates: DataFrame, size: int, embargo: int = 1, length: int | None = None) -> DataFrame:
    """Gram table of the dates [d - length, d - embargo] for each date d.

    Each entry (i, j) is a sum along the calendar: one small group per entry,
    one row per date.  Dates without labelled rows enter as zeros; ``size`` is
    the order of the table.
    """
    at = F.col("_at")
    blank = (dates.select(DATE).distinct()
             .withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
             .select(DATE, F.floor(at / size).cast("int").alias("i"), (at % size).alias("j"), F.lit(0.0).alias("value"))
             .where("i <= j"))
    every = daily.unionByName(blank).groupBy(DATE, "i", "j").agg(F.sum("value").alias("value"))
    start = Window.unboundedPreceding if length is None else -length
    w = Window.partitionBy("i", "j").orderBy(DATE).rangeBetween(start, -embargo)
    return every.withColumn("value", F.sum("value").over(w)).where(F.col("value").isNotNull())


def solve_dates(state: DataFrame, n_x: int, lam: float) -> DataFrame:
    """(date_id, coef array): one K x K solve per date."""
    kind = dict(state.dtypes)[DATE]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((n_x + 1, n_x + 1))
        g[pdf["i"], pdf["j"]] = pdf["value"]
        g[pdf["j"], pdf["i"]] = pdf["value"]
        coef = np.linalg.solve(g[:n_x, :n_x] + lam * np.eye(n_x), g[:n_x, n_x])
        return pd.DataFrame({DATE: [pdf[DATE].iloc[0]], "coef": [coef.tolist()]})

    return state.groupBy(DATE).applyInPandas(solve, f"{DATE} {kind}, coef array<double>")


def apply_coefficients(df: DataFrame, coefs: DataFrame, cols: list[str], bound: float = 5.0) -> DataFrame:
    rows = df.join(coefs, DATE)
    dot = sum((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.col("coef")[i]
               for i, c in enumerate(cols)), F.lit(0.0))
    return rows.withColumn("pred", clip_prediction(dot, bound)).drop("coef")


def walk_forward(df: DataFrame, cols: list[str], valid_lo: int, lam: float = 100.0, embargo: int = 1,
                 length: int | None = None, online: bool = True, y: str = "y", w: str = "w") -> DataFrame:
    """``pred`` for every row from ``valid_lo`` on.

    Online: date d uses dates up to d - embargo.  Static: the coefficients
    of ``valid_lo`` serve all later dates.
    """
    daily = daily_gram(df, cols, y, w)
    state = gram_state(daily, df, len(cols) + 1, embargo, length).where(F.col(DATE) >= valid_lo)
    valid = df.where(F.col(DATE) >= valid_lo)
    if not online:
        first = state.agg(F.min(DATE)).first()[0]
        coef = solve_dates(state.where(F.col(DATE) == first), len(cols), lam).first()["coef"]
        return valid.withColumn("pred", clip_prediction(linear_score(cols, coef), 5.0))
    return apply_coefficients(valid, solve_dates(state, len(cols), lam), cols)


def window_ladder(df: DataFrame, cols: list[str], valid_lo: int, lengths: Iterable[int], lam: float = 100.0,
                  y: str = "y", w: str = "w") -> DataFrame:
    """(length, r2): the same walk with growing training windows.

    All rungs share the daily Gram table and one pass over the scored rows.
    """
    daily = daily_gram(df, cols, y, w)
    valid = df.where(F.col(DATE) >= valid_lo)
    coefs = None
    for n in lengths:
        part = (solve_dates(gram_state(daily, df, len(cols) + 1, 1, n).where(F.col(DATE) >= valid_lo), len(cols), lam)
                .withColumn("length", F.lit(int(n))))
        coefs = part if coefs is None else coefs.unionByName(part)
    return r2(apply_coefficients(valid, coefs, cols), ["length"], y, "pred", w)
