"""Column statistics, mergeable daily moments and Gram matrices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.scalars import unpivot_stats
from tidewheel.names import DATE

VAR_FLOOR = 1e-12
HELD_ENTRIES = 8_000_000  # Gram entries a task keeps before passing them on (64 MB)


def column_stats(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """(feature, n, mean, var, null_rate): population variance, null-safe."""
    cols = list(cols)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[f(c).alias(f"_{p}_{c}") for c in cols
                    for p, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    return unpivot_stats(wide, {c: {
        "n": F.col(f"_n_{c}"), "mean": F.col(f"_m_{c}"), "var": F.col(f"_v_{c}"),
        "null_rate": F.try_divide((F.col("_rows") - F.col(f"_n_{c}")).cast("double"), F.col("_rows").cast("double")),
    } for c in cols})


def target_correlations(df: DataFrame, cols: Iterable[str], target: str) -> DataFrame:
    """(feature, corr) with the target over rows where both are present."""
    cols = list(cols)
    wide = df.agg(*[F.corr(c, target).alias(c) for c in cols])
    return unpivot_stats(wide, {c: {"corr": F.coalesce(F.col(c), F.lit(0.0))} for c in cols})


def daily_moments(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """(date, feature, n, mean, var) per date; n is the median valid count over
    the columns of that date, the shared count of the running scaler."""
    cols = list(cols)
    wide = df.groupBy(DATE).agg(*[f(c).alias(f"_{p}_{c}") for c in cols
                                  for p, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    counts = F.array_sort(F.array(*[F.col(f"_n_{c}") for c in cols]))
    k = len(cols)
    mid = (F.element_at(counts, (k - 1) // 2 + 1) + F.element_at(counts, k // 2 + 1)) / 2.0
    return unpivot_stats(wide.withColumn("n", mid), {c: {
        "mean": F.col(f"_m_{c}"), "var": F.col(f"_v_{c}")} for c in cols}, keep=[DATE, "n"])


def running_moments(daily: DataFrame, lagged: bool = False) -> DataFrame:
    """Merged (n, mean, var, std) of all dates up to and including each date.

    The pooled update is associative, so it is a running sum of n, n*mean and
    n*(var+mean^2) over the calendar.  ``lagged`` stops one present date before.
    A date without a single value of the column adds nothing.
    """
    end = -1 if lagged else 0
    w = Window.partitionBy("feature").orderBy(DATE).rowsBetween(Window.unboundedPreceding, end)
    n = F.when(F.col("mean").isNotNull(), F.col("n"))
    s1, s2 = n * F.col("mean"), n * (F.col("var") + F.col("mean") * F.col("mean"))
    out = daily.select(DATE, "feature", F.sum(n).over(w).alias("n"),
                       F.sum(s1).over(w).alias("_s1"), F.sum(s2).over(w).alias("_s2"))
    mean = F.try_divide(F.col("_s1"), F.col("n"))
    return (out.withColumn("mean", mean)
            .withColumn("var", F.greatest(F.try_divide(F.col("_s2"), F.col("n")) - F.col("mean") * F.col("mean"), F.lit(0.0)))
            .withColumn("std", F.sqrt(F.greatest(F.col("var"), F.lit(VAR_FLOOR))))
            .drop("_s1", "_s2"))


def gram(df: DataFrame, cols: list[str], weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """Weighted cross-product table (by, i, j, value) of the listed columns.

    Each task adds its rows up to one K x K block per key, so what is exchanged
    does not grow with the rows of a key.  Missing = 0.  ``i <= j`` index into
    ``cols``.
    """
    by = list(by)
    k = len(cols)
    iu, ju = np.triu_indices(k)
    kinds = dict(df.dtypes)
    source = df.select(*by, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
                       *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{i}")
                         for i, c in enumerate(cols)])
    xs = [f"_x{i}" for i in range(k)]
    held = max(1, HELD_ENTRIES // len(iu))

    def emit(sums: dict) -> Iterator[pd.DataFrame]:
        for key, g in sums.items():
            yield pd.DataFrame({**{b: np.repeat(v, len(iu)) for b, v in zip(by, key)}, "i": iu, "j": ju, "value": g})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            pdf = pdf[pdf["_w"].notna()]
            for key, part in (pdf.groupby(by, sort=False) if by else [((), pdf)]):
                x = part[xs].to_numpy()
                g = ((x * part["_w"].to_numpy()[:, None]).T @ x)[iu, ju]
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums[key] + g if key in sums else g
            if len(sums) > held:
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    schema = ", ".join([f"{b} {kinds[b]}" for b in by] + ["i int", "j int", "value double"])
    return (source.mapInPandas(blocks, schema)
            .groupBy(*by, "i", "j").agg(F.sum("value").alias("value")))


def gram_matrix(table: DataFrame, k: int) -> np.ndarray:
    """A K x K table collected as a symmetric matrix."""
    g = np.zeros((k, k))
    for r in table.select("i", "j", "value").collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["value"]
    return g


def ridge_solve(g: np.ndarray, n_x: int, lam: float, target: int | None = None) -> np.ndarray:
    """Coefficients from a Gram matrix whose first n_x rows are the inputs."""
    t = n_x if target is None else target
    return np.linalg.solve(g[:n_x, :n_x] + lam * np.eye(n_x), g[:n_x, t])


def ridge_fit(df: DataFrame, cols: list[str], target: str, weight: str | None = None,
              lam: float = 100.0) -> np.ndarray:
    """Weighted ridge without intercept from one pass over the rows."""
    rows = df.where(F.col(target).isNotNull())
    return ridge_solve(gram_matrix(gram(rows, [*cols, target], weight), len(cols) + 1), len(cols), lam)


def linear_score(cols: list[str], coef: Iterable[float]):
    """Column expression of the dot product; a missing input counts 0."""
    return sum((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.lit(float(b))
                for c, b in zip(cols, coef)), F.lit(0.0))
