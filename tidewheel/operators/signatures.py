"""Path signatures of trailing windows inside a day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.names import DATE, RESPONDERS, SERIES, STEPS_PER_DAY, SYMBOL, TIME
from tidewheel.operators.chunks import day_window
from tidewheel.operators.forensics import _stack, series, slices
from tidewheel.functions.scalars import zero_fill


def window_signature(df: DataFrame, cols: list[str], window: int = 32, steps_per_day: int = STEPS_PER_DAY,
                     log: bool = False, include_time: bool = True) -> DataFrame:
    """Depth-2 signature of the last ``window`` points of the day, in columns.

    Level 1 is ``s1_{i}``.  Level 2 of a piecewise linear path is a window sum,
    S2[i,j] = sum(Xprev_i d_j) - X0_i (X_j - X0_j) + sum(d_i d_j)/2, taken from
    prefix sums; ``log`` keeps the antisymmetric part ``l2_{i}_{j}``, i<j,
    instead of ``s2_{i}_{j}``.  Channel 0 is the time of day in [0, 1].  Fewer
    than two points give 0; missing = 0.
    """
    w = day_window()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    chans = (["_c0"] if include_time else []) + [f"_c{i + 1}" for i in range(len(cols))]
    rows = df.withColumns(
        ({"_c0": F.col(TIME) / F.lit(float(steps_per_day - 1))} if include_time else {})
        | {f"_c{i + 1}": zero_fill(c) for i, c in enumerate(cols)})
    d = len(chans)
    rows = rows.withColumns({f"_p{i}": F.lag(c).over(w) for i, c in enumerate(chans)}
                            | {f"_o{i}": F.coalesce(F.lag(c, window - 1).over(w), F.first(c).over(running))
                               for i, c in enumerate(chans)})
    step = {i: F.coalesce(F.col(chans[i]) - F.col(f"_p{i}"), F.lit(0.0)) for i in range(d)}
    prev = {i: F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) for i in range(d)}
    # Area terms relative to the mid of each increment: (Xprev_i + d_i/2) d_j.
    rows = rows.withColumns({f"_a{i}_{j}": F.sum((prev[i] + step[i] / 2) * step[j]).over(running)
                             for i in range(d) for j in range(d)})
    rows = rows.withColumns({f"_b{i}_{j}": F.col(f"_a{i}_{j}") - F.coalesce(F.lag(f"_a{i}_{j}", window - 1).over(w), F.lit(0.0))
                             for i in range(d) for j in range(d)})
    gain = {i: F.col(chans[i]) - F.col(f"_o{i}") for i in range(d)}
    s2 = {(i, j): F.col(f"_b{i}_{j}") - F.col(f"_o{i}") * gain[j] for i in range(d) for j in range(d)}
    out = {f"s1_{i}": gain[i] for i in range(d)}
    if log:
        out |= {f"l2_{i}_{j}": (s2[i, j] - s2[j, i]) / 2 for i in range(d) for j in range(i + 1, d)}
    else:
        out |= {f"s2_{i}_{j}": s2[i, j] for i in range(d) for j in range(d)}
    return rows.withColumns(out).select(*df.columns, *out)


# -- numpy kernels for weighted and depth-3 signatures ----------------------

def _levels(path: np.ndarray, depth: int, hurst: float | None) -> list[np.ndarray]:
    """Signature levels of a batch of paths (n, points, channels).

    Increment after increment is appended by Chen's identity; ``hurst``
    rescales the increment starting at s by (1 - s + 1e-6)^(hurst - 1/2).
    """
    n, points, d = path.shape
    steps = np.diff(path, axis=1)
    if hurst is not None:
        at = np.linspace(0.0, 1.0, points)[:-1]
        steps = steps * ((1.0 - at + 1e-6) ** (hurst - 0.5))[None, :, None]
    s1, s2, s3 = np.zeros((n, d)), np.zeros((n, d, d)), np.zeros((n, d, d, d))
    for x in steps.transpose(1, 0, 2):
        xx = np.einsum("ni,nj->nij", x, x)
        if depth >= 3:
            s3 += (np.einsum("nij,nk->nijk", s2, x) + np.einsum("ni,njk->nijk", s1, xx) / 2
                   + np.einsum("ni,njk->nijk", x, xx) / 6)
        if depth >= 2:
            s2 += np.einsum("ni,nj->nij", s1, x) + xx / 2
        s1 = s1 + x
    return [s1, s2, s3][:depth]


def signature_vector(path: np.ndarray, depth: int, hurst: float | None, log: bool) -> np.ndarray:
    """Flat (log-)signature; level 2 of the log keeps the strict upper triangle."""
    levels = _levels(path, depth, hurst)
    n = len(path)
    if not log:
        return np.hstack([lv.reshape(n, -1) for lv in levels])
    s1 = levels[0]
    out = [s1]
    if depth >= 2:
        s2 = levels[1]
        area = s2 - np.einsum("ni,nj->nij", s1, s1) / 2
        out.append(area[(slice(None), *np.triu_indices(s1.shape[1], 1))])
    if depth >= 3:
        mixed = np.einsum("ni,njk->nijk", s1, s2) + np.einsum("nij,nk->nijk", s2, s1)
        cubic = np.einsum("ni,nj,nk->nijk", s1, s1, s1)
        out.append((levels[2] - mixed / 2 + cubic / 3).reshape(n, -1))
    return np.hstack(out)


def rolling_signature(df: DataFrame, cols: list[str], window: int = 32, depth: int = 3, hurst: float | None = 0.1,
                      log: bool = False, steps_per_day: int = STEPS_PER_DAY) -> DataFrame:
    """(symbol, date, time, signature array) of trailing windows inside a day."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clock = np.linspace(0.0, 1.0, steps_per_day)
        for pdf in slices(batches):
            x = np.stack([np.nan_to_num(_stack(pdf[c])) for c in cols], axis=-1)
            x = np.concatenate([np.broadcast_to(clock[None, :, None], (len(x), steps_per_day, 1)), x], axis=-1)
            sig = [signature_vector(x[:, max(0, e - window):e], depth, hurst, log) for e in range(2, steps_per_day + 1)]
            sig = np.stack([np.zeros_like(sig[0]), *sig], axis=1)
            for t in range(steps_per_day):
                yield pd.DataFrame({SYMBOL: pdf[SYMBOL], DATE: pdf[DATE], TIME: t, "signature": list(sig[:, t])})

    kinds = dict(df.dtypes)
    return series(df, cols, steps_per_day).mapInPandas(
        kernel, f"{SYMBOL} {kinds[SYMBOL]}, {DATE} {kinds[DATE]}, {TIME} int, signature array<double>")


def story_signature(df: DataFrame, cols: list[str] = RESPONDERS, days: int = 5, every: int = 4,
                    steps_per_day: int = STEPS_PER_DAY) -> DataFrame:
    """(symbol, date, signature): depth-2 log-signature of the previous ``days``
    days' path, thinned, only where all of them are complete.

    Each day's arrays are moved to the days that look back on them; a target
    gathers at most ``days`` of them.
    """
    arrays = series(df, cols, steps_per_day)
    moved = (arrays.select(SYMBOL, DATE, F.struct(*cols).alias("_day"),
                           F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_k"))
             .select(SYMBOL, (F.col(DATE) + F.col("_k")).alias(DATE), (-F.col("_k")).alias("_back"), "_day"))
    history = (moved.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("_back", "_day"))).alias("_h"))
               .where(F.size("_h") == days))
    flat = history.select(*SERIES, *[F.flatten(F.col(f"_h._day.{c}")).alias(c) for c in cols])
    flat = flat.join(df.select(*SERIES).distinct(), SERIES, "left_semi")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            x = np.stack([np.nan_to_num(_stack(pdf[c])) for c in cols], axis=-1)[:, ::every]
            clock = np.linspace(0.0, 1.0, x.shape[1])
            x = np.concatenate([np.broadcast_to(clock[None, :, None], (*x.shape[:2], 1)), x], axis=-1)
            yield pd.DataFrame({SYMBOL: pdf[SYMBOL], DATE: pdf[DATE],
                                "signature": list(signature_vector(x, 2, None, True))})

    kinds = dict(df.dtypes)
    return flat.mapInPandas(kernel, f"{SYMBOL} {kinds[SYMBOL]}, {DATE} {kinds[DATE]}, signature array<double>")
