"""Rolling mean / sample deviation over the last T rows, and expanding stats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewheel.functions.scalars import finite
from tidewheel.names import ROLLING_ROWS, rolling_diff, rolling_std
from tidewheel.operators.chunks import CHUNK_ROWS, Along, Stage, centre, day_window, over_symbol

# Sliding frames re-aggregate the frame for every row, but cancel nothing;
# beyond this many rows prefix sums and a lag are cheaper.  Both give the same
# values, and both take NaN and infinities as missing.
SLIDING_ROWS = 24


def _sliding(rows: DataFrame, w: WindowSpec, cols: list[str], t: int) -> DataFrame:
    frame = w.rowsBetween(-(t - 1), 0)
    x = {c: finite(c) for c in cols}
    full = {c: F.count(x[c]).over(frame) == t for c in cols}
    return rows.withColumns(
        {f"_mean_{c}": F.when(full[c], F.avg(x[c]).over(frame)) for c in cols}
        | {f"_std_{c}": F.when(full[c], F.stddev_samp(x[c]).over(frame)) for c in cols})


def _prefix(rows: DataFrame, along: Along, cols: list[str], t: int) -> DataFrame:
    """Prefix sums of the values less their symbol mean (limits cancellation)."""
    w, running = along.order, along.running
    x = {c: F.coalesce(finite(c) - F.col(centre(c)), F.lit(0.0)) for c in cols}
    rows = rows.withColumns(
        {f"_n_{c}": F.count(finite(c)).over(running) for c in cols}
        | {f"_s_{c}": F.sum(x[c]).over(running) for c in cols}
        | {f"_q_{c}": F.sum(x[c] * x[c]).over(running) for c in cols})
    rows = rows.withColumns(
        {f"_dn_{c}": F.col(f"_n_{c}") - F.lag(f"_n_{c}", t, 0).over(w) for c in cols}
        | {f"_ds_{c}": F.col(f"_s_{c}") - F.lag(f"_s_{c}", t, 0.0).over(w) for c in cols}
        | {f"_dq_{c}": F.col(f"_q_{c}") - F.lag(f"_q_{c}", t, 0.0).over(w) for c in cols})
    out = {}
    for c in cols:
        full = F.col(f"_dn_{c}") == t
        s, q = F.col(f"_ds_{c}"), F.col(f"_dq_{c}")
        out[f"_mean_{c}"] = F.when(full, F.col(centre(c)) + s / t)
        out[f"_std_{c}"] = F.when(full, F.sqrt(F.greatest((q - s * s / t) / (t - 1), F.lit(0.0))))
    rows = rows.withColumns(out)
    return rows.drop(*[f"_{p}_{c}" for p in ("n", "s", "q", "dn", "ds", "dq") for c in cols])


def rolling_stage(cols: Iterable[str], rows: int = ROLLING_ROWS) -> Stage:
    """Adds ``_mean_{c}`` and ``_std_{c}`` over the last ``rows`` rows.

    The window counts rows of the symbol across dates; both are NULL unless
    all ``rows`` values are present and finite.
    """
    cols = list(cols)

    def build(part: DataFrame, along: Along) -> DataFrame:
        return _sliding(part, along.order, cols, rows) if rows <= SLIDING_ROWS else _prefix(part, along, cols, rows)

    return Stage(build, back=rows, centred=tuple(cols) if rows > SLIDING_ROWS else ())


def as_features(df: DataFrame, cols: Iterable[str], rows: int) -> DataFrame:
    """``_mean_``/``_std_`` columns to the deviation and deviation-size features."""
    cols = list(cols)
    out = df.withColumns({rolling_diff(c, rows): F.col(c) - F.col(f"_mean_{c}") for c in cols}
                         | {rolling_std(c, rows): F.col(f"_std_{c}") for c in cols})
    return out.drop(*[f"_{p}_{c}" for p in ("mean", "std") for c in cols])


def rolling_features(df: DataFrame, cols: Iterable[str], rows: int = ROLLING_ROWS,
                     chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Deviation from the rolling mean, and the rolling sample deviation."""
    cols = list(cols)
    return as_features(over_symbol(df, rolling_stage(cols, rows), chunk_rows=chunk_rows), cols, rows)


def day_expanding(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Deviation from the day-so-far mean, and position in the day-so-far range."""
    w = day_window().rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        out[f"{c}_day_dev"] = F.col(c) - F.avg(c).over(w)
        out[f"{c}_day_pos"] = F.when(hi > lo, (F.col(c) - lo) / (hi - lo))
    return df.withColumns(out)
