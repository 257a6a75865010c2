"""Shifted, differenced and forward-averaged columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewheel.names import LAG_DIFFERENCES, VENUE_SPREAD, lag_name
from tidewheel.operators.chunks import CHUNK_ROWS, Along, Stage, day_window, over_symbol

# ---- fixed values: synthetic label -> (base responder, forward shifts) ----
FORWARD_SUMS = {"responder_9": ("responder_8", [4]), "responder_10": ("responder_6", [20, 40])}
# ---- fixed values: realized label -> (base responder, backward shift) -----
REALIZED = {"responder_11": ("responder_6", 20), "responder_12": ("responder_8", 4)}


def synthetic_stage(sums: dict = FORWARD_SUMS) -> Stage:
    """Column plus its forward shifts across dates; any missing term gives 0."""
    def build(rows: DataFrame, along: Along) -> DataFrame:
        return rows.withColumns({
            name: F.coalesce(sum((F.lead(base, k).over(along.order) for k in ks), F.col(base)), F.lit(0.0))
            for name, (base, ks) in sums.items()
        })
    return Stage(build, fwd=max(max(ks) for _, ks in sums.values()))


def realized_stage(shifts: dict = REALIZED) -> Stage:
    """Label value of k rows ago (across dates), missing -> 0."""
    def build(rows: DataFrame, along: Along) -> DataFrame:
        return rows.withColumns({
            name: F.coalesce(F.lag(base, k).over(along.order), F.lit(0.0)) for name, (base, k) in shifts.items()
        })
    return Stage(build, back=max(k for _, k in shifts.values()))


def synthetic_targets(df: DataFrame, sums: dict = FORWARD_SUMS, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return over_symbol(df, synthetic_stage(sums), chunk_rows=chunk_rows)


def realized_targets(df: DataFrame, shifts: dict = REALIZED, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return over_symbol(df, realized_stage(shifts), chunk_rows=chunk_rows)


def day_forward_sum(base: str, shifts: Iterable[int]) -> Column:
    """Column plus forward shifts inside the day; missing terms count 0."""
    w = day_window()
    return sum((F.coalesce(F.lead(base, k).over(w), F.lit(0.0)) for k in shifts),
               F.coalesce(F.col(base), F.lit(0.0)))


def day_backward_shift(base: str, k: int) -> Column:
    """Value k steps ago inside the day, 0 before."""
    return F.coalesce(F.lag(base, k).over(day_window()), F.lit(0.0))


def _prefix(rows: DataFrame, running: WindowSpec, bases: list[str]) -> DataFrame:
    """Running sum ``_s_`` and count ``_n_`` of present values."""
    return rows.withColumns({f"_s_{u}": F.sum(F.coalesce(F.col(u), F.lit(0.0))).over(running) for u in bases}
                            | {f"_n_{u}": F.count(u).over(running) for u in bases})


def _bases(specs: list[tuple[str, int, str]]) -> list[str]:
    return sorted({u for u, _, _ in specs})


def _forward_mean(rows: DataFrame, w: WindowSpec, specs: list[tuple[str, int, str]]) -> DataFrame:
    """mean(u[t+1..t+k]) from prefix sums; NULL unless all k values exist."""
    rows = _prefix(rows, w.rowsBetween(Window.unboundedPreceding, 0), _bases(specs))
    rows = rows.withColumns({
        name: F.when(F.lead(f"_n_{u}", k).over(w) - F.col(f"_n_{u}") == k,
                     (F.lead(f"_s_{u}", k).over(w) - F.col(f"_s_{u}")) / k)
        for u, k, name in specs
    })
    return rows.drop(*[f"_{p}_{u}" for u in _bases(specs) for p in "sn"])


def _realized_mean(rows: DataFrame, w: WindowSpec, specs: list[tuple[str, int, str]]) -> DataFrame:
    rows = _prefix(rows, w.rowsBetween(Window.unboundedPreceding, 0), _bases(specs))
    rows = rows.withColumns({
        name: F.when(F.col(f"_n_{u}") - F.lag(f"_n_{u}", k).over(w) == k,
                     (F.col(f"_s_{u}") - F.lag(f"_s_{u}", k).over(w)) / k)
        for u, k, name in specs
    })
    return rows.drop(*[f"_{p}_{u}" for u in _bases(specs) for p in "sn"])


def forward_means(df: DataFrame, specs: list[tuple[str, int, str]],
                  chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Forward moving averages (column, rows, output name) across dates."""
    stage = Stage(lambda r, a: _forward_mean(r, a.order, specs), fwd=max(k for _, k, _ in specs))
    return over_symbol(df, stage, chunk_rows=chunk_rows)


def realized_means(df: DataFrame, specs: list[tuple[str, int, str]],
                   chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """The forward mean that completed at t: mean(u[t-k+1..t]) from row k on."""
    # One row beyond the window: the prefix just before it must be in reach.
    stage = Stage(lambda r, a: _realized_mean(r, a.order, specs), back=max(k for _, k, _ in specs) + 1)
    return over_symbol(df, stage, chunk_rows=chunk_rows)


def day_forward_means(df: DataFrame, specs: list[tuple[str, int, str]]) -> DataFrame:
    """Forward moving averages inside one day."""
    return _forward_mean(df, day_window(), specs)


def forward_mean_labels(df: DataFrame, venues: dict[str, dict[int, int]],
                        chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """responder_3..8 as forward means of two venue signals, 0..2 as spreads."""
    specs = [(u, k, f"responder_{r}") for u, rs in venues.items() for r, k in rs.items()]
    out = forward_means(df, specs, chunk_rows)
    return out.withColumns({
        f"responder_{r}": F.col(f"responder_{a}") - F.col(f"responder_{b}")
        for r, (a, b) in VENUE_SPREAD.items()
    })


def day_differences(df: DataFrame, cols: Iterable[str], deltas: Iterable[int] = (1, 8, 40)) -> DataFrame:
    """Trailing differences inside the day, 0 for the first delta steps."""
    w = day_window()
    return df.withColumns({
        f"{c}_diff_{k}": F.coalesce(F.col(c) - F.lag(c, k).over(w), F.lit(0.0)) for c in cols for k in deltas
    })


def day_first_difference(base: str) -> Column:
    return F.coalesce(F.col(base) - F.lag(base).over(day_window()), F.lit(0.0))


def day_lags(df: DataFrame, col: str, p: int, increments: bool = False) -> DataFrame:
    """p lags of the level, or of the one-step increment, inside the day."""
    w = day_window()
    src = col
    if increments:
        df = df.withColumn("_inc", F.col(col) - F.lag(col).over(w))
        src = "_inc"
    out = df.withColumns({f"lag_{k}": F.lag(src, k).over(w) for k in range(1, p + 1)})
    return out.drop("_inc")


def lag_differences(df: DataFrame, names: Iterable[str] = tuple(LAG_DIFFERENCES)) -> DataFrame:
    """Momentum and venue-spread features from the previous-day labels."""
    names = list(names)
    need = sorted({lag_name(r) for n in names for r in LAG_DIFFERENCES[n]})
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"lag differences need the previous-day labels {missing}")
    return df.withColumns({
        n: F.col(lag_name(LAG_DIFFERENCES[n][0])) - F.col(lag_name(LAG_DIFFERENCES[n][1])) for n in names
    })
