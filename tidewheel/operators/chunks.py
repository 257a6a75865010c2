"""Row-window operators along a symbol without one task per symbol.

A window ``partitionBy(symbol)`` puts all rows of a symbol into one task, so a
panel of few (or one very long) symbols would not spread.  Here a symbol is cut
into chunks of whole dates of about ``chunk_rows`` rows; dates next to a chunk
are copied into it as a margin, as far as the operator looks back or ahead.
Windows then run per (symbol, chunk), rows of the margin are dropped, and the
result is exactly that of the unsplit window.

The chunk of a date follows from per-date row counts, a table of
symbols x dates, so the panel itself is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewheel.functions.scalars import finite
from tidewheel.names import DATE, SERIES, SYMBOL, TIME

CHUNK_ROWS = 16384


def centre(c: str) -> str:
    """Name of the symbol-mean column of a centred input."""
    return f"_centre_{c}"


def _chunk_map(df: DataFrame, back: int, fwd: int, chunk_rows: int, centred: list[str]) -> DataFrame:
    """(symbol, date) -> every chunk the date belongs to, own or as a margin,
    with the symbol means of the finite values of the centred columns."""
    along = Window.partitionBy(SYMBOL)
    before = along.orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    size = F.lit(chunk_rows)
    sums = [f(finite(c)).alias(f"{p}{c}") for c in centred for p, f in (("_sum_", F.sum), ("_cnt_", F.count))]
    means = [F.try_divide(F.sum(f"_sum_{c}").over(along), F.sum(f"_cnt_{c}").over(along)).alias(centre(c)) for c in centred]
    dates = (df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"), *sums)
             .select(*SERIES, "_n", *means)
             .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .withColumn("_longest", F.max("_n").over(along))
             .withColumn("_home", F.floor(F.col("_start") / size))
             .withColumn("_last", F.max("_home").over(along)))
    # A chunk starts at or after home*size and ends before (home+1)*size plus one date.
    first = F.floor((F.col("_start") - fwd - F.col("_longest")) / size) if fwd else F.col("_home")
    final = F.floor((F.col("_start") + F.col("_n") + back - 1) / size) if back else F.col("_home")
    return (dates
            .withColumn("_chunk", F.explode(F.sequence(
                F.greatest(F.least(first, F.col("_home")), F.lit(0)),
                F.least(F.greatest(final, F.col("_home")), F.col("_last")))))
            .select(*SERIES, "_chunk", (F.col("_chunk") == F.col("_home")).alias("_own"), *[centre(c) for c in centred]))


@dataclass(frozen=True)
class Along:
    """Windows of one chunk: ``order`` by date and time, ``whole`` unordered."""

    order: WindowSpec
    whole: WindowSpec

    @property
    def running(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, 0)


Build = Callable[[DataFrame, Along], DataFrame]


@dataclass(frozen=True)
class Stage:
    """A step along the symbol and how many rows it looks behind / ahead.

    ``centred`` columns come with their symbol mean in ``centre(column)``.
    """

    build: Build
    back: int = 0
    fwd: int = 0
    centred: tuple[str, ...] = ()


def over_symbol(df: DataFrame, *stages: Stage, chunk_rows: int | None = CHUNK_ROWS,
                source: DataFrame | None = None) -> DataFrame:
    """Run stages along each symbol in date and time order, on one shuffle.

    Stages read the input columns, not each other's output: margins cover the
    widest single stage.  ``chunk_rows=None`` uses one plain window per symbol.
    ``source`` has the same keys as ``df`` but is cheaper to count.
    """
    centred = sorted({c for s in stages for c in s.centred})
    if chunk_rows is None:
        whole = Window.partitionBy(SYMBOL)
        df = df.withColumns({centre(c): F.avg(finite(c)).over(whole) for c in centred}) if centred else df
    else:
        chunks = _chunk_map(df if source is None else source, max(s.back for s in stages), max(s.fwd for s in stages),
                            chunk_rows, centred)
        df = df.join(chunks, SERIES)
        whole = Window.partitionBy(SYMBOL, "_chunk")
    along = Along(whole.orderBy(DATE, TIME), whole)
    for s in stages:
        df = s.build(df, along)
    df = df.drop(*[centre(c) for c in centred])
    return df if chunk_rows is None else df.where("_own").drop("_chunk", "_own")


def day_window() -> WindowSpec:
    """Rows of one symbol within one date (at most one day of steps)."""
    return Window.partitionBy(*SERIES).orderBy(TIME)
