"""Cross-sectional operators over all symbols of one (date, time)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.names import STEP, SYMBOL, market_avg, rank_name
from tidewheel.session import pin

# A cross-section up to this many symbols is ranked by one sort per step.
WINDOW_ROWS = 2_000_000
# A task that ranks holds whole steps, of about so many rows together.
TASK_ROWS = 100_000
# Means of steps up to so many bytes are sent to all tasks.
SMALL_MEANS = 64 << 20
# A larger one is cut into so many pieces, at points of a sample of so many rows a piece.
PIECES, POINTS = 64, 16


def step_means(df: DataFrame, cols: Iterable[str], prefix: str = "_mkt_") -> DataFrame:
    """Mean per (date, time): pre-aggregated, one row per step."""
    return df.groupBy(*STEP).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in cols])


def market_average(df: DataFrame, cols: Iterable[str], source: DataFrame | None = None, measured: bool = False) -> DataFrame:
    """Adds the null-ignoring mean over symbols of each (date, time).

    ``source`` has the same rows as ``df`` but is cheaper to aggregate.
    ``measured`` stores the means first, so that small ones meet the rows in
    place: a plan made before they are counted shuffles ``df``.

    Aggregate then join: the aggregate combines map-side, and an oversized
    step is split by the skew-join rule, which a window would not be.
    """
    cols = list(cols)
    means = step_means(df if source is None else source, cols)
    if measured:
        means = pin(means)
        if means.count() * 8 * (len(STEP) + len(cols)) <= SMALL_MEANS:
            means = F.broadcast(means)
    out = df.join(means, STEP)
    return out.withColumnsRenamed({f"_mkt_{c}": market_avg(c) for c in cols})


def market_split(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Market mean and the idiosyncratic rest."""
    cols = list(cols)
    out = df.join(step_means(df, cols), STEP)
    out = out.withColumns({f"{c}_idio": F.col(c) - F.col(f"_mkt_{c}") for c in cols})
    return out.withColumnsRenamed({f"_mkt_{c}": f"{c}_mkt" for c in cols})


def _sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all."""
    largest, rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return largest or 0, rows or 0


def _measured(df: DataFrame, by: list[str]) -> tuple[str, DataFrame]:
    """How to rank, and the rows dealt so that no task gets many groups at once."""
    largest, rows = _sizes(df, by)
    if largest > WINDOW_ROWS:
        return "split", df
    return "window", df.repartitionByRange(-(-rows // TASK_ROWS), *by) if rows > TASK_ROWS else df


def values_below(df: DataFrame, by: list[str], col: str, pieces: int = 64) -> DataFrame:
    """(by, value) -> how many rows of the group lie below, and share, the value.

    For groups too large for one task: equal values are counted first, each
    group is cut at sampled quantiles, and running counts are taken per piece.
    The cut points are checkpointed, so both uses below see the same ones.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_same"))
    points = [i / pieces for i in range(1, pieces)]
    cuts = pin(counts.groupBy(*by).agg(F.percentile_approx(col, points, 10000).alias("_cuts")))
    placed = (counts.join(cuts, by)
              .withColumn("_piece", F.size(F.filter("_cuts", lambda q: q <= F.col(col)))).drop("_cuts"))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = (placed.groupBy(*by, "_piece").agg(F.sum("_same").alias("_n"))
            .withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*by, "_piece").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(base, [*by, "_piece"])
            .withColumn("_below", F.col("_base") + F.coalesce(F.sum("_same").over(inside), F.lit(0)))
            .select(*by, col, "_below", "_same"))


def _alongside(df: DataFrame, per_group: DataFrame, by: list[str]) -> DataFrame:
    """Columns of a table with one row per group, whose keys are named ``_by_*``; missing keys are a group too."""
    same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return df.join(per_group, same).drop(*[f"_by_{b}" for b in by])


def _cut_points(df: DataFrame, by: list[str], place: dict[str, Column], whole: int) -> DataFrame:
    """Size and, per column, the places that cut a group into about equal pieces.

    They come from a sample of each group's symbols; any points give the same
    ranks.  Groups of up to ``whole`` rows are not cut.  The table is checkpointed, so every use sees the same points.
    """
    keys = [F.col(b).alias(f"_by_{b}") for b in by]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).select(*keys, "_size")
    narrow = df.select(*by, *[p.alias(f"_place_{i}") for i, p in enumerate(place.values())], F.xxhash64(SYMBOL, *by).alias("_draw"))
    some = _alongside(narrow, sizes.where(F.col("_size") > whole), by).where(F.pmod("_draw", "_size") < PIECES * POINTS)
    sample = some.groupBy(*by).agg(*[F.sort_array(F.collect_list(f"_place_{i}")).alias(f"_all_{i}") for i in range(len(place))])

    def points(ordered: str) -> Column:
        return F.array(*[F.get(ordered, F.floor(F.size(ordered) * (p / PIECES)).cast("int")) for p in range(1, PIECES)])

    cuts = sample.select(*by, *[points(f"_all_{i}").alias(f"_cuts_{i}") for i in range(len(place))])
    same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return pin(sizes.join(cuts, same, "left").drop(*by))


def rank_average(df: DataFrame, cols: Iterable[str], by: list[str] = STEP,
                 method: str = "auto", names: dict[str, str] | None = None) -> DataFrame:
    """Average-tie rank (1..n) among the non-null values of the group.

    ``method``: ``window`` sorts a group in one task, ``split`` spreads it,
    ``auto`` measures the largest group first and deals whole groups evenly:
    a task holds its rows once per column.
    """
    cols = list(cols)
    names = names or {c: rank_name(c) for c in cols}
    if method == "auto":
        method, df = _measured(df, by)
    if method == "window":
        out = {}
        for c in cols:
            w = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())
            ties = F.count(c).over(w.rangeBetween(Window.currentRow, Window.currentRow))
            out[names[c]] = F.when(F.col(c).isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)
        return df.withColumns(out)
    for c in cols:
        df = (df.join(values_below(df, by, c), [*by, c], "left")
              .withColumn(names[c], F.col("_below") + (F.col("_same") + 1) / 2.0)
              .drop("_below", "_same"))
    return df


def rank_unit(df: DataFrame, cols: Iterable[str], by: list[str] = STEP, method: str = "auto",
              suffix: str = "_rank01") -> DataFrame:
    """Ordinal rank scaled to [0, 1]; ties by symbol, missing values count last."""
    cols = list(cols)
    whole = 0 if method == "split" else WINDOW_ROWS // PIECES
    if method == "auto":
        method, df = _measured(df, by)
    if method == "window":
        size = F.count(F.lit(1)).over(Window.partitionBy(*by))
        return df.withColumns({
            f"{c}{suffix}": (F.row_number().over(
                Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last(), SYMBOL)) - 1)
            / F.greatest(size - 1, F.lit(1))
            for c in cols
        })
    # Rows are ordered as the window orders them; a piece is whatever lies between two cut points.
    place = {c: F.struct(F.isnull(c).alias("none"), F.col(c).alias("v"), F.col(SYMBOL).alias("s")) for c in cols}
    cuts = _cut_points(df, by, place, whole)
    for i, c in enumerate(cols):
        df = _alongside(df, cuts.select(*[f"_by_{b}" for b in by], "_size", F.col(f"_cuts_{i}").alias("_cuts")), by)
        df = df.withColumns({"_x": place[c], "_piece": F.lit(0)})
        step = PIECES // 2
        while step:  # how many cut points lie at or below the row
            df = df.withColumn("_piece", F.col("_piece") + F.when(F.get("_cuts", F.col("_piece") + (step - 1)) <= F.col("_x"), step).otherwise(0))
            step //= 2
        df = df.drop("_cuts", "_x")
        earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        before = (df.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
                  .select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_piece").alias("_by__piece"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
        inside = Window.partitionBy(*by, "_piece").orderBy(F.col(c).asc_nulls_last(), SYMBOL)
        df = (_alongside(df, before, [*by, "_piece"])
              .withColumn(f"{c}{suffix}", (F.col("_before") + F.row_number().over(inside) - 1) / F.greatest(F.col("_size") - 1, F.lit(1)))
              .drop("_size", "_piece", "_before"))
    return df
