"""Feature, combo and channel selection."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.scalars import COMBOS, combo, combo_name, finite, zero_fill
from tidewheel.names import DATE, SYMBOL, TIME
from tidewheel.operators.correlation import column_correlation
from tidewheel.operators.evaluate import contiguous_folds
from tidewheel.operators.moments import gram, gram_matrix, target_correlations
from tidewheel.operators.shifts import day_lags
from tidewheel.operators.structure import increment_stats

AGG_COLUMNS = 200  # correlation expressions per job


def above_correlation(corrs: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Drop features whose |corr| with the target is at most the floor."""
    return corrs.where(F.abs("corr") > floor)


def fold_top_k(scores: DataFrame, k: int) -> DataFrame:
    """Best k features per fold by score; ties by name."""
    w = Window.partitionBy("fold").orderBy(F.desc("score"), "feature")
    return scores.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def consistent(scores: DataFrame, k: int, min_folds: int) -> DataFrame:
    """(feature, n_folds) of features in the top k of at least min_folds folds."""
    return (fold_top_k(scores, k).groupBy("feature").agg(F.count(F.lit(1)).alias("n_folds"))
            .where(F.col("n_folds") >= min_folds))


def fold_correlation_scores(df: DataFrame, cols: list[str], target: str, lo: int, hi: int, n_folds: int) -> DataFrame:
    """(fold, feature, score): |corr| with the target in each contiguous fold."""
    folds = contiguous_folds(df, lo, hi, n_folds)
    wide = folds.groupBy("fold").agg(*[F.abs(F.corr(c, target)).alias(c) for c in cols])
    return wide.select("fold", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("score")) for c in cols])).alias("_r")
    ).select("fold", "_r.*")


# -- combos ----------------------------------------------------------------

def combo_candidates(core: list[str]) -> list[tuple[str, str, str]]:
    return [(op, a, b) for a, b in combinations(core, 2) for op in COMBOS]


def combo_screen(df: DataFrame, core: list[str], target: str) -> DataFrame:
    """(label, op, a, b, corr, best_parent) of combos that beat both parents.

    Candidates are correlated with the target in batches of one aggregate, which
    holds their parents too: a combo that equals a parent row by row (the larger
    of two columns that never cross) then has the parent's very bits and does
    not beat it by the order of a sum.
    """
    parts = None
    cands = combo_candidates(core)
    for at in range(0, len(cands), AGG_COLUMNS):
        chunk = cands[at:at + AGG_COLUMNS]
        spot = {p: i for i, p in enumerate(sorted({p for _, *ab in chunk for p in ab}))}
        wide = df.agg(*[F.corr(combo(op, a, b), F.col(target)).alias(f"_{i}") for i, (op, a, b) in enumerate(chunk)],
                      *[F.corr(p, target).alias(f"_p{i}") for p, i in spot.items()])
        own = {p: F.abs(F.coalesce(F.col(f"_p{i}"), F.lit(0.0))) for p, i in spot.items()}
        part = wide.select(F.explode(F.array(*[
            F.struct(F.lit(combo_name(op, a, b)).alias("label"), F.lit(op).alias("op"), F.lit(a).alias("a"),
                     F.lit(b).alias("b"), F.coalesce(F.col(f"_{i}"), F.lit(0.0)).alias("corr"), F.greatest(own[a], own[b]).alias("best_parent"))
            for i, (op, a, b) in enumerate(chunk)])).alias("_r")).select("_r.*")
        parts = part if parts is None else parts.unionByName(part)
    return parts.where(F.abs("corr") > F.col("best_parent"))


def accept_combos(df: DataFrame, ranked: list[tuple[str, str, str]], keep: int, cap: float,
                  batch: int = 64) -> list[tuple[str, str, str]]:
    """Best-first pick with |corr| to earlier picks and to both parents <= cap.

    Every candidate is eventually weighed: each batch needs one correlation
    matrix of the batch, the picks so far and the parents.
    """
    picked: list[tuple[str, str, str]] = []
    for at in range(0, len(ranked), batch):
        if len(picked) >= keep:
            break
        chunk = ranked[at:at + batch]
        items = picked + chunk
        parents = sorted({p for _, a, b in items for p in (a, b)})
        named = {combo_name(*c): combo(*c) for c in items}
        cols = [f"_k{i}" for i in range(len(named))]
        table = df.select(*parents, *[e.alias(c) for c, e in zip(cols, named.values())])
        corr = np.abs(column_correlation(table, parents + cols))
        spot = {p: i for i, p in enumerate(parents)} | {n: len(parents) + i for i, n in enumerate(named)}
        flat = set()
        spread = table.agg(*[F.stddev_pop(zero_fill(c)).alias(c) for c in cols]).first()
        flat = {n for n, c in zip(named, cols) if (spread[c] or 0.0) < 1e-9}
        for op, a, b in chunk:
            name = combo_name(op, a, b)
            if len(picked) >= keep or name in flat:
                continue
            rivals = [combo_name(*p) for p in picked] + [a, b]
            if all(corr[spot[name], spot[r]] <= cap for r in rivals):
                picked.append((op, a, b))
    return picked


# -- channels --------------------------------------------------------------

def channel_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """z(|corr|) + z(log1p increment variance)/2 + |increment autocorr|/4."""
    t = df.where(finite(target).isNotNull())
    table = (target_correlations(t, cols, target).select("feature", F.abs("corr").alias("abs_corr"))
             .join(increment_stats(df, cols), "feature")
             .withColumn("_lv", F.log1p("returns_var")))
    every = Window.partitionBy()  # one row per feature

    def z(c: str):
        return (F.col(c) - F.avg(c).over(every)) / (F.stddev_pop(c).over(every) + 1e-12)

    return (table.withColumn("score", z("abs_corr") + 0.5 * z("_lv") + 0.25 * F.abs("autocorr_lag1"))
            .drop("_lv"))


def greedy_pick(names: list[str], corr: np.ndarray, k: int, cap: float) -> list[str]:
    """Take names in order unless |corr| with a taken one exceeds the cap."""
    taken: list[int] = []
    for i in range(len(names)):
        if len(taken) >= k:
            break
        if all(abs(corr[i, j]) <= cap for j in taken):
            taken.append(i)
    return [names[i] for i in taken]


def pick_channels(df: DataFrame, scores: DataFrame, k: int, cap: float, score: str = "score") -> list[str]:
    """Best-scored columns, skipping those too close to an earlier pick."""
    names = [r["feature"] for r in scores.where(F.col(score).isNotNull()).orderBy(F.desc(score), "feature").collect()]
    return greedy_pick(names, column_correlation(df, names), k, cap)


def ar_holdout(df: DataFrame, col: str, target: str, p: int = 7, increments: bool = False, ma: int = 0,
               train_frac: float = 0.7, alpha: float = 1e-2, min_rows: int = 200) -> float | None:
    """Hold-out R2 of a ridge on p within-day lags of a column.

    Rows are ordered (symbol, date, time); the first ``train_frac`` fit, the
    rest score.  The order is resolved from per-series counts, so no global
    sort takes place; fit and score are two Gram tables.  ``ma`` adds lags of
    the target over the same row order.
    """
    lags = [f"lag_{i}" for i in range(1, p + 1)]
    rows = day_lags(df, col, p, increments)
    rows = rows.where(finite(target).isNotNull())
    for c in lags:
        rows = rows.where(finite(c).isNotNull())
    rows = ordered_rows(rows.select(SYMBOL, DATE, TIME, target, *lags))
    cols = list(lags)
    if ma > 0:
        past = rows.select("_row", target)
        moved = past.select(F.explode(F.sequence(F.lit(1), F.lit(ma))).alias("_k"), "*").select(
            (F.col("_row") + F.col("_k")).alias("_row"), "_k", F.col(target).alias("_y"))
        wide = moved.groupBy("_row").agg(*[F.max(F.when(F.col("_k") == i, F.col("_y"))).alias(f"ma_{i}") for i in range(1, ma + 1)])
        cols += [f"ma_{i}" for i in range(1, ma + 1)]
        rows = rows.join(wide, "_row", "left").fillna(0.0, cols[p:])
    n = rows.count()
    if n < max(min_rows, ma + 100):
        return None
    n_train = int(train_frac * n)
    table = rows.select((F.col("_row") < n_train).alias("_train"), F.lit(1.0).alias("_one"), F.col(target).alias("_y"), *cols)
    full = gram(table, ["_one", "_y", *cols], by=["_train"])
    k = len(cols)
    g = gram_matrix(full.where("_train"), k + 2)
    h = gram_matrix(full.where("NOT _train"), k + 2)
    n_tr, n_te = g[0, 0], h[0, 0]
    mu = g[0, 2:] / n_tr
    y_mean = g[0, 1] / n_tr
    cov = g[2:, 2:] - n_tr * np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(cov) / n_tr, 0.0)) + 1e-12
    w = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(k), (g[1, 2:] - n_tr * mu * y_mean) / sd) / sd
    # Residual is y - y_mean - (x - mu).w = y - c - x.w; its square sum is a Gram form.
    v = np.concatenate([[-(y_mean - mu @ w)], [1.0], -w])
    ss_res = float(v @ h @ v)
    ss_tot = float(h[1, 1] - h[0, 1] ** 2 / n_te) + 1e-12
    return 1.0 - ss_res / ss_tot


def ordered_rows(df: DataFrame) -> DataFrame:
    """Adds ``_row``, the 0-based position in (symbol, date, time) order.

    Offsets come from counts per series, per symbol and per range of 65536
    symbol ids; only the last, tiny level is summed in a single window.
    """
    series = df.groupBy(SYMBOL, DATE).agg(F.count(F.lit(1)).alias("_n"))
    symbols = (series.groupBy(SYMBOL).agg(F.sum("_n").alias("_m"))
               .withColumn("_range", F.floor(F.col(SYMBOL) / 65536)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (symbols.groupBy("_range").agg(F.sum("_m").alias("_m"))
              .select("_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start")))
    ahead = Window.partitionBy("_range").orderBy(SYMBOL).rowsBetween(Window.unboundedPreceding, -1)
    symbols = (symbols.withColumn("_base", F.coalesce(F.sum("_m").over(ahead), F.lit(0)))
               .join(ranges, "_range").select(SYMBOL, (F.col("_base") + F.col("_start")).alias("_base")))
    inside = Window.partitionBy(SYMBOL).orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    series = (series.withColumn("_off", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
              .join(symbols, SYMBOL).select(SYMBOL, DATE, (F.col("_base") + F.col("_off")).alias("_base")))
    at = Window.partitionBy(SYMBOL, DATE).orderBy(TIME)
    return (df.join(series, [SYMBOL, DATE])
            .withColumn("_row", F.col("_base") + F.row_number().over(at) - 1).drop("_base"))


def ar_channel_scores(df: DataFrame, cols: list[str], target: str, p: int = 7, ma: int = 0, min_rows: int = 200) -> DataFrame:
    """(feature, r2_levels, r2_increments, r2_max) per column."""
    out = []
    for c in cols:
        lv = ar_holdout(df, c, target, p, False, ma, min_rows=min_rows)
        inc = ar_holdout(df, c, target, p, True, ma, min_rows=min_rows)
        out.append((c, lv, inc, max(lv, inc) if lv is not None and inc is not None else None))
    return df.sparkSession.createDataFrame(out, "feature string, r2_levels double, r2_increments double, r2_max double")
