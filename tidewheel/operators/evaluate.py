"""Date splits, resampling, alignment checks and leakage probes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.scalars import clip
from tidewheel.names import DATE, KEYS, SYMBOL, TIME, family
from tidewheel.operators.quantiles import order_statistics
from tidewheel.sources.panel import ranked_dates


def expanding_splits(df: DataFrame, n_splits: int = 2, test_size: int = 200, gap: int = 0,
                     max_train: int | None = None) -> DataFrame:
    """(fold, date_id, role): expanding train window, then ``test_size`` dates.

    The test size shrinks to n/(splits+1) when the calendar is too short;
    folds without training dates are left out.
    """
    d = ranked_dates(df)
    n = F.col("n_dates")
    size = F.when(n > test_size * (n_splits + 1), F.lit(test_size)).otherwise(F.floor(n / (n_splits + 1)))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("_size", size)
    end = n - (n_splits - 1 - F.col("fold")) * F.col("_size")
    d = d.withColumn("_v0", end - F.col("_size")).withColumn("_v1", end).withColumn("_t1", F.col("_v0") - gap)
    at = F.col("date_rank") - 1
    start = F.greatest(F.col("_t1") - max_train, F.lit(0)) if max_train else F.lit(0)
    role = F.when((at >= start) & (at < F.col("_t1")), "train").when((at >= F.col("_v0")) & (at < F.col("_v1")), "valid")
    return d.where(F.col("_t1") > 0).select("fold", DATE, role.alias("role")).where("role IS NOT NULL")


def purged_folds(df: DataFrame, n_groups: int = 6, embargo: int = 1) -> DataFrame:
    """(fold, date_id, role) for contiguous date groups; dates within
    ``embargo`` of the validation group, on either side, are neither role."""
    d = ranked_dates(df).withColumn("_g", F.floor((F.col("date_rank") - 1) * n_groups / F.col("n_dates")))
    span = d.groupBy(F.col("_g").alias("fold")).agg(F.min("date_rank").alias("_lo"), F.max("date_rank").alias("_hi"))
    # n_groups bounds beside each date: the fold numbers are generated, then matched.
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)).cast("array<bigint>")))
    d = d.join(span, "fold")
    r = F.col("date_rank")
    role = (F.when(F.col("_g") == F.col("fold"), "valid")
            .when((r < F.col("_lo") - embargo) | (r > F.col("_hi") + embargo), "train"))
    return d.select(F.col("fold").cast("int").alias("fold"), DATE, role.alias("role")).where("role IS NOT NULL")


def contiguous_folds(df: DataFrame, lo: int, hi: int, n_folds: int) -> DataFrame:
    """Rows of [lo, hi] with their equal-width date fold 0..n_folds-1."""
    bounds = [lo + (i * (hi + 1 - lo)) // n_folds for i in range(n_folds + 1)]
    fold = F.lit(0)
    for i, b in enumerate(bounds[1:-1], start=1):
        fold = F.when(F.col(DATE) >= b, F.lit(i)).otherwise(fold)
    return df.where(F.col(DATE).between(lo, hi)).withColumn("fold", fold)


def embargoed_train(df: DataFrame, valid_lo: int, embargo: int, pool_hi: int, train_until: int) -> DataFrame:
    """Training rows ending ``embargo`` dates before validation."""
    return df.where(F.col(DATE) <= min(pool_hi, train_until, valid_lo - 1 - embargo))


def _draw_hash(seed: int, what: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), what.cast("string")))


def date_subsample(df: DataFrame, seed: int, frac: float = 0.63) -> DataFrame:
    """Dates drawn without replacement: the first round(frac*n) in hash order."""
    d = ranked_dates(df).withColumn("_h", _draw_hash(seed, F.col(DATE)))
    w = Window.orderBy("_h", DATE)
    return (d.withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= F.greatest(F.round(F.lit(frac) * F.col("n_dates")), F.lit(1)))
            .select(DATE))


def date_bootstrap(df: DataFrame, seed: int) -> DataFrame:
    """(occurrence, date_id): n dates drawn with replacement."""
    d = ranked_dates(df)
    draws = (d.select((F.col("date_rank") - 1).alias("occurrence"), "n_dates")
             .withColumn("_h", F.conv(F.substring(_draw_hash(seed, F.col("occurrence")), 1, 8), 16, 10).cast("long"))
             .select("occurrence", (F.col("_h") % F.col("n_dates") + 1).alias("date_rank")))
    return draws.join(d.select(DATE, "date_rank"), "date_rank").select("occurrence", DATE)


def half_split(df: DataFrame) -> Column:
    """Predicate for the first half of the rows in (date, time, symbol) order.

    The boundary row is found level by level: the date from date counts, the
    time from the counts of that date, the symbol by rank inside that step.
    """
    dates = [(r[DATE], r["n"]) for r in df.groupBy(DATE).agg(F.count(F.lit(1)).alias("n")).orderBy(DATE).collect()]
    left = sum(n for _, n in dates) // 2

    def cross(counts: list[tuple[int, int]]) -> int:
        nonlocal left
        for value, n in counts:
            if left < n:
                return value
            left -= n
        raise ValueError("no rows to split")

    date = cross(dates)
    day = df.where(F.col(DATE) == date)
    time = cross([(r[TIME], r["n"]) for r in day.groupBy(TIME).agg(F.count(F.lit(1)).alias("n")).orderBy(TIME).collect()])
    symbol = order_statistics(day.where(F.col(TIME) == time), {SYMBOL: [left]})[(SYMBOL, left)]
    step = F.struct(DATE, TIME, SYMBOL)
    return step < F.struct(F.lit(date), F.lit(time), F.lit(int(symbol)).cast("long"))


# -- assertions ------------------------------------------------------------

def misaligned(a: DataFrame, b: DataFrame, cols: Iterable[str] = ("y", "w"), tol: float = 2e-3) -> DataFrame:
    """Counts of keys on one side only and of values further apart than tol."""
    cols = list(cols)
    left = a.select(*KEYS, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(True).alias("_ina"))
    right = b.select(*KEYS, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_inb"))
    both = left.join(right, KEYS, "full_outer")

    def hits(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    off = [hits(F.col("_ina") & F.col("_inb") & (
        (F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) > tol) | (F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull())
    )).alias(f"off_{c}") for c in cols]
    return both.agg(F.count(F.lit(1)).alias("n_keys"), hits(F.col("_inb").isNull()).alias("only_left"),
                    hits(F.col("_ina").isNull()).alias("only_right"), *off)


def require_aligned(a: DataFrame, b: DataFrame, cols: Iterable[str] = ("y", "w"), tol: float = 2e-3) -> None:
    r = misaligned(a, b, cols, tol).first().asDict()
    n = r.pop("n_keys")
    if any(r.values()):
        raise ValueError(f"tables are not aligned over {n} keys: {r}")


def block_differences(stored: DataFrame, fresh: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """(block, max_abs_delta, n_one_sided) between stored and recomputed columns."""
    cols = [c for cs in blocks.values() for c in cs]
    pair = (stored.select(*KEYS, *[F.col(c).alias(f"_a_{c}") for c in cols])
            .join(fresh.select(*KEYS, *[F.col(c).alias(f"_b_{c}") for c in cols]), KEYS, "full_outer"))
    return _compare(pair, blocks, "block", None)


def _compare(pair: DataFrame, groups: dict[str, list[str]], label: str, tol: float | None) -> DataFrame:
    def a(c: str) -> Column:
        return F.col(f"_a_{c}")

    def b(c: str) -> Column:
        return F.col(f"_b_{c}")

    def count_of(cond: Column) -> Column:
        return F.coalesce(cond.cast("int"), F.lit(0))

    limit = 0.0 if tol is None else tol
    rows = pair.select(*[F.struct(
        F.greatest(*[F.abs(a(c) - b(c)) for c in cs], F.lit(0.0)).alias("d"),
        sum((count_of(a(c).isNull() != b(c).isNull()) for c in cs), F.lit(0)).alias("one"),
        sum((count_of(a(c).isNull() & b(c).isNull()) for c in cs), F.lit(0)).alias("both"),
        sum((count_of(F.abs(a(c) - b(c)) <= limit) for c in cs), F.lit(0)).alias("near"),
    ).alias(f"_g{i}") for i, cs in enumerate(groups.values())])
    wide = rows.agg(F.count(F.lit(1)).alias("_n"), *[
        e.alias(f"_{p}{i}") for i in range(len(groups)) for p, e in (
            ("d", F.max(f"_g{i}.d")), ("one", F.sum(f"_g{i}.one")), ("both", F.sum(f"_g{i}.both")), ("near", F.sum(f"_g{i}.near")))])
    out = []
    for i, (name, cs) in enumerate(groups.items()):
        n_cells = F.col("_n") * len(cs)
        fields = [F.lit(name).alias(label), F.lit(len(cs)).alias("n_cols"), n_cells.alias("n_cells"),
                  F.col(f"_d{i}").alias("max_abs_delta"), F.col(f"_one{i}").alias("n_one_sided")]
        if tol is not None:
            fields += [F.try_divide(F.col(f"_near{i}") + F.col(f"_both{i}"), n_cells).alias("frac_within_tol"),
                       F.col(f"_both{i}").alias("n_both_missing")]
        out.append(F.struct(*fields))
    return wide.select(F.explode(F.array(*out)).alias("_r")).select("_r.*")


def parity_report(batch: DataFrame, online: DataFrame, cols: list[str], tol: float = 1e-4) -> DataFrame:
    """Largest difference and share of near-equal cells per feature family."""
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(family(c), []).append(c)
    pair = (batch.select(*KEYS, *[F.col(c).alias(f"_a_{c}") for c in cols])
            .join(online.select(*KEYS, *[F.col(c).alias(f"_b_{c}") for c in cols]), KEYS, "full_outer"))
    return _compare(pair, groups, "family", tol)


# -- leakage probes --------------------------------------------------------

def causality_probe(panel: DataFrame, build: Callable[[DataFrame], DataFrame], inputs: list[str], outputs: list[str],
                    from_date: int, bump: float = 1000.0) -> DataFrame:
    """Largest change of each output before ``from_date`` when later inputs move."""
    moved = panel.withColumns({c: F.when(F.col(DATE) >= from_date, F.col(c) + bump).otherwise(F.col(c)) for c in inputs})
    past = F.col(DATE) < from_date
    return block_differences(build(panel).where(past), build(moved).where(past), {c: [c] for c in outputs})


def shifted_one_step(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Features delayed by one step inside the day: a real signal fades, a leak collapses."""
    w = Window.partitionBy(SYMBOL, DATE).orderBy(TIME)
    return df.withColumns({c: F.lag(c).over(w) for c in cols})


def shuffled_days(df: DataFrame, seed: int = 0) -> DataFrame:
    """Time labels of each series permuted, rows otherwise intact."""
    key = F.md5(F.concat_ws("|", F.lit(seed), SYMBOL, DATE, TIME))
    series = Window.partitionBy(SYMBOL, DATE)
    ranked = (df.withColumn("_t", F.sort_array(F.collect_list(TIME).over(series)))
              .withColumn("_r", F.row_number().over(series.orderBy(key))))
    return ranked.withColumn(TIME, F.element_at("_t", F.col("_r"))).drop("_t", "_r")


def too_good(scores: DataFrame, score: str = "r2", ceiling: float = 0.03) -> DataFrame:
    """Flags results above the credible ceiling."""
    return scores.withColumn("suspect", F.col(score) > ceiling)


def clipped(df: DataFrame, col: str = "pred", bound: float = 5.0) -> DataFrame:
    return df.withColumn(col, clip(col, -bound, bound))
