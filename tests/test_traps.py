"""Hand-made panels for the semantic traps, and invariants of the metrics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.names import FEATURES, ewma_name, family, is_raw_feature, parse_recipe, rolling_diff, rolling_std
from tidewheel.operators import crosssection as X
from tidewheel.operators import ensemble as B
from tidewheel.operators import evaluate as E
from tidewheel.operators import lags as L
from tidewheel.operators import moments as M
from tidewheel.operators import preprocess as N
from tidewheel.operators import scores as R
from tidewheel.operators import shifts as H
from tidewheel.operators.ewma import ewma
from tidewheel.operators.rolling import rolling_features
from tidewheel.plans.features import FeaturePlan, build_features
from tidewheel.sources import panel as P


def panel(spark, rows, cols):
    kinds = ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, f"symbol_id long, date_id int, time_id int, {kinds}")


def by_key(df, col):
    return {(r["symbol_id"], r["date_id"], r["time_id"]): r[col] for r in df.collect()}


@pytest.fixture(scope="module")
def two_days(spark):
    rows = [(s, d, t, float(100 * s + 10 * d + t)) for s in (1, 2) for d in (0, 1) for t in range(6)]
    return panel(spark, rows, ["responder_8"]).withColumn("responder_6", F.col("responder_8") * 2)


def test_shift_crosses_dates_and_any_gap_gives_zero(two_days):
    out = by_key(H.synthetic_targets(two_days, {"r": ("responder_8", [4])}), "r")
    assert out[(1, 0, 3)] == 103 + 111  # four rows ahead is step 1 of the next date
    assert out[(1, 1, 2)] == 0.0  # nothing four rows ahead: the whole sum is gone


def test_day_sum_keeps_other_terms(two_days):
    out = by_key(two_days.withColumn("r", H.day_forward_sum("responder_8", [4])), "r")
    assert out[(1, 0, 3)] == 103.0  # does not look into the next date, and keeps itself
    back = by_key(two_days.withColumn("r", H.day_backward_shift("responder_8", 2)), "r")
    assert back[(1, 1, 1)] == 0.0 and back[(1, 1, 3)] == 111.0


def test_rolling_null_poisons_exactly_its_windows(spark):
    values = [1.0, 2.0, 4.0, None, 8.0, 9.0, 11.0, 12.0]
    df = panel(spark, [(1, 0, t, v) for t, v in enumerate(values)], ["x"])
    out = rolling_features(df, ["x"], 3)
    std = by_key(out, "x_rolling_std_3")
    assert [std[(1, 0, t)] is None for t in range(8)] == [True, True, False, True, True, True, False, False]
    assert math.isclose(std[(1, 0, 2)], np.std([1, 2, 4], ddof=1))


@pytest.mark.parametrize("method", ["window", "split"])
def test_two_ranks_with_ties_and_nulls(spark, method):
    rows = [(1, 0, 0, 5.0), (2, 0, 0, 5.0), (3, 0, 0, None), (4, 0, 0, 1.0), (5, 0, 0, 9.0), (6, 0, 0, 5.0)]
    df = panel(spark, rows, ["x"])
    avg = by_key(X.rank_average(df, ["x"], method=method), "x_rank_per_time")
    assert [avg[(s, 0, 0)] for s in range(1, 7)] == [3.0, 3.0, None, 1.0, 5.0, 3.0]
    unit = by_key(X.rank_unit(df, ["x"], method=method), "x_rank01")
    assert [unit[(s, 0, 0)] for s in range(1, 7)] == [0.2, 0.4, 1.0, 0.0, 0.8, 0.6]


def test_split_rank_of_a_hot_step(spark):
    """One step holds nearly all rows, a third of them with the same value."""
    df = (spark.range(9000).select(F.col("id").alias("symbol_id"), F.lit(0).alias("date_id"), F.lit(0).alias("time_id"),
                                   F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 1000).cast("double")).alias("x"))
          .unionByName(panel(spark, [(1, 0, 1, 2.0), (2, 0, 1, 1.0)], ["x"])))
    a = X.rank_average(df, ["x"], method="split").select("symbol_id", "time_id", F.col("x_rank_per_time").alias("a"))
    b = X.rank_average(df, ["x"], method="window").select("symbol_id", "time_id", F.col("x_rank_per_time").alias("b"))
    both = a.join(b, ["symbol_id", "time_id"])
    assert both.count() == 9002 and both.where("a <> b").count() == 0


def test_split_unit_rank_is_cut_by_value_and_symbol(spark):
    """Equal values are cut by symbol, rows without a step are a group, and no table of values is joined."""
    df = (spark.range(9000).select(F.col("id").alias("symbol_id"), F.when(F.col("id") % 100 > 0, 0).alias("date_id"), F.lit(0).alias("time_id"),
                                   F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 7 > 0, F.col("id") * 7919 % 1000 / 1.0).alias("x"))
          .unionByName(panel(spark, [(1, 0, 1, 2.0), (2, 0, 1, 1.0), (3, 0, 1, math.nan), (4, 0, 1, None)], ["x"])))
    split, window = X.rank_unit(df, ["x"], method="split"), X.rank_unit(df, ["x"], method="window")
    assert split.columns == window.columns
    key = ["symbol_id", "date_id", "time_id", "x_rank01"]
    assert sorted(split.select(*key).collect(), key=str) == sorted(window.select(*key).collect(), key=str)
    assert X._cut_points(df, ["date_id", "time_id"], {"x": F.struct("x", "symbol_id")}, 0).where("_by_date_id = 0 AND size(array_distinct(_cuts_0)) = 63").count() == 1


def test_previous_day_is_date_minus_one(spark):
    df = panel(spark, [(1, d, t, float(10 * d + t)) for d in (0, 1, 3) for t in range(4)], ["responder_6"])
    lag = by_key(L.previous_day(df, [6]), "responder_6_lag1d")
    assert lag[(1, 1, 2)] == 2.0
    assert lag[(1, 3, 2)] == 0.0  # date 2 is missing: date 1 is not yesterday
    wide = L.day_lags_wide(df, ["responder_6"], 3)
    assert by_key(wide, "responder_6_lag2")[(1, 3, 1)] == 11.0


def test_guarded_ratio(spark):
    rows = [(1.0, 0.05), (1.0, -0.05), (1.0, 0.0), (1.0, 2.0), (1.0, -0.1)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r[0] for r in df.select(S.combo("div", "a", "b")).collect()] == [10.0, -10.0, 10.0, 0.5, -10.0]
    nulls = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert nulls.select(S.combo("min", "a", "b")).first()[0] is None


def test_standardiser_shares_one_count_and_floors(spark):
    rows = [(1.0, None, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0), (None, 9.0, 5.0)]
    df = panel(spark, [(1, 0, t, *r) for t, r in enumerate(rows)], ["a", "b", "c"])
    daily = {r["feature"]: r for r in M.daily_moments(df, ["a", "b", "c"]).collect()}
    assert daily["a"]["n"] == daily["b"]["n"] == 3.0  # median of 3, 2, 4
    stats = N.fit(df, ["a", "b", "c"], 0)
    assert math.isclose(stats["c"].std, 1e-6)  # constant column: floor inside the root
    out = by_key(N.transform(df, stats), "a")
    assert out[(1, 0, 3)] == 0.0 and math.isclose(by_key(N.transform(df, stats), "c")[(1, 0, 0)], 0.0)


def test_all_null_column_is_zero_after_standardising(spark):
    df = panel(spark, [(1, 0, t, None, float(t)) for t in range(4)], ["a", "b"])
    out = N.transform(df, N.fit(df, ["a", "b"], 0))
    assert set(by_key(out, "a").values()) == {0.0}


def test_merge_equals_one_shot(spark):
    rng = np.random.default_rng(1)
    rows = [(1, d, t, float(rng.normal(d))) for d in range(5) for t in range(20)]
    last = (M.running_moments(M.daily_moments(panel(spark, rows, ["a"]), ["a"])).orderBy(F.desc("date_id")).first())
    x = np.array([r[3] for r in rows])
    assert math.isclose(last["mean"], x.mean()) and math.isclose(last["std"], x.std())


def test_metric_anchors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-2.0, 1.0), (0.5, 3.0)], "y double, w double")
    out = df.withColumns({"zero": F.lit(0.0), "same": F.col("y")}).agg(R.r2_expr(pred="zero"), R.r2_expr(pred="same")).first()
    assert out[0] == 0.0 and out[1] == 1.0


def test_shrinkage_collapses(spark):
    df = spark.createDataFrame([(3.0, 2.0), (-9.0, 1.0), (50.0, 2.0), (0.0, 0.0)], "num double, den double")
    got = [r[0] for r in df.select(B.shrunk_alpha(F.col("num"), F.col("den"))).collect()]
    assert np.allclose(got, [(1.5 + 3) / 4, 0.0, 1.5, 1.0])


def _stream(spark, preds):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(40):
        y = float(rng.normal())
        rows += [(n, t % 2, t // 20, t, y, 1.0, f(y, rng)) for n, f in preds.items()]
    return spark.createDataFrame(rows, "stream string, symbol_id long, date_id int, time_id int, y double, w double, pred double")


def test_blend_of_identical_streams_is_the_stream(spark):
    s = _stream(spark, {"a": lambda y, r: 0.3 * y, "b": lambda y, r: 0.3 * y})
    got = by_key(B.blend(s, ["a", "b"], "m"), "pred")
    assert all(math.isclose(got[k], v) for k, v in by_key(s.where("stream = 'a'"), "pred").items())
    both = B.blends(s, {"m": ["a", "b"], "one": ["a"]})
    assert both.count() == 80 and by_key(both.where("stream = 'm'"), "pred").keys() == got.keys()


def test_opposite_streams_cancel_and_correlate_minus_one(spark):
    s = _stream(spark, {"a": lambda y, r: y, "b": lambda y, r: -y})
    assert set(by_key(B.blend(s, ["a", "b"], "m"), "pred").values()) == {0.0}
    assert math.isclose(B.pairwise(s, ["a", "b"]).first()["corr"], -1.0)


def test_simplex_keeps_the_good_stream(spark):
    s = _stream(spark, {"good": lambda y, r: 0.9 * y, "bad": lambda y, r: float(r.normal())})
    wide = B.align(s, ["good", "bad"])
    w = B.simplex_weights(wide, ["good", "bad"], F.col("date_id") == 0)
    assert math.isclose(w.sum(), 1.0) and (w >= 0).all() and w[0] > 0.9
    assert B.simplex_weights(wide, ["good", "bad"], F.lit(False)).tolist() == [0.5, 0.5]


def test_market_parts_sum_to_input(two_days):
    out = X.market_split(two_days, ["responder_8"])
    bad = out.where(F.abs(F.col("responder_8_mkt") + F.col("responder_8_idio") - F.col("responder_8")) > 1e-12)
    assert bad.count() == 0


def test_slate_and_constant_panel(spark):
    from tidewheel.streaming.daily import constant_panel
    rows = [(1, 0, t, 1.0) for t in range(5)] + [(2, 0, t, 1.0) for t in range(2, 5)]
    df = panel(spark, rows, ["responder_6"]).withColumn("weight", F.lit(1.0))
    grid = P.complete_grid(df, 0, 0, 5)
    assert grid.count() == 10 and grid.where("weight = 0").count() == 2
    # Rows beyond the given calendar or day length widen the slate.
    late = df.union(panel(spark, [(2, 3, 6, 1.0)], ["responder_6"]).withColumn("weight", F.lit(1.0)).select(*df.columns))
    wide = P.complete_grid(late, 0, 0, 5)
    assert wide.count() == 2 * 4 * 7 and wide.agg(F.sum("weight")).first()[0] == 9.0
    assert P.complete_grid(late, None, None, 5).count() == 2 * 4 * 7 and P.complete_grid(df.limit(0), None, None, 5).count() == 0
    assert [r["symbol_id"] for r in constant_panel(df, df).collect()] == [1]


def test_recipe_names():
    plan = FeaturePlan(lagged=list(range(9)), differences=True)
    assert len(FeaturePlan().columns()) == 125
    assert len(FeaturePlan(lagged=list(range(9))).columns()) == 134 and len(plan.columns()) == 139
    rec = parse_recipe(plan.columns())
    assert rec.rows == 1000 and rec.lagged == list(range(9)) and len(rec.rolled) == 16 and rec.time
    assert family("feature_06_ewma_30") == "ewma" and family("rsig_momA_med") == "rsig"
    assert sum(is_raw_feature(c) for c in FEATURES) == 76
    with pytest.raises(ValueError):
        parse_recipe(["feature_01_rolling_std_10", "feature_01_rolling_std_20"])


def test_nothing_but_labels_looks_ahead(spark):
    rng = np.random.default_rng(5)
    rows = [(s, d, t, *map(float, rng.normal(size=3))) for s in range(4) for d in range(6) for t in range(8)]
    df = panel(spark, rows, ["feature_06", "responder_6", "responder_8"])
    plan = FeaturePlan(raw=["feature_06"], rolled=["feature_06"], rolling_rows=5, min_date=None, lagged=[6, 8],
                       extra=["rank_per_time", "ewma_per_symbol"], chunk_rows=10)
    probe = E.causality_probe(df, lambda p: build_features(p, plan), ["feature_06", "responder_6", "responder_8"],
                              [*plan.columns(), "responder_9"], 4)
    moved = {r["block"] for r in probe.collect() if r["max_abs_delta"] > 0 or r["n_one_sided"] > 0}
    assert moved == {"responder_9"}  # the forward target, and it alone, sees later rows


def test_alignment_assertion(spark, two_days):
    a = two_days.withColumnsRenamed({"responder_8": "y"}).withColumn("w", F.lit(1.0))
    E.require_aligned(a, a)
    with pytest.raises(ValueError):
        E.require_aligned(a, a.where("time_id > 0"))


def test_quantiles_with_nan_and_tiny_ranges(spark):
    from tidewheel.operators.quantiles import exact_quantiles

    rows = [(1.0, 5e-324), (2.0, 0.0), (float("nan"), 1e-323), (4.0, None), (float("inf"), float("-inf"))]
    got = exact_quantiles(spark.createDataFrame(rows, "x double, y double"), {"x": [0.0, 0.5, 1.0], "y": [0.0, 0.5, 1.0]})
    assert got == {"x": [1.0, 2.0, 4.0], "y": [0.0, 5e-324, 1e-323]}


@pytest.mark.parametrize("rows", [6, 48])
def test_rolling_takes_nan_as_missing(spark, rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    x[70], x[130] = float("nan"), float("inf")
    df = panel(spark, [(1, t // 50, t % 50, float(v)) for t, v in enumerate(x)], ["a"])
    got = rolling_features(df, ["a"], rows, chunk_rows=60).orderBy("date_id", "time_id").toPandas()
    clean = pd.Series(np.where(np.isfinite(x), x, np.nan))
    mean, std = clean.rolling(rows).mean(), clean.rolling(rows).std()
    assert np.allclose(got[rolling_std("a", rows)].astype(float), std, equal_nan=True)
    assert np.allclose(got[rolling_diff("a", rows)].astype(float), clean - mean, equal_nan=True)


@pytest.mark.parametrize(("steps", "span"), [(20_000, 30), (968, 2), (20_000, 2), (50, 1000)])
def test_ewma_of_long_days_and_short_spans(spark, steps, span):
    rng = np.random.default_rng(4)
    x = rng.normal(size=2 * steps)
    x[[0, 7, steps + 3]] = float("nan"), float("inf"), float("nan")
    rows = spark.createDataFrame(pd.DataFrame({"symbol_id": 1, "date_id": np.arange(2 * steps) // steps, "time_id": np.arange(2 * steps) % steps, "a": x}))
    got = ewma(rows, ["a"], span).orderBy("date_id", "time_id").toPandas()[ewma_name("a", span)].to_numpy(dtype=float)
    q, state, want = 1 - 2 / (span + 1), None, []
    for v in x:
        if np.isfinite(v):
            state = v if state is None else q * state + (1 - q) * v
        want.append(np.nan if state is None else state)
    assert np.allclose(got, want, equal_nan=True, atol=1e-9)
