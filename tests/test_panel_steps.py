"""Steps that many queries share: how often they shuffle, and their results in odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.catalog import evaluation, modelling
from tidewheel.operators import crosssection as X
from tidewheel.operators.lags import previous_day
from tidewheel.plans.features import FeaturePlan, build_features, model_input
from tidewheel.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_and_lags_take_two_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(previous_day(fx.trades_labelled(spark, SF), [6, 8]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 2


def test_streams_are_aligned_in_place(spark):
    p = plan(evaluation.B.align(evaluation.streams(spark, SF), evaluation.STREAM_NAMES))
    assert "SortMergeJoin" not in p.split("InMemoryRelation")[0]


@pytest.mark.parametrize("chunk", [16, 40])
def test_long_calendars_are_cut_into_chunks(spark, monkeypatch, chunk):
    cols = ["symbol_id", "date_id", "time_id", "responder_3", "responder_6", "responder_8"]
    want = fx.trades_labelled(spark, SF).select(*cols).toPandas().sort_values(cols[:3]).reset_index(drop=True)
    monkeypatch.setattr(fx, "CHUNK_ROWS", chunk)
    cut = fx.trades_labelled(spark, SF)
    assert "_chunk" in plan(cut)
    got = cut.select(*cols).toPandas().sort_values(cols[:3]).reset_index(drop=True)
    assert ((got - want).abs().fillna(0).to_numpy() < 1e-9).all() and (got.isna() == want.isna()).all().all()


def test_previous_day_of_odd_keys(spark):
    rows = [(1, 0, 0, 1.0), (1, 1, 0, 2.0), (1, 3, 0, 4.0), (1, 2, 1, 9.0), (None, 0, 0, 5.0), (None, 1, 0, 6.0), (2, None, 0, 7.0), (2, 0, 0, None),
            (2, 1, 0, 8.0), (3, 0, None, 1.0), (3, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "symbol_id long, date_id int, time_id int, responder_6 double")
    key = lambda r: (r.symbol_id, r.date_id, r.time_id, r.responder_6, r.responder_6_lag1d)
    assert sorted(map(str, map(key, previous_day(df, [6]).collect()))) == sorted(map(str, map(key, previous_day(df, [6], df).collect())))


def test_screens_read_kept_columns(spark):
    spark.catalog.clearCache()
    modelling.combo_accept(spark, SF)
    kept = fx.trades_labelled(spark, SF).select(*modelling._CORE, "responder_8")
    assert kept.storageLevel.useMemory
    spark.catalog.clearCache()


def test_ranked_steps_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_ROWS", 100)
    df = spark.range(2400).select((F.col("id") % 40).alias("symbol_id"), F.floor(F.col("id") / 480).cast("int").alias("date_id"),
                                  (F.floor(F.col("id") / 40) % 12).cast("int").alias("time_id"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    for ranked in (X.rank_average(df, ["x"]), X.rank_unit(df, ["x"])):
        steps = ranked.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("date_id", "time_id").alias("n"))
        assert steps.agg(F.sum("n")).first()[0] == 60 and steps.agg(F.max("n")).first()[0] <= 10


def test_features_along_whole_symbols_take_one_shuffle_by_symbol(spark):
    panel = fx.trades_labelled(spark, SF).persist()
    cols = [f"feature_{i:02d}" for i in range(6)]

    def build(symbol_rows):
        p = FeaturePlan(raw=cols, rolled=cols, rolling_rows=48, min_date=None, lagged=list(range(9)), differences=True, realized=True,
                        extra=["rank_per_time", "ewma_per_symbol"], symbol_rows=symbol_rows)
        return model_input(build_features(panel, p), p, ["symbol_id", "date_id", "time_id"])

    short = build(fx.trades_steps(spark, SF))
    along = plan(short).split("InMemoryTableScan")[0]
    assert "SortMergeJoin" not in along and along.count("Exchange hashpartitioning(symbol_id") == 1
    a, b = (d.toPandas().sort_values(["symbol_id", "date_id", "time_id"]).to_numpy(dtype=float) for d in (short, build(None)))
    assert a.shape == b.shape and np.allclose(a, b, rtol=1e-5, atol=1e-6, equal_nan=True)
    panel.unpersist()


def test_feature_builder_copies_no_margins(spark):
    """Symbols that a task holds are shuffled once and whole, not cut into chunks with copied dates beside them."""
    from tidewheel.catalog import windows
    spark.catalog.clearCache()
    along = plan(windows.feature_builder(spark, SF)).split("InMemoryTableScan")[0]
    assert "_chunk" not in along and along.count("Exchange hashpartitioning(symbol_id") == 1
    spark.catalog.clearCache()


def test_causality_probe_makes_the_panel_once(spark):
    spark.catalog.clearCache()
    probe = evaluation.causality_probe(spark, SF)
    assert fx.trades(spark, SF).select("symbol_id", "date_id", "time_id", "feature_00", "feature_02").storageLevel.useMemory
    assert all(r["max_abs_delta"] < 1e-9 and r["n_one_sided"] == 0 and r["n_cells"] > 0 for r in probe.collect())
    spark.catalog.clearCache()


def test_boosted_trees_stop_by_patience_only(spark, monkeypatch):
    """As many rounds as the validation error asks for, of a bound of a thousand, and the trees of one long fit."""
    asked = {}
    monkeypatch.setattr(modelling.M, "fit_eval", lambda *a, **kw: asked.update(kw) or (a[2].withColumn("pred", F.lit(0.0)), None))
    modelling.boosted_trees(spark, SF)
    assert asked == {"early_stop": True, "max_iter": 1000, "depth": 6}
    monkeypatch.undo()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    table = spark.createDataFrame([(i, *map(float, v), float(np.sin(3 * v[0]) + 0.5 * rng.normal()), 1.0) for i, v in enumerate(x)], "i long, a double, b double, y double, w double")
    train, valid = table.where("i < 300"), table.where("i >= 300")
    how = {"depth": 2, "step": 0.3}
    preds, _ = modelling.M.fit_eval("boosted_trees", train, valid, ["a", "b"], early_stop=True, max_iter=14, patience=3, **how)
    long = modelling.M.fit("boosted_trees", train, ["a", "b"], max_iter=14, **how)
    errors = long.stages[-1].evaluateEachIteration(long.stages[0].transform(valid), "squared")
    best, _ = modelling.M.best_round(errors, 3)
    assert best > 4  # the earlier bound
    want = modelling.M.predict(modelling.M._first_rounds(long, best), valid, ["a", "b"])
    both = preds.select("i", "pred").join(want.select("i", F.col("pred").alias("want")), "i")
    assert both.count() == 100 and both.where("abs(pred - want) > 1e-12").isEmpty()
    error = both.join(valid, "i").agg(F.avg((F.col("pred") - F.col("y")) ** 2)).first()[0]
    assert abs(error - errors[best - 1]) < 1e-9


def test_best_round_waits_for_patience():
    assert modelling.M.best_round([5, 4, 4.5, 3, 3.5, 3.6, 2], 2) == (4, True)
    assert modelling.M.best_round([5, 4, 4.5, 3, 3.5, 3.6, 2], 3) == (7, False)
