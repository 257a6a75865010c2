"""Streams against their batch twins, late rows and retries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators.evaluate import parity_report
from tidewheel.operators.rolling import rolling_features
from tidewheel.session import scratch_path
from tidewheel.operators.lags import previous_day
from tidewheel.streaming.daily import (DayRoll, active_symbols, feed_labels, late_rows, market_average_stream,
                                       previous_day_stream, roll_days, with_market_average)
from tidewheel.streaming.calibrator import TrailingCalibrator
from tidewheel.streaming import replay as R
from tidewheel.streaming.replay import bounded_ends, read_rounds, run_to_table, write_bounded, write_drop, write_rounds
from tidewheel.streaming.rolling import ENGINES, rolling_stream
from tidewheel.streaming.serve import Server


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(3):
        for d in range(8):
            for t in range(6):
                if s == 2 and d < 3:  # appears later
                    continue
                rows.append((s, d, t, None if rng.random() < 0.05 else float(rng.normal()), 1.0))
    return spark.createDataFrame(rows, "symbol_id long, date_id int, time_id int, feature_06 double, weight double").persist()


@pytest.mark.parametrize("engine", ["buffered", "running"])
def test_rolling_parity_over_several_batches(spark, panel, engine):
    path = scratch_path(spark, "replay")
    write_rounds(panel.where("date_id >= 2"), path, 3)
    names = ["feature_06_diff_rolling_avg_7", "feature_06_rolling_std_7"]
    out = run_to_table(rolling_stream(read_rounds(spark, path, panel.schema), ["feature_06"], 7, engine, panel.where("date_id < 2"), ["weight"]), engine)
    batch = rolling_features(panel, ["feature_06"], 7, chunk_rows=10).where("date_id >= 2")
    for r in parity_report(batch, out, names).collect():
        assert r["max_abs_delta"] < 1e-9 and r["n_one_sided"] == 0 and r["frac_within_tol"] == 1.0
    assert out.where("weight = 1").count() == batch.count()


def test_late_rows_are_dropped_and_counted(spark, panel):
    path = scratch_path(spark, "late")
    # Late means behind the watermark of the batch before: it takes a third batch.
    for part in ("date_id IN (5, 6)", "date_id = 7", "date_id = 1"):
        panel.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = market_average_stream(read_rounds(spark, path, panel.schema), ["feature_06"])
    q = (stream.writeStream.outputMode("append").format("memory").queryName("late_means")
         .option("checkpointLocation", scratch_path(spark, "late-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert late_rows(q) > 0
    assert spark.table("late_means").where("date_id = 1").count() == 0
    assert spark.table("late_means").where("date_id >= 5").count() == 18


def test_day_roll_batch_can_be_retried(spark, panel):
    labels = panel.select("symbol_id", "date_id", "time_id", F.lit(1.0).alias("responder_6"))
    roll = DayRoll(spark, labels, ["feature_06"])
    for _ in range(2):
        roll(panel.where("date_id < 4"), 0)
    roll(panel.where("date_id >= 4"), 1)
    assert roll.blocks().count() == panel.count()
    last = roll.scaler().orderBy(F.desc("date_id")).first()
    want = panel.agg(F.avg("feature_06"), F.stddev_pop("feature_06")).first()
    assert abs(last["mean"] - want[0]) < 1e-9 and abs(last["std"] - want[1]) < 1e-9


def test_server_retry_and_row_ids(spark, panel):
    rows = panel.withColumn("row_id", F.col("symbol_id") * 1000 + F.col("date_id") * 10 + F.col("time_id")).drop("feature_06")
    labels = panel.select("symbol_id", "date_id", "time_id", F.coalesce("feature_06", F.lit(0.0)).alias("responder_6"))
    server = Server(spark, labels, {"lag": lambda r: F.col("responder_6_lag1d") * 10}, {"lag": 1.0}, [6], min_rows=10)
    lagged = previous_day(rows, [6], labels)
    for i, part in enumerate(("date_id < 4", "date_id >= 4", "date_id >= 4")):
        server(lagged.where(part), min(i, 1))
    out = server.served()
    assert out.count() == out.select("row_id").distinct().count() == panel.count()
    assert out.agg(F.max(F.abs("responder_6"))).first()[0] <= 5.0


def _replay(spark, df, **how):
    path = scratch_path(spark, "replay")
    write_rounds(df, path, **how)
    return read_rounds(spark, path, df.schema)


CUT, LATE = {"rounds": 5, "inside": True, "heartbeat": True}, {"rounds": 5, "inside": True, "late_dates": 1, "heartbeat": True}


def test_labels_arrive_late_or_never(spark, panel):
    rows = panel.select("symbol_id", "date_id", "time_id", "weight")
    # Symbol 0 has no label on date 4, and nobody has one on date 6.
    labels = panel.where("NOT (date_id = 6 OR (date_id = 4 AND symbol_id = 0))").select("symbol_id", "date_id", "time_id", F.lit(2.0).alias("responder_6"))
    out = run_to_table(previous_day_stream(_replay(spark, rows, **CUT), _replay(spark, labels, **LATE), [6]), "lags", 4).drop("event_time")
    want = previous_day(rows, [6], labels)
    assert out.count() == panel.count() and out.select(*want.columns).exceptAll(want).count() == 0
    never = out.where("date_id = 7 OR (date_id = 5 AND symbol_id = 0)")
    assert never.count() == 18 + 6 and never.agg(F.max("responder_6_lag1d")).first()[0] == 0.0


def test_a_step_split_over_batches_has_one_mean(spark, panel):
    rows = panel.select("symbol_id", "date_id", "time_id", "weight")
    labels = panel.select("symbol_id", "date_id", "time_id", F.coalesce("feature_06", F.lit(0.0)).alias("responder_6"))
    path, schema = scratch_path(spark, "split"), rows.schema
    for part in ("symbol_id = 0 AND date_id < 4", "symbol_id > 0 AND date_id <= 4", "symbol_id = 0 AND date_id = 4", "date_id > 4"):
        rows.where(part).repartition(1).write.mode("append").parquet(path)
    write_rounds(rows.limit(0).union(spark.createDataFrame([(None, 9, 0, None)], schema)), path, 1)
    enriched = with_market_average(previous_day_stream(read_rounds(spark, path, schema),
                                                       _replay(spark, labels, **LATE), [6], delay="6 days"), ["responder_6_lag1d"])
    got = run_to_table(enriched, "means", 4).select("symbol_id", "date_id", "time_id", F.round("_mkt_responder_6_lag1d", 9).alias("m"))
    means = previous_day(rows, [6], labels).groupBy("date_id", "time_id").agg(F.round(F.avg("responder_6_lag1d"), 9).alias("m"))
    want = rows.join(means, ["date_id", "time_id"]).select("symbol_id", "date_id", "time_id", "m")
    assert got.count() > 0 and got.exceptAll(want).count() == 0


def test_days_are_whole_though_drops_are_not(spark, panel):
    labels = panel.select("symbol_id", "date_id", "time_id", F.lit(1.0).alias("responder_6"))
    seen: list[tuple[int, int]] = []

    class Watching(DayRoll):
        def __call__(self, batch, batch_id):
            seen.extend((r["date_id"], r["count"]) for r in batch.groupBy("date_id").count().collect())
            super().__call__(batch, batch_id)
    roll = roll_days(_replay(spark, panel, **CUT), Watching(spark, feed_labels(_replay(spark, labels, **LATE)), ["feature_06"]), 4)
    want = {r["date_id"]: r["count"] for r in panel.groupBy("date_id").count().collect()}
    assert sorted(seen) == sorted(want.items())
    assert roll.blocks().count() == panel.count()


def test_state_is_freed_when_dates_close(spark, panel):
    stream = active_symbols(_replay(spark, panel, **CUT))
    q = (stream.writeStream.outputMode("append").format("memory").queryName("active_freed")
         .option("checkpointLocation", scratch_path(spark, "active-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("active_freed").count() == 48
    assert [r["n_active"] for r in spark.table("active_freed").where("date_id = 3").orderBy("time_id").collect()] == [3] * 6
    assert sum(op["numRowsTotal"] for op in q.recentProgress[-1]["stateOperators"]) == 0


class _Handle:
    """State of one key in plain dictionaries."""

    class Map(dict):
        getValue, containsKey, removeKey, updateValue = dict.__getitem__, dict.__contains__, dict.__delitem__, dict.__setitem__

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    def getMapState(self, name, *schema):  # noqa: N802
        self.map = self.Map()
        return self.map

    def getValueState(self, name, *schema):  # noqa: N802
        return self.Value()


@pytest.mark.parametrize("engine", ["buffered", "running"])
@pytest.mark.parametrize("t", [2, 7, 64, 150])
def test_rolling_state_for_any_cut(engine, t):
    rng = np.random.default_rng(t)
    x = rng.normal(1e4, 1.0, size=(700, 2))
    x[rng.random(x.shape) < 0.004] = np.nan
    x[:40, 1] = np.nan
    at = np.sort(np.concatenate([[0, 700], rng.choice(np.arange(1, 700), 25, replace=False)]))
    handle, op = _Handle(), ENGINES[engine](["a", "b"], t)
    op.init(handle)
    parts = [op._push(x[a:b]) for a, b in zip(at, at[1:])]
    mean, std = (np.vstack(v) for v in zip(*parts))
    view = np.lib.stride_tricks.sliding_window_view(x, t, axis=0)
    want = np.full((2, *x.shape), np.nan)
    want[0, t - 1:], want[1, t - 1:] = view.mean(axis=-1), view.std(axis=-1, ddof=1)
    np.testing.assert_allclose(mean, want[0], rtol=0, atol=1e-8)
    np.testing.assert_allclose(std, want[1], rtol=0, atol=1e-7)
    assert len(handle.map) <= -(-t // 64) + 2


def test_rolling_state_is_fast(spark):
    import time
    rng = np.random.default_rng(0)
    op = ENGINES["running"](["a", "b", "c", "d"], 1000)
    op.init(_Handle())
    began = time.process_time()
    for _ in range(200):
        op._push(rng.normal(size=(120, 4)))
    assert 24_000 / (time.process_time() - began) > 20_000


def test_drops_of_several_files_stay_whole(spark):
    """A drop with fewer rows than files is padded, so that no micro-batch takes files of the next drop."""
    path = scratch_path(spark, "drops")
    for lo, hi in ((0, 1), (1, 400)):
        write_drop(spark.range(lo, hi), path, 4)
    seen = []
    (read_rounds(spark, path, spark.range(1).schema, 4).writeStream.foreachBatch(lambda b, _: seen.append(b.count()))
     .option("checkpointLocation", scratch_path(spark, "drops-ckpt")).trigger(availableNow=True).start().awaitTermination())
    assert seen == [1, 399]


def test_bounded_drops_hold_few_rows_and_stay_abreast(spark, panel, monkeypatch):
    """No drop holds more than the bound, a step larger than it aside; labels one date late end where the rows do."""
    monkeypatch.setattr(R, "FILE_ROWS", 10)
    rows = panel.select("symbol_id", "date_id", "time_id", "weight").union(spark.createDataFrame([(7, None, 0, 1.0)], "symbol_id long, date_id int, time_id int, weight double"))
    labels = panel.where("NOT (date_id = 5 AND symbol_id = 0)").select("symbol_id", "date_id", "time_id", F.lit(2.0).alias("responder_6"))
    ends = bounded_ends(rows, 3)
    assert len(ends) > 12 and ends == sorted(set(ends)) and bounded_ends(rows.limit(0), 3) == []
    streams, seen = [], []
    for table, late in ((rows, 0), (labels, 1)):
        path = scratch_path(spark, "bounded")
        files = write_bounded(table, path, ends, late)
        streams.append(read_rounds(spark, path, table.schema, files))
    out = run_to_table(previous_day_stream(*streams, [6]), "lags", 4).drop("event_time")
    want = previous_day(rows.where("date_id IS NOT NULL"), [6], labels)
    assert out.count() == panel.count() and out.select(*want.columns).exceptAll(want).count() == 0
    (streams[0].writeStream.foreachBatch(lambda b, _: seen.append((b.count(), b.agg(F.max("date_id")).first()[0])))
     .option("checkpointLocation", scratch_path(spark, "bounded-ckpt")).trigger(availableNow=True).start().awaitTermination())
    assert max(n for n, _ in seen) <= 10 and sum(n for n, _ in seen) == panel.count() + 1 and [d for _, d in seen] == sorted(d for _, d in seen)


def test_calibrator_reads_and_writes_its_state_once_a_batch():
    """Any number of dates: one read and one write; sums and waiting rows as row by row; the last of repeated labels counts."""
    class Kept:
        value, reads, writes = None, 0, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.writes += 1
            self.value = value
    rng = np.random.default_rng(2)
    rows = [(d, t, float(rng.random() + 0.1), float(rng.normal()), float(rng.normal())) for d in range(30) for t in range(4) if rng.random() < 0.8]
    preds = [(1, d, t, 1, d, w, p, None) for d, t, w, p, _ in rows]
    labels = [(1, d, t, 0, d + 1, None, None, v) for d, t, _, _, y in rows for v in (0.0, y)]
    events = pd.DataFrame(preds + labels, columns=["symbol_id", "date_id", "time_id", "kind", "due", "w", "pred", "y"])
    c = TrailingCalibrator(5, 6, 3.0)
    c.state = Kept()
    out = pd.concat([o for part in (events[events.due <= 13], events[events.due > 13]) for o in c.handleInputRows((1,), iter([part]), None)])
    assert c.state.reads == 1 and c.state.writes == 2 and len(out) == len(rows)
    for d, t, _, p, _ in rows:
        past = [(w, q, y) for e, _, w, q, y in rows if d - 5 <= e < d]
        pp = sum(w * q * q for w, q, _ in past)
        want = min(max((sum(w * q * y for w, q, y in past) / (pp + 1e-12) + 3.0) / 4.0, 0.0), 1.5) if len(past) >= 6 else 1.0
        got = out[(out.date_id == d) & (out.time_id == t)]
        assert abs(got.alpha.item() - want) < 1e-9 and abs(got.pred.item() - p * want) < 1e-9
