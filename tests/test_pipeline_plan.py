"""The pipeline's day loop, its one-plan form and the affine scan agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators.decay import decayed_sums
from tidewheel.plans.pipeline import PanelPipeline, daily_walk, get_learner, learned_dates

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for d in [0, 1, 2, 3, 5, 6, 7, 9, 10]:
        for s in range(3):
            for t in range(8):
                a, b = rng.normal(5, 2), rng.normal(-1, 0.5)
                y = 0.3 * (a - 5) - 0.2 * b + rng.normal() * 0.1 + 0.02 * d
                out.append((s, d, t, None if rng.random() < 0.2 else a, float("nan") if rng.random() < 0.1 else b, None if d == 6 else rng.normal(),
                            None if rng.random() < 0.1 else y, float(rng.uniform(0.5, 2))))
    return spark.createDataFrame(out, "symbol_id long, date_id int, time_id int, a double, b double, c double, y double, w double").persist()


@pytest.mark.parametrize("factor", [1.0, 0.7])
def test_walk_equals_the_day_loop(rows, factor):
    train, valid = [0, 1, 2], [3, 5, 6, 7, 9, 10]
    got = {tuple(r)[:3]: r["pred"] for r in daily_walk(rows, COLS, train, valid, lam=2.0, factor=factor).collect()}
    pipe = PanelPipeline(COLS, get_learner("ridge", lam=2.0, factor=factor)).fit(rows.where(F.col("date_id").isin(train)))
    for d in valid:
        if d != valid[0] and d - 1 in valid:
            pipe.update(rows.where(F.col("date_id") == d - 1))
        for r in pipe.predict(rows.where(F.col("date_id") == d)).collect():
            assert got.pop(tuple(r)[:3]) == pytest.approx(r["pred"], abs=1e-9)
    assert not got


def test_nothing_from_the_day_itself_or_later(rows):
    valid = [3, 5, 6, 7, 9, 10]
    base = {tuple(r)[:3]: r["pred"] for r in daily_walk(rows, COLS, [0, 1, 2], valid).where("date_id <= 6").collect()}
    changed = rows.withColumns({"y": F.when(F.col("date_id") >= 6, F.lit(100.0)).otherwise(F.col("y")), "a": F.when(F.col("date_id") > 6, F.lit(-50.0)).otherwise(F.col("a"))})
    after = {tuple(r)[:3]: r["pred"] for r in daily_walk(changed, COLS, [0, 1, 2], valid).where("date_id <= 6").collect()}
    assert base.keys() == after.keys() and all(base[k] == pytest.approx(after[k], abs=1e-12) for k in base)


def test_learned_dates():
    assert learned_dates([3, 5, 6, 7, 9, 10]) == [5, 6, 9] and learned_dates([]) == [] and learned_dates([4]) == []


def test_dates_in_order(rows):
    with pytest.raises(ValueError):
        daily_walk(rows, COLS, [3], [2])
    with pytest.raises(KeyError):
        get_learner("unknown")


def test_state_is_saved_and_loaded(spark, rows, tmp_path):
    pipe = PanelPipeline(COLS, get_learner("ridge", factor=0.9)).fit(rows.where("date_id < 3"))
    pipe.save(spark, str(tmp_path / "state"))
    again = PanelPipeline.load(spark, str(tmp_path / "state"))
    for p in (pipe, again):
        p.update(rows.where("date_id = 3"))
    a, b = (p.predict(rows.where("date_id = 5")).orderBy("symbol_id", "time_id").toPandas() for p in (pipe, again))
    assert np.array_equal(a["pred"], b["pred"]) and list(a.columns) == [*rows.columns, "pred"]


@pytest.mark.parametrize(("n", "factor"), [(1, 0.5), (32, 0.9), (33, 1.0), (200, 0.3), (2100, 0.97)])
def test_decayed_sums(spark, n, factor):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(2, n))
    df = spark.createDataFrame([(k, r, float(x[k, r])) for k in range(2) for r in range(n)], "k int, r int, v double")
    got = {(r["k"], r["r"]): r["v"] for r in decayed_sums(df, ["k"], "r", "v", factor, n).collect()}
    assert len(got) == 2 * n
    for k in range(2):
        s = 0.0
        for r in range(n):
            s = factor * s + x[k, r]
            assert abs(got[k, r] - s) < 1e-9
