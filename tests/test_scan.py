"""Scans along a symbol: chunked windows and the weighted mean against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators.chunks import Stage, over_symbol
from tidewheel.operators.ewma import ewma
from tidewheel.operators.rolling import rolling_features
from tidewheel.operators.shifts import forward_means, realized_means
from tidewheel.sources import sinks


@pytest.fixture(scope="module")
def ragged(spark):
    """Uneven days with gaps; symbol 0 holds most rows."""
    rng = np.random.default_rng(3)
    rows = []
    for s, days in ((0, 40), (1, 7), (2, 1)):
        for d in range(days):
            for t in range(int(rng.integers(1, 30))):
                v = None if rng.random() < 0.07 else float(rng.normal())
                rows.append((s, d + s, t, v, float(rng.normal())))
    pdf = pd.DataFrame(rows, columns=["symbol_id", "date_id", "time_id", "x", "y"])
    df = spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in rows],
                               "symbol_id long, date_id int, time_id int, x double, y double").persist()
    return df, pdf


def _in_order(df, *cols):
    return df.orderBy("symbol_id", "date_id", "time_id").select("symbol_id", *cols).toPandas()


@pytest.mark.parametrize("chunk", [1, 17, 60, None])
def test_rolling_equals_pandas(ragged, chunk):
    df, pdf = ragged
    for rows in (5, 40):
        got = _in_order(rolling_features(df, ["x", "y"], rows, chunk_rows=chunk), f"x_diff_rolling_avg_{rows}", f"y_rolling_std_{rows}")
        by = pdf.groupby("symbol_id")
        want = pdf["x"].astype(float) - by["x"].transform(lambda v: v.astype(float).rolling(rows).mean())
        np.testing.assert_allclose(got.iloc[:, 1].astype(float), want, atol=1e-9)
        np.testing.assert_allclose(got.iloc[:, 2].astype(float), by["y"].transform(lambda v: v.rolling(rows).std()), atol=1e-9)


@pytest.mark.parametrize("chunk", [1, 23, None])
def test_forward_and_realized_means(ragged, chunk):
    df, pdf = ragged
    fwd = _in_order(forward_means(df, [("y", 11, "f")], chunk), "f")["f"].astype(float)
    want = pdf.groupby("symbol_id")["y"].transform(lambda v: v[::-1].rolling(11).mean()[::-1].shift(-1))
    np.testing.assert_allclose(fwd, want, atol=1e-9)
    back = _in_order(realized_means(df, [("y", 11, "r")], chunk), "r")["r"].astype(float)
    np.testing.assert_allclose(back, want.groupby(pdf["symbol_id"]).shift(11), atol=1e-9)


def test_chunks_are_bounded_and_own_each_row_once(ragged):
    df, pdf = ragged
    sizes = {}

    def build(rows, along):
        sizes["max"] = rows.groupBy("symbol_id", "_chunk").count().agg(F.max("count")).first()[0]
        return rows

    out = over_symbol(df, Stage(build, back=10, fwd=10), chunk_rows=50)
    assert out.count() == len(pdf)
    assert sizes["max"] <= 50 + 2 * 10 + 4 * 30 < len(pdf[pdf.symbol_id == 0])


@pytest.mark.parametrize("span", [2, 30])
def test_ewma_equals_recurrence(spark, ragged, span):
    df, pdf = ragged
    got = _in_order(ewma(df, ["x", "y"], span), f"x_ewma_{span}", f"y_ewma_{span}")
    for i, c in enumerate(("x", "y"), start=1):
        want = []
        for _, v in pdf.groupby("symbol_id"):
            state = np.nan
            for x in v[c].astype(float):
                if not np.isnan(x):
                    state = x if np.isnan(state) else state + 2 / (span + 1) * (x - state)
                want.append(state)
        np.testing.assert_allclose(got.iloc[:, i].astype(float), want, atol=1e-9)


def test_ewma_far_beyond_one_segment(spark):
    n, per = 30000, 900
    rng = np.random.default_rng(0)
    x = rng.normal(size=n) + 3
    pdf = pd.DataFrame({"symbol_id": 1, "date_id": np.arange(n) // per, "time_id": np.arange(n) % per, "x": x})
    got = _in_order(ewma(spark.createDataFrame(pdf), ["x"]), "x_ewma_30")["x_ewma_30"]
    np.testing.assert_allclose(got, pdf["x"].ewm(span=30, adjust=False).mean(), rtol=1e-10)


def test_dates_of_a_table_prune_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewheel.sources.panel import pick_dates_of
    path = str(tmp_path / "panel")
    spark.range(4000).select(F.col("id").alias("symbol_id"), (F.col("id") % 20).cast("int").alias("date_id"), F.lit(0).alias("time_id")).write.partitionBy("date_id").parquet(path)
    dates = str(tmp_path / "dates")
    spark.createDataFrame([(3, 1), (3, 2), (17, 1), (None, 1), (99, 1), (5, 0)], "date_id int, wanted int").write.parquet(dates)
    out = pick_dates_of(spark.read.parquet(path), spark.read.parquet(dates).where("wanted > 0"))
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted((r["date_id"], r["count"]) for r in out.groupBy("date_id").count().collect()) == [(3, 200), (17, 200)]


def test_writer_splits_a_skewed_date(spark, tmp_path):
    """One symbol holds nearly all rows of a date: no file exceeds the bound by much, no row is lost, a null date is kept."""
    rows = spark.range(10_000).selectExpr("1 AS symbol_id", "5 AS date_id", "CAST(id AS INT) AS time_id", "1.0 AS weight")
    rest = spark.range(40).selectExpr("CAST(id AS INT) AS symbol_id", "CASE WHEN id < 30 THEN CAST(id AS INT) END AS date_id", "0 AS time_id", "1.0 AS weight")
    panel = rows.union(rest)
    path = str(tmp_path / "panel")
    sinks.write_by_date(panel, path, rows_per_file=1000)
    back = spark.read.parquet(path).withColumn("file", F.input_file_name())
    sizes = {r["file"]: r["count"] for r in back.groupBy("file").count().collect()}
    assert max(sizes.values()) < 1250
    assert back.where("date_id = 5").select("file").distinct().count() == 11
    assert back.where("date_id IS NULL").select("file").distinct().count() == 1
    cols = ["symbol_id", "date_id", "time_id", "weight"]
    assert back.select(cols).exceptAll(panel).count() == 0 and back.count() == 10_040
    sinks.write_by_date(panel.limit(0), str(tmp_path / "empty"))
    assert not list((tmp_path / "empty").rglob("date_id=*"))
