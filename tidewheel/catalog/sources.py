"""Scans, sinks, projections and filters."""

from pyspark.sql import functions as F

from tidewheel.catalog.registry import (ACTIVITY, ACTIVITY_CELLS, K, KSQL, TRADES, TRADES_LABELLED, query,
                                        r_sql, rnd, rounded, with_)
from tidewheel.functions import scalars as S
from tidewheel.operators.evaluate import date_bootstrap
from tidewheel.session import scratch_path
from tidewheel.sources import fixtures as fx
from tidewheel.sources import panel as P
from tidewheel.sources import sinks
from tidewheel.operators.diagnostics import ranked_report
from tidewheel.operators.moments import target_correlations

TF = fx.TRADES_FEATURES
AF = fx.ACTIVITY_FEATURES


def _cols(names, alias=""):
    return ", ".join(r_sql(f"{alias}{c}", c) for c in names)


@query("scan_panel", with_(TRADES) + f"SELECT {KSQL}, weight, {_cols(TF)} FROM trades")
def scan_panel(spark, d):
    path = scratch_path(spark, "panel")
    fx.trades(spark, d).withColumn("partition_id", F.col("date_id") % 4).write.partitionBy("partition_id").parquet(path)
    return rounded(P.scan_panel(spark, path), [*K, "weight"], TF)


@query("scan_date_range", with_(TRADES) + f"SELECT {KSQL}, weight, {_cols(TF[:2])} FROM trades WHERE date_id BETWEEN 5 AND 11")
def scan_date_range(spark, d):
    return rounded(P.between_dates(fx.trades(spark, d), 5, 11), [*K, "weight"], TF[:2])


@query("scan_from_date", with_(TRADES) + f"SELECT {KSQL}, weight FROM trades WHERE date_id >= 20")
def scan_from_date(spark, d):
    return P.between_dates(fx.trades(spark, d), 20).select(*K, "weight")


@query("date_bounds", with_(TRADES) + "SELECT min(date_id) AS min_date, max(date_id) AS max_date FROM trades")
def date_bounds(spark, d):
    return P.date_bounds(fx.trades(spark, d))


@query("dataset_profile", with_(TRADES) + """SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_cols, min(date_id) AS min_date,
 max(date_id) AS max_date, count(DISTINCT symbol_id) AS n_symbols, count(DISTINCT time_id) AS n_times FROM trades""")
def dataset_profile(spark, d):
    return P.profile(fx.trades(spark, d))


@query("feature_tags", """SELECT CAST(p_partkey AS VARCHAR) AS feature,
 array_to_string(list_filter([CASE WHEN p_size > 25 THEN 'tag_large' END, CASE WHEN p_retailprice > 1500 THEN 'tag_pricey' END,
 CASE WHEN p_partkey % 3 = 0 THEN 'tag_third' END], lambda t: t IS NOT NULL), ',') AS tags FROM part""")
def feature_tags(spark, d):
    part = fx.table(spark, d, "part")
    path = scratch_path(spark, "tags")
    part.select(F.col("p_partkey").alias("feature"), (F.col("p_size") > 25).alias("tag_large"),
                (F.col("p_retailprice") > 1500).alias("tag_pricey"), (F.col("p_partkey") % 3 == 0).alias("tag_third")
                ).write.option("header", True).csv(path)
    return P.feature_tags(spark, path).select("feature", F.concat_ws(",", "tags").alias("tags"))


@query("read_chosen_dates", with_(TRADES) + f"SELECT {KSQL}, weight FROM trades WHERE date_id IN (2, 3, 17, 21)")
def read_chosen_dates(spark, d):
    return P.pick_dates(fx.trades(spark, d), [2, 3, 17, 21]).select(*K, "weight")


_BUSY = "busy AS (SELECT date_id FROM (SELECT date_id, sum(weight) AS w FROM trades GROUP BY 1) WHERE w > (SELECT avg(w) FROM (SELECT sum(weight) AS w FROM trades GROUP BY date_id)))"


@query("read_chosen_dates_table", with_(TRADES, _BUSY) + f"SELECT {KSQL}, weight FROM trades SEMI JOIN busy USING (date_id)")
def read_chosen_dates_table(spark, d):
    """The dates of more than average weight, read from a panel stored by date."""
    path = scratch_path(spark, "by-date")
    t = fx.trades(spark, d).select(*K, "weight")
    sinks.write_by_date(t, path)
    daily = t.groupBy("date_id").agg(F.sum("weight").alias("w"))
    busy = daily.where(F.col("w") > daily.agg(F.avg("w")).first()[0])
    return P.pick_dates_of(spark.read.parquet(path), busy).select(*[F.col(c).cast(t.schema[c].dataType).alias(c) for c in K], "weight")


RANKED = """dates AS (SELECT date_id, row_number() OVER (ORDER BY date_id) AS date_rank, count(*) OVER () AS n_dates
  FROM (SELECT DISTINCT date_id FROM trades))"""
DRAWS = RANKED + """,
draws AS (SELECT a.occurrence, b.date_id FROM (SELECT date_rank - 1 AS occurrence,
  CAST('0x' || substr(md5('7|' || (date_rank - 1)), 1, 8) AS BIGINT) % n_dates + 1 AS date_rank FROM dates) a JOIN dates b USING (date_rank))"""


@query("rows_for_draws", with_(TRADES, DRAWS) + f"""SELECT CAST(occurrence AS INTEGER) AS occurrence, {KSQL}, weight
 FROM trades JOIN draws USING (date_id)""")
def rows_for_draws(spark, d):
    t = fx.trades(spark, d)
    return P.rows_for_draws(t, date_bootstrap(t, 7)).select("occurrence", *K, "weight")


@query("lag_frame_naming", with_(TRADES_LABELLED) + f"""SELECT {KSQL}, {r_sql('coalesce(responder_6, 0)', 'responder_6')},
 {r_sql('coalesce(responder_8, 0)', 'responder_8')} FROM labelled""")
def lag_frame_naming(spark, d):
    t = fx.trades_labelled(spark, d).withColumnRenamed("responder_6", "responder_6_lag_1")
    return rounded(P.lag_frame(t, [6, 8]), K, ["responder_6", "responder_8"])


@query("export_by_date", with_(TRADES) + f"SELECT {KSQL}, weight, {_cols(TF)} FROM trades WHERE date_id BETWEEN 3 AND 9")
def export_by_date(spark, d):
    path = scratch_path(spark, "export")
    sinks.write_by_date(P.between_dates(fx.trades(spark, d), 3, 9), path, files_per_date=2)
    return rounded(spark.read.parquet(path), [*K, "weight"], TF)


@query("manifest", with_(TRADES) + """SELECT date_id, CAST(sum(n) OVER w - n AS BIGINT) AS row_start, CAST(sum(n) OVER w AS BIGINT) AS row_end,
 n AS n_rows FROM (SELECT date_id, count(*) AS n FROM trades GROUP BY 1) WINDOW w AS (ORDER BY date_id)""")
def manifest(spark, d):
    return P.manifest(fx.trades(spark, d))


@query("stream_sink", with_(TRADES) + f"""SELECT 'a' AS stream, {KSQL}, {r_sql('feature_00', 'pred')} FROM trades
 UNION ALL SELECT 'b', {KSQL}, {r_sql('feature_01', 'pred')} FROM trades""")
def stream_sink(spark, d):
    path = scratch_path(spark, "streams")
    t = fx.trades(spark, d)
    for name, col in (("a", "feature_00"), ("b", "feature_01"), ("a", "feature_02")):
        if name not in sinks.finished_streams(spark, path):
            sinks.append_stream(t.select(F.lit(name).alias("stream"), *K, F.col(col).alias("pred")), path)
    return spark.read.parquet(path).select("stream", *K, rnd("pred").alias("pred"))


@query("metrics_sink", with_(TRADES) + f"SELECT date_id, count(*) AS n_rows, {r_sql('avg(feature_00)', 'mean')} FROM trades GROUP BY 1")
def metrics_sink(spark, d):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(fx.trades(spark, d).groupBy("date_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("feature_00").alias("mean")), path)
    return spark.read.schema("date_id int, n_rows long, mean double").json(path).select("date_id", "n_rows", rnd("mean").alias("mean"))


@query("ranked_report", with_(TRADES) + f"""SELECT feature, {r_sql('corr', 'corr')}, CAST(row_number() OVER (ORDER BY abs(corr) DESC, feature) AS INTEGER) AS position
 FROM (SELECT unnest(['feature_01','feature_02','feature_03','feature_04','feature_05']) AS feature,
 unnest([corr(feature_01, feature_00), corr(feature_02, feature_00), corr(feature_03, feature_00), corr(feature_04, feature_00),
 corr(feature_05, feature_00)]) AS corr FROM trades) ORDER BY abs(corr) DESC, feature LIMIT 3""")
def ranked_report_(spark, d):
    table = target_correlations(fx.trades(spark, d), TF[1:], "feature_00")
    return ranked_report(table, "corr", 3).select("feature", rnd("corr").alias("corr"), "position")


# -- projections and filters --------------------------------------------------

@query("downcast", with_(TRADES) + f"SELECT {KSQL}, " + ", ".join(
    f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 5) + 0.0 AS "{c}"' for c in TF) + " FROM trades")
def downcast(spark, d):
    t = S.downcast(fx.trades(spark, d), TF)
    return t.select(*K, *[rnd(F.col(c).cast("double"), 5).alias(c) for c in TF])


@query("saturating_cast", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(CAST(least(greatest(l_extendedprice, -65504.0), 65504.0) AS FLOAT) AS DOUBLE), 2) + 0.0 AS price FROM lineitem")
def saturating_cast(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     rnd(S.saturate_half("l_extendedprice").cast("double"), 2).alias("price"))


@query("time_feature", with_(TRADES) + f"SELECT {KSQL}, CAST(time_id AS FLOAT) AS feature_time_id FROM trades")
def time_feature(spark, d):
    return fx.trades(spark, d).select(*K, F.col("time_id").cast("float").alias("feature_time_id"))


@query("row_thinning", with_(ACTIVITY) + f"SELECT {KSQL}, weight FROM activity WHERE time_id % 4 = 0")
def row_thinning(spark, d):
    return P.thin(fx.activity(spark, d), 4).select(*K, "weight")


@query("complete_series", with_(TRADES) + f"SELECT {KSQL}, weight FROM (SELECT *, count(*) OVER (PARTITION BY symbol_id, date_id) AS n FROM trades) WHERE n = 12")
def complete_series(spark, d):
    return P.complete_series(fx.trades(spark, d), 12).select(*K, "weight")


@query("clip_predictions", with_(TRADES) + f"SELECT {KSQL}, {r_sql('least(greatest(feature_00 * 3 - 9, -5.0), 5.0)', 'pred')} FROM trades")
def clip_predictions(spark, d):
    return fx.trades(spark, d).select(*K, rnd(S.clip_prediction(F.col("feature_00") * 3 - 9)).alias("pred"))


@query("null_fill", with_(TRADES) + f"SELECT {KSQL}, {r_sql('coalesce(feature_03, 0)', 'feature_03')} FROM trades")
def null_fill(spark, d):
    t = fx.trades(spark, d).withColumn("feature_03", F.coalesce("feature_03", F.lit(float("nan"))))
    return t.select(*K, rnd(S.zero_fill("feature_03")).alias("feature_03"))


@query("drop_incomplete", with_(TRADES) + f"SELECT {KSQL}, {r_sql('feature_03', 'feature_03')} FROM trades WHERE feature_03 IS NOT NULL")
def drop_incomplete(spark, d):
    return rounded(S.drop_incomplete(fx.trades(spark, d), TF), K, ["feature_03"])


@query("one_hot", with_(ACTIVITY_CELLS) + f"SELECT {KSQL}, " + ", ".join(
    f"CASE WHEN symbol_id = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sym_{k}" for k in range(6)) + " FROM cells")
def one_hot(spark, d):
    t = S.one_hot(fx.activity_cells(spark, d), "symbol_id", list(range(6)), "sym")
    return t.select(*K, *[f"sym_{k}" for k in range(6)])


@query("lookback_range", with_(TRADES) + f"SELECT {KSQL}, weight FROM trades WHERE date_id BETWEEN 15 AND 25")
def lookback_range(spark, d):
    # 48 rows at 12 steps per day reach 4 dates back, plus one.
    return P.with_lookback(fx.trades(spark, d), 20, 25, 48, 12).select(*K, "weight")


@query("complete_grid", with_(ACTIVITY) + f"SELECT {KSQL}, weight, {_cols(AF)} FROM activity")
def complete_grid(spark, d):
    return rounded(fx.activity(spark, d), [*K, "weight"], AF)


@query("null_count", with_(ACTIVITY) + f"""SELECT {KSQL}, CAST((feature_00 IS NULL)::INT + (feature_03 IS NULL)::INT + (feature_04 IS NULL)::INT AS INTEGER) AS n_null
 FROM activity""")
def null_count(spark, d):
    return fx.activity(spark, d).select(*K, S.null_count(["feature_00", "feature_03", "feature_04"]).alias("n_null"))


# -- sorts, limits, sets ------------------------------------------------------

@query("history_tail", with_(TRADES) + f"""SELECT {KSQL}, weight FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id
 ORDER BY date_id DESC, time_id DESC) AS i FROM trades) WHERE i <= 30""")
def history_tail(spark, d):
    return P.history_tail(fx.trades(spark, d), 30).select(*K, "weight")


@query("panel_sort", with_(TRADES) + f"SELECT {KSQL}, weight FROM trades ORDER BY date_id, symbol_id, time_id")
def panel_sort(spark, d):
    return fx.trades(spark, d).select(*K, "weight").orderBy("date_id", "symbol_id", "time_id")


@query("union_of_dates", with_(TRADES) + f"SELECT {KSQL}, weight FROM trades WHERE date_id IN (1, 2, 3)")
def union_of_dates(spark, d):
    t = fx.trades(spark, d)
    one, two, three = (P.pick_dates(t, [k]) for k in (1, 2, 3))
    return one.unionByName(two).unionByName(three).select(*K, "weight")


@query("union_train_tail", with_(TRADES) + f"SELECT {KSQL}, weight FROM trades WHERE date_id <= 10 OR date_id >= 25")
def union_train_tail(spark, d):
    t = fx.trades(spark, d)
    return P.between_dates(t, None, 10).unionByName(P.between_dates(t, 25)).select(*K, "weight")


@query("common_symbols", with_(TRADES) + """SELECT symbol_id FROM trades WHERE date_id <= 1 INTERSECT
 SELECT symbol_id FROM trades WHERE date_id >= 27""")
def common_symbols(spark, d):
    t = fx.trades(spark, d)
    return P.between_dates(t, None, 1).select("symbol_id").intersect(P.between_dates(t, 27).select("symbol_id"))


@query("distinct_dates", with_(TRADES) + "SELECT DISTINCT date_id FROM trades")
def distinct_dates(spark, d):
    return P.distinct_dates(fx.trades(spark, d))


@query("export_with_responders", with_(TRADES_LABELLED) + f"""SELECT {KSQL}, weight, {_cols(['feature_00'] + [f'responder_{r}' for r in range(9)])}
 FROM labelled""")
def export_with_responders(spark, d):
    from tidewheel.operators.lags import attach_labels
    t = fx.trades_labelled(spark, d)
    resp = [f"responder_{r}" for r in range(9)]
    joined = attach_labels(fx.trades(spark, d).select(*K, "weight", "feature_00"), t, resp)
    path = scratch_path(spark, "export")
    sinks.write_by_date(joined, path)
    return rounded(spark.read.parquet(path), [*K, "weight"], ["feature_00", *resp])


