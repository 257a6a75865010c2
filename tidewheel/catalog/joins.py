"""Equi-joins on keys and date arithmetic; scalar functions."""

from pyspark.sql import functions as F

from tidewheel.catalog.registry import (ACTIVITY, K, KSQL, TRADES, TRADES_LABELLED, query, r_sql, rnd,
                                        rounded, with_)
from tidewheel.catalog.windows import LAG1
from tidewheel.functions import scalars as S
from tidewheel.operators import lags as L
from tidewheel.operators.preprocess import standardise
from tidewheel.operators.scores import r2, r2_expr
from tidewheel.operators.structure import day_volatility
from tidewheel.sources import fixtures as fx
from tidewheel.sources import panel as P


@query("previous_day_lag", with_(TRADES_LABELLED, LAG1) + f"SELECT {KSQL}, " + ", ".join(
    r_sql(f"responder_{r}_lag1d", f"responder_{r}_lag1d") for r in range(9)) + " FROM lagged")
def previous_day_lag(spark, d):
    return rounded(L.previous_day(fx.trades_labelled(spark, d).persist(), range(9)), K, [f"responder_{r}_lag1d" for r in range(9)])


@query("five_day_lags", with_(TRADES_LABELLED) + f"SELECT a.symbol_id, a.date_id, a.time_id, " + ", ".join(
    r_sql(f"coalesce(b{k}.responder_{r}, 0)", f"responder_{r}_lag{k}") for k in range(1, 6) for r in (6, 8)) + " FROM labelled a " + " ".join(
    f"LEFT JOIN labelled b{k} ON a.symbol_id = b{k}.symbol_id AND a.date_id = b{k}.date_id + {k} AND a.time_id = b{k}.time_id" for k in range(1, 6)))
def five_day_lags(spark, d):
    cols = ["responder_6", "responder_8"]
    return rounded(L.day_lags_wide(fx.trades_labelled(spark, d).persist(), cols), K, [f"{c}_lag{k}" for k in range(1, 6) for c in cols])


@query("symbol_map", with_(TRADES) + f"SELECT {KSQL}, CAST(coalesce(s_nationkey, -1) AS INTEGER) AS cluster FROM trades LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON s_suppkey = symbol_id")
def symbol_map(spark, d):
    m = (fx.table(spark, d, "supplier").where("s_suppkey % 5 <> 0")
         .select(F.col("s_suppkey").alias("symbol_id"), F.col("s_nationkey").cast("int").alias("cluster")))
    return L.attach_map(fx.trades(spark, d), m, "cluster", -1).select(*K, "cluster")


@query("labels_by_key", with_(TRADES_LABELLED) + f"SELECT t.symbol_id, t.date_id, t.time_id, {r_sql('t.feature_00', 'feature_00')}, {r_sql('responder_6', 'responder_6')} FROM trades t JOIN labelled USING (symbol_id, date_id, time_id)")
def labels_by_key(spark, d):
    out = L.attach_labels(fx.trades(spark, d).persist(), fx.trades_labelled(spark, d), ["responder_6"])
    return rounded(out, K, ["feature_00", "responder_6"])


@query("incomplete_removed", with_(TRADES) + f"""SELECT {KSQL}, weight FROM trades SEMI JOIN (SELECT symbol_id, date_id FROM trades GROUP BY 1, 2
 HAVING count(*) = 11) USING (symbol_id, date_id)""")
def incomplete_removed(spark, d):
    return P.complete_series(fx.trades(spark, d).persist(), 11).select(*K, "weight")


@query("reference_scores", with_(TRADES_LABELLED) + f"""SELECT {r_sql('1 - sum(weight * (0.5 * responder_7 - responder_6) ** 2) / sum(weight * responder_6 ** 2)', 'r2_slow')},
 {r_sql('1 - sum(weight * (0.5 * responder_8 - responder_6) ** 2) / sum(weight * responder_6 ** 2)', 'r2_fast')}
 FROM labelled WHERE responder_6 IS NOT NULL AND responder_7 IS NOT NULL AND responder_8 IS NOT NULL""")
def reference_scores(spark, d):
    t = fx.trades_labelled(spark, d)
    preds = t.select(*K, (F.col("responder_7") * 0.5).alias("slow"), (F.col("responder_8") * 0.5).alias("fast"))
    rows = L.score_inputs(t, preds, ["slow", "fast"]).dropna()
    return rows.agg(*[rnd(r2_expr("responder_6", c, "weight")).alias(f"r2_{c}") for c in ("slow", "fast")])


DAYVOL = "vol AS (SELECT symbol_id, date_id, avg(abs(coalesce(responder_8, 0))) AS day_vol FROM labelled GROUP BY 1, 2)"


@query("day_label_lagged", with_(TRADES_LABELLED, DAYVOL, "lagv AS (SELECT a.*, b.day_vol AS prev FROM vol a LEFT JOIN vol b ON a.symbol_id = b.symbol_id AND a.date_id = b.date_id + 1)")
       + f"SELECT symbol_id, date_id, {r_sql('day_vol', 'day_vol')}, {r_sql('coalesce(prev, (SELECT median(prev) FROM lagv WHERE date_id <= 20))', 'prev_vol')} FROM lagv")
def day_label_lagged(spark, d):
    from tidewheel.operators.quantiles import exact_quantiles
    vol = day_volatility(fx.trades_labelled(spark, d))
    raw = L.lag_series_value(vol, "day_vol", "prev_vol", F.lit(None).cast("double"))
    med = exact_quantiles(raw.where("date_id <= 20"), {"prev_vol": [0.5]})["prev_vol"][0]
    out = L.lag_series_value(vol, "day_vol", "prev_vol", med)
    return rounded(out, ["symbol_id", "date_id"], ["day_vol", "prev_vol"])


@query("side_columns_by_key", with_(TRADES) + f"SELECT {KSQL}, {r_sql('feature_00 + feature_01', 'side')} FROM trades")
def side_columns_by_key(spark, d):
    t = fx.trades(spark, d)
    side = t.select(*K, (F.col("feature_00") + F.col("feature_01")).alias("side"))
    parts = side.where("date_id < 20").unionByName(side.where("date_id >= 20"))
    return rounded(t.select(*K).join(parts, K), K, ["side"])


@query("overnight_pairs", with_(ACTIVITY, """e AS (SELECT symbol_id, date_id, arg_min(feature_00, time_id) AS f, arg_max(feature_00, time_id) AS l
 FROM activity WHERE feature_00 IS NOT NULL GROUP BY 1, 2)""") + f"""SELECT a.symbol_id, a.date_id, {r_sql('a.f', 'feature_00_first')}, {r_sql('b.l', 'feature_00_last')}
 FROM e a JOIN e b ON a.symbol_id = b.symbol_id AND a.date_id = b.date_id + 1""")
def overnight_pairs(spark, d):
    t = fx.activity(spark, d).where("feature_00 IS NOT NULL")
    return rounded(L.overnight_pairs(t, ["feature_00"]), ["symbol_id", "date_id"], ["feature_00_first", "feature_00_last"])


@query("day_edges", with_(TRADES) + f"""SELECT symbol_id, date_id, {r_sql('arg_min(feature_00, time_id)', 'feature_00_first')}, {r_sql('arg_max(feature_00, time_id)', 'feature_00_last')}
 FROM trades GROUP BY 1, 2""")
def day_edges(spark, d):
    return rounded(L.day_edges(fx.trades(spark, d), ["feature_00"]), ["symbol_id", "date_id"], ["feature_00_first", "feature_00_last"])


# -- scalar functions -----------------------------------------------------------

_A, _B = "(feature_01 - 0.25)", "(feature_04 - 0.22)"


@query("pair_combos", with_(TRADES) + f"""SELECT {KSQL}, {r_sql(f'{_A} - {_B}', 'sub')}, {r_sql(f'{_A} * {_B}', 'mul')},
 {r_sql(f'{_A} / CASE WHEN abs({_B}) >= 0.1 THEN {_B} WHEN {_B} < 0 THEN -0.1 ELSE 0.1 END', 'div')},
 {r_sql(f'least({_A}, {_B})', 'min')}, {r_sql(f'greatest({_A}, {_B})', 'max')},
 {r_sql('CASE WHEN feature_03 IS NOT NULL THEN least(feature_03, feature_00) END', 'min_null')} FROM trades""")
def pair_combos(spark, d):
    a, b = F.col("feature_01") - 0.25, F.col("feature_04") - 0.22
    return fx.trades(spark, d).select(*K, *[rnd(S.combo(op, a, b)).alias(op) for op in S.COMBOS],
                                      rnd(S.combo("min", "feature_03", "feature_00")).alias("min_null"))


@query("log_volatility", with_(TRADES_LABELLED) + f"""SELECT {KSQL}, {r_sql('ln(1 + abs(responder_6))', 'log_abs')},
 {r_sql('greatest(exp(ln(1 + abs(responder_6))) - 1, 0.05)', 'vol')},
 {r_sql('responder_8 * power(greatest(abs(responder_6), 0.05) / 0.2, 0.3)', 'scaled')} FROM labelled WHERE responder_6 IS NOT NULL""")
def log_volatility(spark, d):
    t = fx.trades_labelled(spark, d).where("responder_6 IS NOT NULL")
    t = t.withColumn("log_abs", S.log_abs("responder_6")).withColumn("vol", S.vol_from_log("log_abs"))
    return rounded(t.withColumn("scaled", S.vol_scale("responder_8", "vol", 0.2, 0.3)), K, ["log_abs", "vol", "scaled"])


@query("regime_bucket", with_(TRADES) + f"SELECT {KSQL}, CASE WHEN feature_00 < 4.2 THEN 'calm' ELSE 'storm' END AS regime FROM trades")
def regime_bucket(spark, d):
    return fx.trades(spark, d).select(*K, S.regime("feature_00", 4.2).alias("regime"))


@query("clip_standardise_fill", with_(TRADES) + f"SELECT {KSQL}, {r_sql('CASE WHEN feature_03 IS NULL THEN 0 ELSE (least(greatest(feature_03, 1.5), 3.7) - 3.0) / 0.8 END', 'z')} FROM trades")
def clip_standardise_fill(spark, d):
    return fx.trades(spark, d).select(*K, rnd(standardise("feature_03", 1.5, 3.7, F.lit(3.0), F.lit(0.8))).alias("z"))


@query("recency_weight", with_(TRADES) + f"SELECT {KSQL}, {r_sql('weight * power(0.5, ((SELECT max(date_id) FROM trades) - date_id) / 7.0)', 'w')} FROM trades")
def recency_weight(spark, d):
    t = fx.trades(spark, d)
    return t.select(*K, rnd(S.recency_weight("weight", "date_id", t.agg(F.max("date_id")).first()[0], 7)).alias("w"))


# -- the flagship -----------------------------------------------------------------

@query("yesterday_score_by_symbol", with_(TRADES_LABELLED, LAG1) + f"""SELECT symbol_id, {r_sql('1 - sum(weight * (responder_6_lag1d - responder_6) ** 2) / sum(weight * responder_6 ** 2)', 'r2')}
 FROM lagged WHERE responder_6 IS NOT NULL GROUP BY 1""")
def yesterday_score_by_symbol(spark, d):
    t = L.previous_day(fx.trades_labelled(spark, d).persist(), [6])
    return r2(t, ["symbol_id"], "responder_6", "responder_6_lag1d", "weight").select("symbol_id", rnd("r2").alias("r2"))


