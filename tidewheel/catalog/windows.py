"""Time-series window operators and cross-sections."""

from dataclasses import replace

from pyspark.sql import functions as F

from tidewheel.catalog.registry import (ACTIVITY, ACTIVITY_LABELLED, K, KSQL, TRADES, TRADES_LABELLED, WDT, WS, WSD, query,
                                        r_sql, rnd, rounded, with_)
from tidewheel.names import lag_name, market_avg, rank_name, rolling_diff, rolling_std
from tidewheel.operators import crosssection as X
from tidewheel.operators import shifts as H
from tidewheel.operators.ewma import ewma
from tidewheel.operators.lags import previous_day
from tidewheel.operators.rolling import day_expanding, rolling_features
from tidewheel.operators.signatures import window_signature
from tidewheel.plans.features import FeaturePlan, build_features, model_input
from tidewheel.sources import fixtures as fx

TF, AF = fx.TRADES_FEATURES, fx.ACTIVITY_FEATURES
# Small chunks, so that the checked result really is put together from pieces.
CHUNK = 100


@query("forward_targets", with_(TRADES_LABELLED) + f"""SELECT {KSQL},
 {r_sql(f'coalesce(responder_8 + lead(responder_8, 4) OVER {WS}, 0)', 'responder_9')},
 {r_sql(f'coalesce(responder_6 + lead(responder_6, 20) OVER {WS} + lead(responder_6, 40) OVER {WS}, 0)', 'responder_10')} FROM labelled""")
def forward_targets(spark, d):
    return rounded(H.synthetic_targets(fx.trades_labelled(spark, d), chunk_rows=CHUNK), K, ["responder_9", "responder_10"])


@query("realized_targets", with_(TRADES_LABELLED) + f"""SELECT {KSQL},
 {r_sql(f'coalesce(lag(responder_6, 20) OVER {WS}, 0)', 'responder_11')},
 {r_sql(f'coalesce(lag(responder_8, 4) OVER {WS}, 0)', 'responder_12')} FROM labelled""")
def realized_targets(spark, d):
    return rounded(H.realized_targets(fx.trades_labelled(spark, d), chunk_rows=CHUNK), K, ["responder_11", "responder_12"])


@query("day_forward_sum", with_(ACTIVITY_LABELLED) + f"""SELECT {KSQL},
 {r_sql(f'coalesce(responder_8, 0) + coalesce(lead(responder_8, 4) OVER {WSD}, 0)', 'fwd')},
 {r_sql(f'coalesce(lag(responder_6, 3) OVER {WSD}, 0)', 'back')} FROM labelled""")
def day_forward_sum(spark, d):
    t = fx.activity_labelled(spark, d)
    return t.select(*K, rnd(H.day_forward_sum("responder_8", [4])).alias("fwd"), rnd(H.day_backward_shift("responder_6", 3)).alias("back"))


def _rolling_sql(c: str, t: int) -> str:
    w = f"(PARTITION BY symbol_id ORDER BY date_id, time_id ROWS BETWEEN {t - 1} PRECEDING AND CURRENT ROW)"
    full = f"CASE WHEN count({c}) OVER {w} = {t} THEN"
    return (r_sql(f"{full} {c} - avg({c}) OVER {w} END", rolling_diff(c, t)) + ", "
            + r_sql(f"{full} stddev_samp({c}) OVER {w} END", rolling_std(c, t)))


@query("rolling_short", with_(TRADES) + f"SELECT {KSQL}, {_rolling_sql('feature_00', 6)}, {_rolling_sql('feature_03', 6)} FROM trades")
def rolling_short(spark, d):
    cols = ["feature_00", "feature_03"]
    out = rolling_features(fx.trades(spark, d), cols, 6, chunk_rows=CHUNK)
    return rounded(out, K, [n(c, 6) for c in cols for n in (rolling_diff, rolling_std)])


@query("rolling_long", with_(TRADES) + f"SELECT {KSQL}, " + ", ".join(_rolling_sql(c, 48) for c in TF) + " FROM trades")
def rolling_long(spark, d):
    out = rolling_features(fx.trades(spark, d), TF, 48)
    return rounded(out, K, [n(c, 48) for c in TF for n in (rolling_diff, rolling_std)])


@query("market_average", with_(TRADES) + f"SELECT {KSQL}, " + ", ".join(r_sql(f"avg({c}) OVER {WDT}", market_avg(c)) for c in TF) + " FROM trades")
def market_average(spark, d):
    return rounded(X.market_average(fx.trades(spark, d), TF), K, [market_avg(c) for c in TF])


@query("market_split", with_(TRADES) + f"SELECT {KSQL}, " + ", ".join(
    r_sql(f"avg({c}) OVER {WDT}", f"{c}_mkt") + ", " + r_sql(f"{c} - avg({c}) OVER {WDT}", f"{c}_idio") for c in TF[:3]) + " FROM trades")
def market_split(spark, d):
    return rounded(X.market_split(fx.trades(spark, d), TF[:3]), K, [f"{c}_{p}" for c in TF[:3] for p in ("mkt", "idio")])


_RANKED = ["feature_02", "feature_03"]
_RANK_SQL = with_(TRADES) + f"SELECT {KSQL}, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY date_id, time_id ORDER BY {c} NULLS LAST) + "
    f"(count(*) OVER (PARTITION BY date_id, time_id, {c}) - 1) / 2.0 END::DOUBLE AS {rank_name(c)}" for c in _RANKED) + " FROM trades"


@query("rank_average", _RANK_SQL)
def rank_average(spark, d):
    return X.rank_average(fx.trades(spark, d), _RANKED).select(*K, *[rank_name(c) for c in _RANKED])


@query("rank_average_split", _RANK_SQL)
def rank_average_split(spark, d):
    return X.rank_average(fx.trades(spark, d), _RANKED, method="split").select(*K, *[rank_name(c) for c in _RANKED])


_UNIT_SQL = with_(TRADES) + f"SELECT {KSQL}, " + ", ".join(
    r_sql(f"(row_number() OVER (PARTITION BY date_id, time_id ORDER BY {c} NULLS LAST, symbol_id) - 1)::DOUBLE / greatest(count(*) OVER {WDT} - 1, 1)",
          f"{c}_rank01", 9) for c in _RANKED) + " FROM trades"


@query("rank_unit", _UNIT_SQL)
def rank_unit(spark, d):
    return rounded(X.rank_unit(fx.trades(spark, d), _RANKED), K, [f"{c}_rank01" for c in _RANKED], 9)


@query("rank_unit_split", _UNIT_SQL)
def rank_unit_split(spark, d):
    rows = fx.trades(spark, d).select(*K, *_RANKED).persist()
    return rounded(X.rank_unit(rows, _RANKED, method="split"), K, [f"{c}_rank01" for c in _RANKED], 9)


# The recurrence in closed form over row numbers; feature_00 has no gaps on the trades panel.
@query("ewma", with_(TRADES) + f"""SELECT a.symbol_id, a.date_id, a.time_id, {r_sql('sum(CASE WHEN b.i = 1 THEN b.x ELSE 2.0 / 31 * b.x END * power(29.0 / 31, a.i - b.i))', 'feature_00_ewma_30')}
 FROM (SELECT *, row_number() OVER {WS} AS i FROM trades) a JOIN (SELECT symbol_id, feature_00 AS x, row_number() OVER {WS} AS i FROM trades) b
 ON a.symbol_id = b.symbol_id AND b.i <= a.i GROUP BY 1, 2, 3""")
def ewma_(spark, d):
    return rounded(ewma(fx.trades(spark, d), ["feature_00"]), K, ["feature_00_ewma_30"])


@query("day_differences", with_(TRADES) + f"SELECT {KSQL}, " + ", ".join(
    r_sql(f"coalesce({c} - lag({c}, {k}) OVER {WSD}, 0)", f"{c}_diff_{k}") for c in TF[:3] for k in (1, 4, 8)) + " FROM trades")
def day_differences(spark, d):
    return rounded(H.day_differences(fx.trades(spark, d), TF[:3], (1, 4, 8)), K, [f"{c}_diff_{k}" for c in TF[:3] for k in (1, 4, 8)])


LAG1 = """lagged AS (SELECT a.symbol_id, a.date_id, a.time_id, a.weight, """ + ", ".join(
    f"a.responder_{r}, coalesce(b.responder_{r}, 0) AS responder_{r}_lag1d" for r in range(9)) + """
 FROM labelled a LEFT JOIN labelled b ON a.symbol_id = b.symbol_id AND a.date_id = b.date_id + 1 AND a.time_id = b.time_id)"""
_DIFFS = {"rsig_momA_short": (8, 6), "rsig_momA_med": (6, 7), "rsig_momB_short": (5, 3), "rsig_momB_med": (3, 4), "rsig_spread_fine": (8, 5)}


@query("lag_differences", with_(TRADES_LABELLED, LAG1) + f"SELECT {KSQL}, " + ", ".join(
    r_sql(f"responder_{a}_lag1d - responder_{b}_lag1d", n) for n, (a, b) in _DIFFS.items()) + " FROM lagged")
def lag_differences(spark, d):
    t = previous_day(fx.trades_labelled(spark, d).persist(), range(3, 9))
    return rounded(H.lag_differences(t), K, list(_DIFFS))


@query("day_lags", with_(ACTIVITY) + f"SELECT {KSQL}, " + ", ".join(r_sql(f"lag(feature_01, {k}) OVER {WSD}", f"lag_{k}") for k in range(1, 6)) + " FROM activity")
def day_lags(spark, d):
    return rounded(H.day_lags(fx.activity(spark, d), "feature_01", 5), K, [f"lag_{k}" for k in range(1, 6)])


@query("day_increment_lags", with_(ACTIVITY, f"inc AS (SELECT *, feature_01 - lag(feature_01) OVER {WSD} AS x FROM activity)")
       + f"SELECT {KSQL}, " + ", ".join(r_sql(f"lag(x, {k}) OVER {WSD}", f"lag_{k}") for k in range(1, 4)) + " FROM inc")
def day_increment_lags(spark, d):
    return rounded(H.day_lags(fx.activity(spark, d), "feature_01", 3, increments=True), K, [f"lag_{k}" for k in range(1, 4)])


@query("forward_labels", with_(TRADES_LABELLED) + f"SELECT {KSQL}, " + ", ".join(r_sql(f"responder_{r}", f"responder_{r}") for r in range(9)) + " FROM labelled")
def forward_labels(spark, d):
    t = fx.trades(spark, d).withColumns({"_ua": F.col("feature_00") - 4.2, "_ub": F.col("feature_05") - 3.8})
    out = H.forward_mean_labels(t, {"_ua": {6: 20, 7: 120, 8: 4}, "_ub": {3: 20, 4: 120, 5: 4}}, chunk_rows=CHUNK)
    return rounded(out, K, [f"responder_{r}" for r in range(9)])


@query("day_forward_mean", with_(ACTIVITY) + f"""SELECT {KSQL}, {r_sql('''CASE WHEN count(feature_01) OVER w = 4 THEN avg(feature_01) OVER w END''', 'fwd')}
 FROM activity WINDOW w AS (PARTITION BY symbol_id, date_id ORDER BY time_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def day_forward_mean(spark, d):
    return rounded(H.day_forward_means(fx.activity(spark, d), [("feature_01", 4, "fwd")]), K, ["fwd"])


@query("realized_mean", with_(TRADES, f"f AS (SELECT *, CASE WHEN count(feature_00) OVER w = 20 THEN avg(feature_00) OVER w END AS x FROM trades WINDOW w AS "
       "(PARTITION BY symbol_id ORDER BY date_id, time_id ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))")
       + f"SELECT {KSQL}, {r_sql(f'lag(x, 20) OVER {WS}', 'realized')} FROM f")
def realized_mean(spark, d):
    return rounded(H.realized_means(fx.trades(spark, d), [("feature_00", 20, "realized")], chunk_rows=CHUNK), K, ["realized"])


@query("first_difference", with_(ACTIVITY) + f"SELECT {KSQL}, {r_sql(f'coalesce(feature_01 - lag(feature_01) OVER {WSD}, 0)', 'd1')} FROM activity")
def first_difference(spark, d):
    return fx.activity(spark, d).select(*K, rnd(H.day_first_difference("feature_01")).alias("d1"))


@query("day_expanding", with_(TRADES) + f"""SELECT {KSQL}, {r_sql('feature_00 - avg(feature_00) OVER w', 'feature_00_day_dev')},
 {r_sql('CASE WHEN max(feature_00) OVER w > min(feature_00) OVER w THEN (feature_00 - min(feature_00) OVER w) / (max(feature_00) OVER w - min(feature_00) OVER w) END', 'feature_00_day_pos')}
 FROM trades WINDOW w AS (PARTITION BY symbol_id, date_id ORDER BY time_id ROWS UNBOUNDED PRECEDING)""")
def day_expanding_(spark, d):
    return rounded(day_expanding(fx.trades(spark, d), ["feature_00"]), K, ["feature_00_day_dev", "feature_00_day_pos"])


def _signature_sql(w: int, log: bool) -> str:
    """Pairs of points inside each window, straight from the iterated-sum definition."""
    chans = ["time_id / 23.0", "coalesce(feature_01, 0)", "coalesce(feature_02, 0)"]
    pts = f"""pts AS (SELECT {KSQL}, {', '.join(f'{c} AS c{i}' for i, c in enumerate(chans))},
      {', '.join(f'{c} - lag({c}) OVER {WSD} AS d{i}' for i, c in enumerate(chans))} FROM activity)"""
    pair = (f"pairs AS (SELECT a.symbol_id, a.date_id, a.time_id, "
            + ", ".join(f"coalesce(sum((k.c{i} - k.d{i} - s.c{i} + k.d{i} / 2) * k.d{j}), 0) AS s2_{i}_{j}" for i in range(3) for j in range(3)) + ", "
            + ", ".join(f"max(a.c{i} - s.c{i}) AS s1_{i}" for i in range(3))
            + f""" FROM pts a JOIN pts s ON a.symbol_id = s.symbol_id AND a.date_id = s.date_id AND s.time_id = greatest(a.time_id - {w - 1}, 0)
            LEFT JOIN pts k ON a.symbol_id = k.symbol_id AND a.date_id = k.date_id AND k.time_id > s.time_id AND k.time_id <= a.time_id GROUP BY 1, 2, 3)""")
    cols = [r_sql(f"s1_{i}", f"s1_{i}") for i in range(3)]
    if log:
        cols += [r_sql(f"(s2_{i}_{j} - s2_{j}_{i}) / 2", f"l2_{i}_{j}") for i in range(3) for j in range(i + 1, 3)]
    else:
        cols += [r_sql(f"s2_{i}_{j}", f"s2_{i}_{j}") for i in range(3) for j in range(3)]
    return with_(ACTIVITY, pts, pair) + f"SELECT {KSQL}, {', '.join(cols)} FROM pairs"


@query("path_signature", _signature_sql(8, False))
def path_signature(spark, d):
    out = window_signature(fx.activity(spark, d), ["feature_01", "feature_02"], 8, 24)
    return rounded(out, K, [f"s1_{i}" for i in range(3)] + [f"s2_{i}_{j}" for i in range(3) for j in range(3)])


@query("log_signature", _signature_sql(8, True))
def log_signature(spark, d):
    out = window_signature(fx.activity(spark, d), ["feature_01", "feature_02"], 8, 24, log=True)
    return rounded(out, K, [f"s1_{i}" for i in range(3)] + [f"l2_{i}_{j}" for i in range(3) for j in range(i + 1, 3)])


_ROLLED = ["feature_00", "feature_02", "feature_03"]
_PLAN = FeaturePlan(raw=TF, rolled=_ROLLED, rolling_rows=24, min_date=None, lagged=[3, 4, 5, 6, 7, 8], differences=True,
                    extra=["rank_per_time"], chunk_rows=CHUNK)


def _builder_sql() -> str:
    cols = [r_sql(f"t.{c}", c, 4) for c in TF]
    w = "(PARTITION BY symbol_id ORDER BY date_id, time_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    inner = []
    for c in _ROLLED:
        full = f"CASE WHEN count({c}) OVER {w} = 24 THEN"
        inner += [f"{full} {c} - avg({c}) OVER {w} END AS {rolling_diff(c, 24)}", f"{full} stddev_samp({c}) OVER {w} END AS {rolling_std(c, 24)}",
                  f"avg({c}) OVER {WDT} AS {market_avg(c)}",
                  f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY date_id, time_id ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY date_id, time_id, {c}) - 1) / 2.0 END AS {rank_name(c)}"]
    names = ([rolling_diff(c, 24) for c in _ROLLED] + [rolling_std(c, 24) for c in _ROLLED] + [market_avg(c) for c in _ROLLED] + [rank_name(c) for c in _ROLLED])
    cols += [r_sql(f"t.{n}", n, 4) for n in names]
    cols += ["round(CAST(t.time_id AS DOUBLE), 4) + 0.0 AS feature_time_id"]
    cols += [r_sql(f"l.{lag_name(r)}", lag_name(r), 4) for r in range(3, 9)]
    cols += [r_sql(f"l.responder_{a}_lag1d - l.responder_{b}_lag1d", n, 4) for n, (a, b) in _DIFFS.items()]
    return with_(TRADES_LABELLED, LAG1, f"wide AS (SELECT *, {', '.join(inner)} FROM trades)") + \
        f"SELECT t.symbol_id, t.date_id, t.time_id, {', '.join(cols)} FROM wide t JOIN lagged l USING (symbol_id, date_id, time_id)"


@query("feature_builder", _builder_sql())
def feature_builder(spark, d):
    panel = fx.trades_labelled(spark, d).select(*K, *TF, *[f"responder_{r}" for r in range(3, 9)]).persist()
    out = build_features(panel, replace(_PLAN, symbol_rows=fx.trades_steps(spark, d))).where("symbol_id IS NOT NULL")
    return out.select(*K, *[rnd(F.col(c).cast("double"), 4).alias(c) for c in _PLAN.columns()])


@query("feature_builder_stored")
def feature_builder_stored(spark, d):
    plan = FeaturePlan(raw=TF, rolled=TF, rolling_rows=48, min_date=None, lagged=list(range(9)), differences=True, realized=True,
                       extra=["rank_per_time", "ewma_per_symbol"], symbol_rows=fx.trades_steps(spark, d))
    return model_input(build_features(fx.trades_labelled(spark, d).persist(), plan), plan, [*K, "weight", "responder_6"])
