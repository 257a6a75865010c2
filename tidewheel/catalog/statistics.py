"""Aggregations, correlations and series forensics."""

import numpy as np
from pyspark.sql import functions as F

from tidewheel.catalog.registry import (ACTIVITY, ACTIVITY_CELLS, ACTIVITY_LABELLED, KSQL, K, TRADES, TRADES_LABELLED, WDT, WS, WSD, query,
                                        r_sql, rnd, rounded, with_)
from tidewheel.catalog.windows import LAG1
from tidewheel.operators import correlation as C
from tidewheel.operators import forensics as Z
from tidewheel.operators import moments as M
from tidewheel.operators import scores as R
from tidewheel.operators import structure as U
from tidewheel.operators.lags import previous_day
from tidewheel.operators.quantiles import exact_quantiles
from tidewheel.operators.signatures import rolling_signature, story_signature
from tidewheel.plans.atlas import atlas, report
from tidewheel.sources import fixtures as fx
from tidewheel.sources import panel as P

TF, AF = fx.TRADES_FEATURES, fx.ACTIVITY_FEATURES


def _long(names, stats) -> str:
    """Long table from per-column expressions: stats = {alias: template with {c}}."""
    parts = [f"unnest([{', '.join(repr(c) for c in names)}]) AS feature"]
    return ", ".join(parts + [f"unnest([{', '.join(t.format(c=c) for c in names)}]) AS \"{a}\"" for a, t in stats.items()])


SCORED = with_(TRADES_LABELLED, LAG1) + " "


@query("weighted_r2", SCORED + f"""SELECT {r_sql('1 - sum(weight * (responder_6_lag1d - responder_6) ** 2) / sum(weight * responder_6 ** 2)', 'r2')},
 {r_sql('sum(weight * (responder_6_lag1d - responder_6) ** 2) / sum(weight * responder_6 ** 2)', 'loss')} FROM lagged WHERE responder_6 IS NOT NULL""")
def weighted_r2(spark, d):
    t = previous_day(fx.trades_labelled(spark, d), [6]).where("responder_6 IS NOT NULL")
    a = ("responder_6", "responder_6_lag1d", "weight")
    return t.agg(rnd(R.r2_expr(*a)).alias("r2"), rnd(R.loss_expr(*a)).alias("loss"))


@query("weighted_mean", with_(TRADES) + f"SELECT date_id, {r_sql('sum(weight * feature_00) / sum(weight)', 'wm')} FROM trades GROUP BY 1")
def weighted_mean(spark, d):
    return fx.trades(spark, d).groupBy("date_id").agg(rnd(R.weighted_mean("feature_00", "weight")).alias("wm"))


@query("column_stats", with_(TRADES) + f"""SELECT feature, n, {r_sql('mean', 'mean')}, {r_sql('var', 'var')}, {r_sql('null_rate', 'null_rate')} FROM (
 SELECT {_long(TF, {'n': 'count({c})', 'mean': 'avg({c})', 'var': 'var_pop({c})', 'null_rate': '1 - count({c}) / count(*)'})} FROM trades)""")
def column_stats(spark, d):
    return rounded(M.column_stats(fx.trades(spark, d), TF), ["feature", "n"], ["mean", "var", "null_rate"])


DAILY = "daily AS (SELECT date_id, " + _long(TF, {"m": "avg({c})", "v": "var_pop({c})", "c": "count({c})"}) + " FROM trades GROUP BY date_id)," + \
    "shared AS (SELECT *, median(c) OVER (PARTITION BY date_id) AS n FROM daily)"


@query("running_moments", with_(TRADES, DAILY) + f"""SELECT date_id, feature, {r_sql('sum(n) OVER w', 'n')}, {r_sql('sum(n * m) OVER w / sum(n) OVER w', 'mean')},
 {r_sql('sqrt(greatest(sum(n * (v + m * m)) OVER w / sum(n) OVER w - (sum(n * m) OVER w / sum(n) OVER w) ** 2, 1e-12))', 'std')}
 FROM shared WINDOW w AS (PARTITION BY feature ORDER BY date_id)""")
def running_moments(spark, d):
    out = M.running_moments(M.daily_moments(fx.trades(spark, d), TF))
    return rounded(out, ["date_id", "feature"], ["n", "mean", "std"])


@query("clip_quantiles", with_(TRADES) + f"""SELECT feature, {r_sql('lo', 'lo')}, {r_sql('hi', 'hi')}, {r_sql('med', 'med')} FROM (
 SELECT {_long(TF, {'lo': 'quantile_cont({c}, 0.001)', 'hi': 'quantile_cont({c}, 0.999)', 'med': 'quantile_cont({c}, 0.5)'})} FROM trades)""")
def clip_quantiles(spark, d):
    q = exact_quantiles(fx.trades(spark, d).persist(), {c: [0.001, 0.999, 0.5] for c in TF})
    return rounded(spark.createDataFrame([(c, *v) for c, v in q.items()], "feature string, lo double, hi double, med double"), ["feature"], ["lo", "hi", "med"])


@query("price_quantiles", f"SELECT {', '.join(r_sql(f'quantile_cont(l_extendedprice, {p})', f'p{i}', 4) for i, p in enumerate((0.001, 0.25, 0.667, 0.999)))} FROM lineitem")
def price_quantiles(spark, d):
    q = exact_quantiles(fx.table(spark, d, "lineitem"), {"l_extendedprice": [0.001, 0.25, 0.667, 0.999]})["l_extendedprice"]
    return spark.createDataFrame([tuple(q)], "p0 double, p1 double, p2 double, p3 double").select(*[rnd(f"p{i}", 4).alias(f"p{i}") for i in range(4)])


@query("column_correlation", """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
 SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(corr(a.x, b.x), 6) + 0.0 AS corr FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2""")
def column_correlation(spark, d):
    m = C.array_correlation(fx.table(spark, d, "embeddings"), "embedding")
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(i + 1, len(m))]
    return rounded(spark.createDataFrame(rows, "i int, j int, corr double"), ["i", "j"], ["corr"])


SYMCORR = """SELECT a.symbol_id AS a, b.symbol_id AS b, count(*) AS n, round(corr(a.feature_00, b.feature_00), 6) + 0.0 AS corr
 FROM cells a JOIN cells b ON a.date_id = b.date_id AND a.time_id = b.time_id AND a.symbol_id < b.symbol_id GROUP BY 1, 2 HAVING count(*) >= 100"""


@query("symbol_correlation", with_(ACTIVITY_CELLS) + SYMCORR)
def symbol_correlation(spark, d):
    return rounded(C.symbol_correlation(fx.activity_cells(spark, d), "feature_00", 100), ["a", "b", "n"], ["corr"])


@query("target_correlations", with_(TRADES_LABELLED) + f"SELECT feature, {r_sql('corr', 'corr')} FROM (SELECT {_long(TF, {'corr': 'corr({c}, responder_6)'})} FROM labelled)")
def target_correlations(spark, d):
    return rounded(M.target_correlations(fx.trades_labelled(spark, d), TF, "responder_6"), ["feature"], ["corr"])


@query("market_share", with_(ACTIVITY, "w AS (SELECT " + KSQL + ", " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in AF) + " FROM activity)",
       "m AS (SELECT *, " + ", ".join(f"avg({c}) OVER (PARTITION BY date_id) AS d_{c}, avg({c}) OVER {WDT} AS s_{c}" for c in AF) + " FROM w)")
       + f"SELECT feature, {r_sql('share', 'market_share')} FROM (SELECT {_long(AF, {'share': 'sum((s_{c} - d_{c}) ** 2) / sum(({c} - d_{c}) ** 2)'})} FROM m)")
def market_share(spark, d):
    return rounded(U.market_share(P.complete_series(fx.activity(spark, d).persist(), 24), AF), ["feature"], ["market_share"])


@query("intraday_share", with_(ACTIVITY, "w AS (SELECT time_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in AF) + " FROM activity)",
       "p AS (SELECT time_id, " + ", ".join(f"avg({c}) AS {c}" for c in AF) + " FROM w GROUP BY 1)")
       + f"SELECT feature, {r_sql('a / b', 'intraday_share')} FROM (SELECT {_long(AF, {'a': 'var_pop({c})'})} FROM p) JOIN (SELECT {_long(AF, {'b': 'var_pop({c})'})} FROM w) USING (feature)")
def intraday_share(spark, d):
    return rounded(U.intraday_share(fx.activity(spark, d), AF), ["feature"], ["intraday_share"])


@query("overnight_continuity", with_(ACTIVITY, "e AS (SELECT symbol_id, date_id, " + ", ".join(
    f"max(CASE WHEN time_id = 0 THEN {c} END) AS f_{c}, max(CASE WHEN time_id = 23 THEN {c} END) AS l_{c}" for c in AF) + " FROM activity GROUP BY 1, 2)",
    "j AS (SELECT a.*, " + ", ".join(f"b.l_{c} AS p_{c}" for c in AF) + " FROM e a JOIN e b ON a.symbol_id = b.symbol_id AND a.date_id = b.date_id + 1)")
    + f"SELECT feature, n_pairs, {r_sql('corr', 'continuity')} FROM (SELECT {_long(AF, {'n_pairs': 'count(f_{c} + p_{c})', 'corr': 'corr(p_{c}, f_{c})'})} FROM j)")
def overnight_continuity(spark, d):
    t = P.complete_series(fx.activity(spark, d).persist(), 24)
    return rounded(U.overnight_continuity(t, AF), ["feature", "n_pairs"], ["continuity"])


@query("increment_stats", with_(TRADES, "dd AS (SELECT *, " + ", ".join(f"{c} - lag({c}) OVER {WS} AS d_{c}" for c in TF) + " FROM trades)",
       "ee AS (SELECT *, " + ", ".join(f"lag(d_{c}) OVER {WS} AS e_{c}" for c in TF) + " FROM dd)",
       "ps AS (SELECT symbol_id, " + ", ".join(f"var_samp(d_{c}) AS v_{c}, corr(d_{c}, e_{c}) AS r_{c}" for c in TF) + " FROM ee GROUP BY 1)")
       + f"SELECT feature, {r_sql('v', 'returns_var')}, {r_sql('r', 'autocorr_lag1')} FROM (SELECT {_long(TF, {'v': 'avg(v_{c})', 'r': 'avg(r_{c})'})} FROM ps)")
def increment_stats(spark, d):
    return rounded(U.increment_stats(fx.trades(spark, d), TF, chunk_rows=100), ["feature"], ["returns_var", "autocorr_lag1"])


@query("day_volatility", with_(TRADES_LABELLED) + f"SELECT symbol_id, date_id, {r_sql('avg(abs(coalesce(responder_8, 0)))', 'day_vol')} FROM labelled GROUP BY 1, 2")
def day_volatility(spark, d):
    return rounded(U.day_volatility(fx.trades_labelled(spark, d)), ["symbol_id", "date_id"], ["day_vol"])


@query("vol_threshold", with_(TRADES_LABELLED, "v AS (SELECT symbol_id, date_id, avg(abs(coalesce(responder_8, 0))) AS x FROM labelled WHERE date_id <= 20 GROUP BY 1, 2)")
       + f"SELECT {r_sql('quantile_cont(x, 2.0 / 3)', 'storm')}, {r_sql('median(x)', 'med')} FROM v")
def vol_threshold(spark, d):
    v = U.day_volatility(fx.trades_labelled(spark, d).where("date_id <= 20"))
    q = exact_quantiles(v, {"day_vol": [2 / 3, 0.5]})["day_vol"]
    return spark.createDataFrame([tuple(q)], "storm double, med double").select(rnd("storm").alias("storm"), rnd("med").alias("med"))


@query("symbol_profile", with_(TRADES, "p AS (SELECT symbol_id, " + ", ".join(f"coalesce(avg({c}), 0) AS {c}" for c in TF) + " FROM trades GROUP BY 1)")
       + "SELECT symbol_id, " + ", ".join(r_sql(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-9)", c) for c in TF) + " FROM p")
def symbol_profile(spark, d):
    return rounded(U.symbol_profile(fx.trades(spark, d), TF), ["symbol_id"], TF)


NATION = "m AS (SELECT s_suppkey AS symbol_id, s_nationkey % 3 AS cluster, s_suppkey % 4 AS other FROM supplier)"


@query("intra_inter", with_(ACTIVITY_CELLS, f"c AS ({SYMCORR})") + f"""SELECT {r_sql('avg(corr) FILTER (WHERE a % 3 = b % 3)', 'intra', 5)},
 {r_sql('avg(corr) FILTER (WHERE a % 3 <> b % 3)', 'inter', 5)} FROM c""")
def intra_inter(spark, d):
    cells = fx.activity_cells(spark, d)
    m = cells.select("symbol_id").distinct().withColumn("cluster", F.col("symbol_id") % 3)
    return rounded(C.intra_inter(C.symbol_correlation(cells, "feature_00", 100), m), [], ["intra", "inter"], 5)


@query("adjusted_rand", with_(NATION, "x AS (SELECT cluster, other, count(*) AS n FROM m GROUP BY 1, 2)",
       "i AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM x GROUP BY cluster))", "j AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM x GROUP BY other))",
       "t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS ij FROM x)")
       + f"SELECT {r_sql('(t.ij - i.v * j.v / (t.n * (t.n - 1) / 2)) / ((i.v + j.v) / 2 - i.v * j.v / (t.n * (t.n - 1) / 2))', 'ari')} FROM t, i, j")
def adjusted_rand(spark, d):
    s = fx.table(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("a"), (F.col("s_suppkey") % 4).alias("b"))
    return rounded(C.adjusted_rand(s, "a", "b"), [], ["ari"])


@query("cluster_sizes", "SELECT s_nationkey AS cluster, count(*) AS size, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS members FROM supplier GROUP BY 1")
def cluster_sizes(spark, d):
    m = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_nationkey").alias("cluster"))
    return C.cluster_sizes(m)


@query("unique_counts", with_(TRADES) + "SELECT date_id, count(DISTINCT symbol_id) AS n_symbols, count(DISTINCT time_id) AS n_times FROM trades GROUP BY 1")
def unique_counts(spark, d):
    return fx.trades(spark, d).groupBy("date_id").agg(F.countDistinct("symbol_id").alias("n_symbols"), F.countDistinct("time_id").alias("n_times"))


@query("gram_table", with_(TRADES_LABELLED) + "SELECT i, j, round(value, 3) + 0.0 AS value FROM (" + " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS i, {j}::INTEGER AS j, sum(weight * {a} * {b}) AS value FROM labelled WHERE responder_6 IS NOT NULL"
    for i, a in enumerate(TF[:2] + ["responder_6"]) for j, b in list(enumerate(TF[:2] + ["responder_6"]))[i:]) + ")")
def gram_table(spark, d):
    t = fx.trades_labelled(spark, d).where("responder_6 IS NOT NULL")
    return rounded(M.gram(t, [*TF[:2], "responder_6"], "weight"), ["i", "j"], ["value"], 3)


_PREDS = {"base": "0.2 * responder_8", "slow": "0.6 * responder_7", "mix": "0.2 * responder_8 + 0.3 * responder_7"}


@query("delta_vs_base", with_(TRADES_LABELLED, "r AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS variant, 1 - sum(weight * ({e} - responder_6) ** 2) / sum(weight * responder_6 ** 2) AS r2 FROM labelled WHERE responder_7 IS NOT NULL"
    for n, e in _PREDS.items()) + ")") + f"SELECT variant, {r_sql('r2', 'r2')}, {r_sql('''r2 - (SELECT r2 FROM r WHERE variant = 'base')''', 'delta_vs_base')} FROM r")
def delta_vs_base(spark, d):
    t = fx.trades_labelled(spark, d).where("responder_7 IS NOT NULL").withColumnsRenamed({"responder_6": "y", "weight": "w"})
    return rounded(R.delta_vs_base(R.variant_scores(t, _PREDS), "base"), ["variant"], ["r2", "delta_vs_base"])


@query("daily_report", SCORED + f"""SELECT date_id, {r_sql('1 - sum(weight * (responder_6_lag1d - responder_6) ** 2) / sum(weight * responder_6 ** 2)', 'r2')},
 {r_sql('avg(responder_6_lag1d)', 'pred_mean')}, {r_sql('stddev_pop(responder_6_lag1d)', 'pred_std')}, {r_sql('max(abs(responder_6_lag1d))', 'pred_max_abs')}, count(*) AS n_rows
 FROM lagged WHERE responder_6 IS NOT NULL GROUP BY 1""")
def daily_report(spark, d):
    t = previous_day(fx.trades_labelled(spark, d).persist(), [6]).withColumnsRenamed({"responder_6": "y", "responder_6_lag1d": "pred", "weight": "w"})
    return rounded(R.daily_report(t, ["date_id"]), ["date_id", "n_rows"], ["r2", "pred_mean", "pred_std", "pred_max_abs"])


# -- forensics --------------------------------------------------------------------

def _unit_cte(cols) -> str:
    """Complete, mean-imputed, demeaned, unit-deviation series with a valid flag."""
    s = "(PARTITION BY symbol_id, date_id)"
    mid = ", ".join(f"coalesce({c} - avg({c}) OVER {s}, 0) AS x_{c}, avg(({c} IS NULL)::INT) OVER {s} AS nn_{c}" for c in cols)
    z = ", ".join(f"CASE WHEN stddev_pop(x_{c}) OVER {s} > 1e-9 THEN x_{c} / stddev_pop(x_{c}) OVER {s} ELSE 0 END AS z_{c}, "
                  f"stddev_pop(x_{c}) OVER {s} > 1e-9 AND nn_{c} < 0.5 AS ok_{c}" for c in cols)
    return f"mid AS (SELECT *, {mid} FROM labelled), unit AS (SELECT {KSQL}, {z} FROM mid)"


@query("normalise_series", with_(ACTIVITY_LABELLED, _unit_cte(AF[:2])) + f"SELECT {KSQL}, {r_sql('z_feature_00', 'feature_00_z')}, ok_feature_00 AS feature_00_ok, {r_sql('z_feature_01', 'feature_01_z')}, ok_feature_01 AS feature_01_ok FROM unit")
def normalise_series(spark, d):
    out = Z.normalise(fx.activity_labelled(spark, d), AF[:2])
    return out.select(*K, *[rnd(f"{c}_z").alias(f"{c}_z") for c in AF[:2]], *[f"{c}_ok" for c in AF[:2]])


_ACF = """a AS (SELECT f.symbol_id, f.date_id, s.time_id - f.time_id AS lag, sum(f.z_{c} * s.z_{c}) / (24 - (s.time_id - f.time_id)) AS v
 FROM unit f JOIN unit s ON f.symbol_id = s.symbol_id AND f.date_id = s.date_id AND s.time_id - f.time_id BETWEEN 0 AND 10 WHERE f.ok_{c} GROUP BY 1, 2, 3),
 acf AS (SELECT lag, avg(v / v0) AS corr, count(*) AS n_series FROM a JOIN (SELECT symbol_id, date_id, v AS v0 FROM a WHERE lag = 0) USING (symbol_id, date_id) GROUP BY 1)"""


@query("autocorrelation", with_(ACTIVITY_LABELLED, _unit_cte(["feature_01"]), _ACF.format(c="feature_01")) + f"SELECT CAST(lag AS INTEGER) AS lag, n_series, {r_sql('corr', 'corr')} FROM acf")
def autocorrelation(spark, d):
    out = Z.lag_curves(fx.activity_labelled(spark, d), ["feature_01"], [], 0, 10, 24)
    return rounded(out.where("kind = 'acf'"), ["lag", "n_series"], ["corr"])


_LL = """ll AS (SELECT lag, avg(v) AS corr, count(*) AS n_series FROM (SELECT f.symbol_id, f.date_id, s.time_id - f.time_id AS lag,
 sum(f.z_feature_01 * s.z_responder_8) / (24 - abs(s.time_id - f.time_id)) AS v FROM unit f JOIN unit s ON f.symbol_id = s.symbol_id AND f.date_id = s.date_id
 AND abs(s.time_id - f.time_id) <= 6 WHERE f.ok_feature_01 AND s.ok_responder_8 GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("lead_lag", with_(ACTIVITY_LABELLED, _unit_cte(["feature_01", "responder_8"]), _LL) + f"SELECT CAST(lag AS INTEGER) AS lag, n_series, {r_sql('corr', 'corr')} FROM ll")
def lead_lag(spark, d):
    out = Z.lag_curves(fx.activity_labelled(spark, d), ["feature_01"], ["responder_8"], 6, 10, 24)
    return rounded(out.where("kind = 'll:responder_8'"), ["lag", "n_series"], ["corr"])


@query("lead_lag_bands", with_(ACTIVITY_LABELLED, _unit_cte(["feature_01", "responder_8"]), _LL) + f"""SELECT {r_sql('avg(corr) FILTER (WHERE lag BETWEEN 1 AND 4)', 'alpha_score')},
 {r_sql('avg(corr) FILTER (WHERE lag BETWEEN -4 AND 0)', 'nowcast_score')}, {r_sql('arg_max(corr, abs(corr))', 'peak_corr')}, CAST(arg_max(lag, abs(corr)) AS INTEGER) AS peak_lag FROM ll""")
def lead_lag_bands(spark, d):
    curves = Z.lag_curves(fx.activity_labelled(spark, d), ["feature_01"], ["responder_8"], 6, 10, 24)
    out = Z.lead_lag_summary(curves, "responder_8", (1, 4), (-4, 0))
    return rounded(out, ["peak_lag"], ["alpha_score", "nowcast_score", "peak_corr"])


@query("acf_summary", with_(ACTIVITY_LABELLED, _unit_cte(["responder_6"]), _ACF.format(c="responder_6"),
       "cut AS (SELECT coalesce(min(lag) FILTER (WHERE corr < 0.05), -1) AS c FROM acf)") + f"""SELECT {r_sql('max(corr) FILTER (WHERE lag = 1)', 'acf1')},
 CAST(coalesce(min(lag) FILTER (WHERE corr < 0.5), -1) AS INTEGER) AS halflife, CAST(max(c) AS INTEGER) AS cutoff_005,
 {r_sql('CASE WHEN max(c) >= 3 THEN regr_r2(corr, lag) FILTER (WHERE lag <= c) END', 'ramp_linearity_r2')} FROM acf, cut""")
def acf_summary(spark, d):
    curves = Z.lag_curves(fx.activity_labelled(spark, d), ["responder_6"], [], 0, 10, 24)
    return rounded(Z.acf_summary(curves), ["halflife", "cutoff_005"], ["acf1", "ramp_linearity_r2"])


def _spectrum_sql(w: int, bands) -> str:
    import math
    x = [f"coalesce(lag(feature_01, {w - 1 - j}) OVER {WSD}, 0)" for j in range(w)]
    bins = {k: "(" + " + ".join(f"{math.cos(2 * math.pi * k * j / w)!r} * {x[j]}" for j in range(w)) + ") ** 2 + ("
            + " + ".join(f"{math.sin(2 * math.pi * k * j / w)!r} * {x[j]}" for j in range(w)) + ") ** 2" for k in range(1, w // 2 + 1)}
    cte = "e AS (SELECT symbol_id, date_id, time_id, " + ", ".join(f"{v} AS e{k}" for k, v in bins.items()) + " FROM activity)"
    total = " + ".join(f"e{k}" for k in bins)
    cols = [r_sql(f"CASE WHEN time_id >= {w - 1} THEN ln(({' + '.join(f'e{k}' for k in range(lo, hi))}) / ({total} + 1e-12) + 1e-6) END", f"feature_01_band{b}", 4)
            for b, (lo, hi) in enumerate(bands)]
    return with_(ACTIVITY, cte) + f"SELECT {KSQL}, {', '.join(cols)} FROM e"


_BANDS = [(1, 2), (2, 3), (3, 5)]


@query("band_energy", _spectrum_sql(8, _BANDS))
def band_energy(spark, d):
    out = Z.band_energy(fx.activity(spark, d), ["feature_01"], 8, _BANDS, 24)
    return rounded(out, K, [f"feature_01_band{b}" for b in range(3)], 4)


def _inverse_values(t: int, rows: int, lam: float) -> str:
    """The ridge inverse as a VALUES list, from its normal equations."""
    a = np.array([[1.0 / rows if i <= j < i + rows else 0.0 for j in range(t + rows - 1)] for i in range(t)])
    m = np.linalg.inv(a.T @ a + lam * np.eye(t + rows - 1)) @ a.T
    return ", ".join(f"({i}, {j}, {float(m[i, j])!r}::DOUBLE)" for i in range(t + rows - 1) for j in range(t))


@query("deconvolution", with_(ACTIVITY_LABELLED, f"m(i, j, v) AS (VALUES {_inverse_values(24, 4, 0.5)})",
       "s AS (SELECT symbol_id, date_id, i, sum(v * coalesce(responder_8, 0)) AS s FROM labelled JOIN m ON j = time_id GROUP BY 1, 2, 3)")
       + f"""SELECT symbol_id, date_id, CAST(i AS INTEGER) AS time_id, {r_sql('s', 'signal', 5)}, {r_sql('coalesce(n1, 0)', 'innov1', 5)}, {r_sql('(coalesce(n1, 0) + coalesce(n2, 0) + coalesce(n3, 0) + coalesce(n4, 0)) / 4', 'innov4', 5)}
 FROM (SELECT *, lead(s, 1) OVER q AS n1, lead(s, 2) OVER q AS n2, lead(s, 3) OVER q AS n3, lead(s, 4) OVER q AS n4 FROM s WINDOW q AS (PARTITION BY symbol_id, date_id ORDER BY i)) WHERE i < 24""")
def deconvolution(spark, d):
    out = Z.deconvolve(fx.activity_labelled(spark, d), "responder_8", 4, 0.5, 24)
    return rounded(out, K, ["signal", "innov1", "innov4"], 5)


def _tuples_sql(window: int, depth: int, hurst: float | None, log: bool, digits: int) -> str:
    """(Log-)signature as sums over ordered tuples of increments, equal ones weighted 1/k!."""
    chans = ["time_id / 23.0", "coalesce(feature_01, 0)", "coalesce(feature_02, 0)"]
    n = len(chans)
    pts = f"pts AS (SELECT {KSQL}, {', '.join(f'{c} - lag({c}) OVER {WSD} AS d{i}' for i, c in enumerate(chans))} FROM activity)"
    # Increment k of a window starting at s of m points: it starts at (k - s - 1) / (m - 1).
    weight = f"power(1 - (k.time_id - s - 1.0) / greatest(a.time_id - s, 1) + 1e-6, {hurst - 0.5})" if hurst is not None else "1.0"
    win = (f"inc AS (SELECT a.symbol_id, a.date_id, a.time_id, k.time_id AS p, {', '.join(f'k.d{i} * {weight} AS d{i}' for i in range(n))} "
           f"FROM (SELECT *, greatest(time_id - {window - 1}, 0) AS s FROM pts) a JOIN pts k ON a.symbol_id = k.symbol_id AND a.date_id = k.date_id AND k.time_id > s AND k.time_id <= a.time_id)")
    s1 = f"l1 AS (SELECT {KSQL}, {', '.join(f'sum(d{i}) AS s{i}' for i in range(n))} FROM inc GROUP BY ALL)"
    on = "x.symbol_id = y.symbol_id AND x.date_id = y.date_id AND x.time_id = y.time_id AND x.p <= y.p"
    f2 = "CASE WHEN x.p = y.p THEN 0.5 ELSE 1.0 END"
    s2 = ("l2 AS (SELECT x.symbol_id, x.date_id, x.time_id, " + ", ".join(f"sum(x.d{i} * y.d{j} * {f2}) AS s{i}{j}" for i in range(n) for j in range(n))
          + f" FROM inc x JOIN inc y ON {on} GROUP BY ALL)")
    ctes, joins = [ACTIVITY, pts, win, s1, s2], "LEFT JOIN l1 USING (symbol_id, date_id, time_id) LEFT JOIN l2 USING (symbol_id, date_id, time_id)"
    if depth == 3:
        f3 = "CASE WHEN x.p = y.p AND y.p = z.p THEN 1.0 / 6 WHEN x.p = y.p OR y.p = z.p THEN 0.5 ELSE 1.0 END"
        ctes.append("l3 AS (SELECT x.symbol_id, x.date_id, x.time_id, " + ", ".join(
            f"sum(x.d{i} * y.d{j} * z.d{k} * {f3}) AS s{i}{j}{k}" for i in range(n) for j in range(n) for k in range(n))
            + f" FROM inc x JOIN inc y ON {on} JOIN inc z ON y.symbol_id = z.symbol_id AND y.date_id = z.date_id AND y.time_id = z.time_id AND y.p <= z.p GROUP BY ALL)")
        joins += " LEFT JOIN l3 USING (symbol_id, date_id, time_id)"
    out = [f"s{i}" for i in range(n)]
    if not log:
        out += [f"s{i}{j}" for i in range(n) for j in range(n)]
    else:
        out += [f"s{i}{j} - s{i} * s{j} / 2" for i in range(n) for j in range(i + 1, n)]
        if depth == 3:
            out += [f"s{i}{j}{k} - (s{i} * s{j}{k} + s{i}{j} * s{k}) / 2 + s{i} * s{j} * s{k} / 3" for i in range(n) for j in range(n) for k in range(n)]
    return with_(*ctes) + f"SELECT {KSQL}, {', '.join(r_sql(f'coalesce({e}, 0)', f'c{i:02d}', digits) for i, e in enumerate(out))} FROM activity {joins}"


def _components(df, n: int, digits: int):
    return df.select(*K, *[rnd(F.col("signature")[i], digits).alias(f"c{i:02d}") for i in range(n)])


@query("rough_signature", _tuples_sql(8, 2, 0.1, False, 4))
def rough_signature(spark, d):
    return _components(rolling_signature(fx.activity(spark, d), ["feature_01", "feature_02"], 8, 2, 0.1, False, 24), 12, 4)


@query("depth3_log_signature", _tuples_sql(6, 3, None, True, 5))
def depth3_log_signature(spark, d):
    return _components(rolling_signature(fx.activity(spark, d), ["feature_01", "feature_02"], 6, 3, None, True, 24), 33, 5)


@query("story_signature", with_(ACTIVITY_LABELLED, "pts AS (SELECT symbol_id, a.date_id + k AS date_id, (5 - k) * 24 + time_id AS pos, coalesce(responder_6, 0) AS b, coalesce(responder_8, 0) AS c "
       "FROM labelled a, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS k) WHERE a.date_id + k <= 29)",
       "path AS (SELECT *, pos / 4 / 29.0 AS a, count(*) OVER (PARTITION BY symbol_id, date_id) AS n FROM pts WHERE pos % 4 = 0)",
       "inc AS (SELECT *, a - lag(a) OVER q AS da, b - lag(b) OVER q AS db, c - lag(c) OVER q AS dc FROM path WHERE n = 30 WINDOW q AS (PARTITION BY symbol_id, date_id ORDER BY pos))",
       "l1 AS (SELECT symbol_id, date_id, sum(da) AS sa, sum(db) AS sb, sum(dc) AS sc FROM inc GROUP BY 1, 2)",
       "l2 AS (SELECT x.symbol_id, x.date_id, sum(x.da * y.db - x.db * y.da) / 2 AS ab, sum(x.da * y.dc - x.dc * y.da) / 2 AS ac, sum(x.db * y.dc - x.dc * y.db) / 2 AS bc "
       "FROM inc x JOIN inc y ON x.symbol_id = y.symbol_id AND x.date_id = y.date_id AND x.pos < y.pos GROUP BY 1, 2)")
       + "SELECT symbol_id, date_id, " + ", ".join(r_sql(e, f"c{i:02d}", 5) for i, e in enumerate(("sa", "sb", "sc", "ab", "ac", "bc"))) + " FROM l1 JOIN l2 USING (symbol_id, date_id)")
def story_signature_(spark, d):
    out = story_signature(fx.activity_labelled(spark, d), ["responder_6", "responder_8"], 5, 4, 24)
    return out.select("symbol_id", "date_id", *[rnd(F.col("signature")[i], 5).alias(f"c{i:02d}") for i in range(6)])


@query("column_atlas")
def column_atlas(spark, d):
    cols = [*AF, "responder_6", "responder_8"]
    table, _ = atlas(fx.activity_labelled(spark, d).persist(), cols, 24, 6, 10, (1, 4), (-4, 0))
    return table


@query("atlas_report")
def atlas_report(spark, d):
    table, _ = atlas(fx.activity_labelled(spark, d).persist(), AF, 24, 6, 10, (1, 4), (-4, 0))
    return report(table)
