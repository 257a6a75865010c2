"""Splits, preprocessing, blends, calibration and diagnostics."""

import itertools
from functools import reduce

from pyspark.sql import functions as F

from tidewheel.catalog.registry import (K, KSQL, TRADES, TRADES_LABELLED, WDT, query, r_sql, rnd, rounded, with_)
from tidewheel.catalog.sources import DRAWS, RANKED
from tidewheel.catalog.windows import LAG1
from tidewheel.operators import diagnostics as G
from tidewheel.operators import ensemble as B
from tidewheel.operators import evaluate as E
from tidewheel.operators import preprocess as N
from tidewheel.operators.crosssection import step_means
from tidewheel.operators.lags import previous_day
from tidewheel.operators.moments import target_correlations
from tidewheel.operators.scores import r2, r2_expr
from tidewheel.plans.blend import blend_report
from tidewheel.plans.features import FeaturePlan, build_features
from tidewheel.plans.pool import build_pool, enrich, nested_variants, read_pool, write_pool
from tidewheel.session import scratch_path
from tidewheel.sources import fixtures as fx
from tidewheel.sources import panel as P
from tidewheel.sources import sinks

TF = fx.TRADES_FEATURES

# -- prediction streams over the trades panel ---------------------------------------

FEW_STEPS = 100_000  # a table of a row per step is broadcast up to here
STREAM_NAMES = ["lag", "slow", "market", "mom"]
STREAMS = f"""base AS (SELECT *, avg(responder_6_lag1d) OVER {WDT} AS mkt FROM lagged),
valid AS (SELECT {KSQL}, responder_6 AS y, weight AS w, 0.5 * responder_6_lag1d AS p_lag, 0.6 * responder_7_lag1d AS p_slow, mkt AS p_market,
 0.3 * (responder_8_lag1d - responder_6_lag1d) AS p_mom, abs(responder_6_lag1d) + 0.05 AS vol FROM base WHERE responder_6 IS NOT NULL),
streams AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS stream, {KSQL}, y, w, p_{n} AS pred, vol FROM valid" for n in STREAM_NAMES) + ")"
SW = with_(TRADES_LABELLED, LAG1, STREAMS)


def R2SQL(p: str, w: str = "w") -> str:  # noqa: N802
    return f"1 - sum({w} * ({p} - y) ** 2) / sum({w} * y ** 2)"


def streams(spark, d, vol: bool = False, names=STREAM_NAMES):
    """The named streams; what they are made of is kept, once for all of them."""
    t = previous_day(fx.trades_labelled(spark, d), [6, 7, 8]).select(*K, "weight", "responder_6", *[f"responder_{r}_lag1d" for r in (6, 7, 8)]).persist()
    means = step_means(t, ["responder_6_lag1d"])
    if fx.trades_steps(spark, d) <= FEW_STEPS:
        means = F.broadcast(means)
    t = t.join(means, ["date_id", "time_id"]).where("responder_6 IS NOT NULL")
    a, b, c = (F.col(f"responder_{r}_lag1d") for r in (6, 7, 8))
    preds = {"lag": 0.5 * a, "slow": 0.6 * b, "market": F.col("_mkt_responder_6_lag1d"), "mom": 0.3 * (c - a)}
    pairs = F.array(*[F.struct(F.lit(n).alias("stream"), preds[n].alias("pred")) for n in names])
    extra = [(F.abs(a) + 0.05).alias("vol")] if vol else []
    return (t.select(*K, F.col("responder_6").alias("y"), F.col("weight").alias("w"), *extra, F.explode(pairs).alias("_p"))
            .select(*K, "y", "w", *[F.col("vol") for _ in extra], "_p.*"))


def one(spark, d, name: str):
    """A single stream."""
    return streams(spark, d, vol=True, names=[name])


@query("stream_scores", SW + f"SELECT stream, {r_sql(R2SQL('pred'), 'r2')} FROM streams GROUP BY 1")
def stream_scores(spark, d):
    return rounded(B.singles(streams(spark, d)), ["stream"], ["r2"])


@query("stream_alignment", SW + f"SELECT {KSQL}, {r_sql('y', 'y')}, w, " + ", ".join(r_sql(f"p_{n}", n) for n in STREAM_NAMES) + " FROM valid")
def stream_alignment(spark, d):
    return rounded(B.align(streams(spark, d), STREAM_NAMES), [*K, "w"], ["y", *STREAM_NAMES])


@query("stream_correlation", SW + "SELECT a, b, round(corr, 6) + 0.0 AS corr FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(p_{a}, p_{b}) AS corr FROM valid" for i, a in enumerate(STREAM_NAMES) for b in STREAM_NAMES[i + 1:]) + ")")
def stream_correlation(spark, d):
    return rounded(B.pairwise(streams(spark, d), STREAM_NAMES), ["a", "b"], ["corr"])


@query("equal_blend", SW + f"SELECT {KSQL}, {r_sql('(p_lag + p_slow + p_market) / 3', 'pred')} FROM valid")
def equal_blend(spark, d):
    return rounded(B.blend(streams(spark, d), ["lag", "slow", "market"], "mean3"), K, ["pred"])


@query("nested_bag_blend", SW + f"SELECT {KSQL}, {r_sql('((p_lag + p_slow) / 2 + p_market + p_mom) / 3', 'pred')} FROM valid")
def nested_bag_blend(spark, d):
    return rounded(B.nested_blend(streams(spark, d), {"bag": ["lag", "slow"]}, "nested"), K, ["pred"])


@query("renormalised_blend", SW + f"""SELECT {KSQL}, {r_sql('''(0.5 * p_lag + 0.3 * p_slow + CASE WHEN symbol_id % 3 <> 0 THEN 0.2 * p_market ELSE 0 END)
 / (0.8 + CASE WHEN symbol_id % 3 <> 0 THEN 0.2 ELSE 0 END)''', 'pred')} FROM valid""")
def renormalised_blend(spark, d):
    s = streams(spark, d).where("NOT (stream = 'market' AND symbol_id % 3 = 0)")
    return rounded(B.weighted_blend(s, {"lag": 0.5, "slow": 0.3, "market": 0.2}, "w"), K, ["pred"])


HIST = f"""dr AS (SELECT date_id, dense_rank() OVER (ORDER BY date_id) AS rk FROM (SELECT DISTINCT date_id FROM valid)),
hist AS (SELECT stream, symbol_id, rk, date_id, sum(n) OVER w AS n, sum(py) OVER w AS py, sum(pp) OVER w AS pp FROM
 (SELECT stream, symbol_id, date_id, count(*) AS n, sum(w * pred * y) AS py, sum(w * pred * pred) AS pp FROM streams GROUP BY 1, 2, 3) JOIN dr USING (date_id)
 WINDOW w AS (PARTITION BY stream, symbol_id ORDER BY rk RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)),
cal AS (SELECT s.*, CASE WHEN h.n >= 50 AND h.pp > 0 THEN least(greatest((h.py / (h.pp + 1e-12) + 3) / 4, 0), 1.5) ELSE 1.0 END AS alpha,
 CASE WHEN h.n >= 50 AND h.pp > 2 * h.py THEN 0.3 ELSE 1.0 END AS gate FROM streams s JOIN hist h USING (stream, symbol_id, date_id))"""


@query("trailing_history", SW[:-1] + "," + HIST + f"""SELECT stream, symbol_id, date_id, CAST(coalesce(n, 0) AS BIGINT) AS hist_n, {r_sql('coalesce(py, 0)', 'hist_py')},
 {r_sql('coalesce(pp, 0)', 'hist_pp')} FROM hist""")
def trailing_history(spark, d):
    return rounded(B.trailing_history(streams(spark, d)), ["stream", "symbol_id", "date_id", "hist_n"], ["hist_py", "hist_pp"])


@query("trailing_calibration", SW[:-1] + "," + HIST + f"SELECT stream, {KSQL}, {r_sql('alpha', 'alpha')}, {r_sql('pred * alpha', 'pred')} FROM cal")
def trailing_calibration(spark, d):
    return rounded(B.calibrate(streams(spark, d), min_rows=50), ["stream", *K], ["alpha", "pred"])


@query("hard_damping", SW[:-1] + "," + HIST + f"SELECT stream, {r_sql(R2SQL('(pred * gate)'), 'r2')} FROM cal GROUP BY 1")
def hard_damping(spark, d):
    return rounded(r2(B.damped(streams(spark, d), min_rows=50), ["stream"]), ["stream"], ["r2"])


_G = (0.1, 0.2, 0.3)
_VS = "(SELECT sum(w * vol) / sum(w) FROM valid WHERE date_id <= 18)"
GAMMA = "gs AS (" + " UNION ALL ".join(
    f"SELECT {g}::DOUBLE AS gamma, " + ", ".join(f"(1 - sum(w * (p_lag * power(vol / v, {g}) - y) ** 2) FILTER (WHERE {c}) / sum(w * y * y) FILTER (WHERE {c})) AS r2_{n}"
                                                 for n, c in (("h1", "date_id <= 18"), ("h2", "date_id > 18"), ("full", "true")))
    + f" FROM valid, (SELECT {_VS} AS v)" for g in _G) + ")"


@query("volatility_scaling", SW[:-1] + "," + GAMMA + "\nSELECT gamma, " + ", ".join(r_sql(f"r2_{n}", f"r2_{n}") for n in ("h1", "h2", "full")) + " FROM gs")
def volatility_scaling(spark, d):
    return rounded(B.gamma_scores(one(spark, d, "lag"), 18, _G), ["gamma"], ["r2_h1", "r2_h2", "r2_full"])


@query("best_gamma", SW[:-1] + "," + GAMMA + "\nSELECT gamma, " + ", ".join(r_sql(f"r2_{n}", f"r2_{n}") for n in ("h1", "h2", "full")) + " FROM gs ORDER BY gs.r2_h1 DESC, gamma LIMIT 1")
def best_gamma(spark, d):
    return rounded(B.best_gamma(B.gamma_scores(one(spark, d, "lag"), 18, _G)), ["gamma"], ["r2_h1", "r2_h2", "r2_full"])


_COMBOS = {"mean2": ["lag", "slow"], "mean4": STREAM_NAMES}
_G6 = (0.1, 0.15, 0.2, 0.25, 0.3, 0.4)
REPORT = ("bl AS (" + " UNION ALL ".join(f"SELECT '{c}' AS stream, {KSQL}, y, w, vol, ({' + '.join(f'p_{n}' for n in ms)}) / {len(ms)} AS pred FROM valid" for c, ms in _COMBOS.items()) + "),"
          "bdr AS (SELECT date_id, dense_rank() OVER (ORDER BY date_id) AS rk FROM (SELECT DISTINCT date_id FROM valid)),"
          "bh AS (SELECT stream, symbol_id, date_id, sum(n) OVER q AS n, sum(py) OVER q AS py, sum(pp) OVER q AS pp FROM (SELECT stream, symbol_id, date_id, count(*) AS n, sum(w * pred * y) AS py, sum(w * pred * pred) AS pp FROM bl GROUP BY 1, 2, 3)"
          " JOIN bdr USING (date_id) WINDOW q AS (PARTITION BY stream, symbol_id ORDER BY rk RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)),"
          "bc AS (SELECT bl.*, pred * CASE WHEN bh.n >= 50 AND bh.pp > 0 THEN least(greatest((bh.py / (bh.pp + 1e-12) + 3) / 4, 0), 1.5) ELSE 1 END AS cal FROM bl JOIN bh USING (stream, symbol_id, date_id)),"
          "v AS (SELECT sum(w * vol) / sum(w) AS m FROM valid WHERE date_id <= 18),"
          "gs AS (" + " UNION ALL ".join(
              f"SELECT stream, {g}::DOUBLE AS gamma, " + ", ".join(f"1 - sum(w * (cal * power(vol / m, {g}) - y) ** 2) FILTER (WHERE {c}) / sum(w * y * y) FILTER (WHERE {c}) AS r_{n}"
                                                                    for n, c in (("h1", "date_id <= 18"), ("h2", "date_id > 18"), ("full", "true"))) + " FROM bc, v GROUP BY stream" for g in _G6) + "),"
          "bg AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY r_h1 DESC, gamma) AS i FROM gs),"
          "br AS (SELECT stream, 1 - sum(w * (pred - y) ** 2) / sum(w * y * y) AS raw_full, 1 - sum(w * (cal - y) ** 2) / sum(w * y * y) AS cal_full,"
          " 1 - sum(w * (cal - y) ** 2) FILTER (WHERE date_id > 18) / sum(w * y * y) FILTER (WHERE date_id > 18) AS cal_h2 FROM bc GROUP BY stream)")


def _report(spark, d):
    s = streams(spark, d, vol=True)
    return blend_report(s, _COMBOS, s.where("stream = 'lag'").select(*K, "vol"), 18, min_rows=50)


@query("blend_report_combos", SW[:-1] + "," + REPORT + f"""\nSELECT stream, gamma, {r_sql('raw_full', 'raw_full')}, {r_sql('cal_full', 'cal_full')}, {r_sql('cal_h2', 'cal_h2')},
 {r_sql('r_full', 'cal_vol_full')}, {r_sql('r_h2', 'cal_vol_h2')} FROM br JOIN bg USING (stream) WHERE i = 1""")
def blend_report_combos(spark, d):
    return rounded(_report(spark, d)[2], ["stream", "gamma"], ["raw_full", "cal_full", "cal_h2", "cal_vol_full", "cal_vol_h2"])


@query("blend_report_singles", SW + f"SELECT stream, {r_sql(R2SQL('pred'), 'r2')} FROM streams GROUP BY 1")
def blend_report_singles(spark, d):
    return rounded(_report(spark, d)[0], ["stream"], ["r2"])


_MEMBERS = sorted({m for ms in _COMBOS.values() for m in ms})


@query("blend_report_pairwise", SW + "SELECT a, b, round(corr, 6) + 0.0 AS corr FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(p_{a}, p_{b}) AS corr FROM valid" for a, b in itertools.combinations(_MEMBERS, 2)) + ")")
def blend_report_pairwise(spark, d):
    return rounded(_report(spark, d)[1], ["a", "b"], ["corr"])


@query("admission_rule", SW + f"""SELECT {r_sql('solo', 'solo')}, {r_sql('bw', 'blend_with')}, {r_sql('bo', 'blend_without')}, {r_sql('mc', 'max_corr')},
 solo >= 0 AND mc < 0.9 AND bw > bo AS admit FROM (SELECT {R2SQL('p_mom')} AS solo, {R2SQL('((p_lag + p_slow + p_mom) / 3)')} AS bw,
 {R2SQL('((p_lag + p_slow) / 2)')} AS bo, greatest(corr(p_mom, p_lag), corr(p_mom, p_slow)) AS mc FROM valid)""")
def admission_rule(spark, d):
    return rounded(B.admission(streams(spark, d), "mom", ["lag", "slow"]), ["admit"], ["solo", "blend_with", "blend_without", "max_corr"])


@query("stack_features", SW + f"""SELECT {KSQL}, {r_sql('p_lag', 'lag')}, {r_sql('p_slow', 'slow')}, {r_sql('p_slow - p_lag', 'slow_minus_base')},
 {r_sql('p_mom', 'mom')}, {r_sql('p_mom - p_lag', 'mom_minus_base')} FROM valid""")
def stack_features(spark, d):
    out, cols = B.stack_features(B.align(streams(spark, d), STREAM_NAMES), ["lag", "slow", "mom"], "lag")
    return rounded(out, K, cols)


_HALF = "(SELECT count(*) // 2 FROM valid)"


@query("half_split", SW + f"SELECT {KSQL}, row_number() OVER (ORDER BY date_id, time_id, symbol_id) <= {_HALF} AS first_half FROM valid")
def half_split(spark, d):
    rows = one(spark, d, "lag")
    return rows.select(*K, E.half_split(rows).alias("first_half"))


def _determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return f"({m[0][0]})"
    minors = (_determinant([row[:j] + row[j + 1:] for row in m[1:]]) for j in range(len(m)))
    return "(" + " ".join(f"{'-' if j % 2 else '+'} ({m[0][j]}) * ({d})" for j, d in enumerate(minors)) + ")"


def _simplex_sql(names: list[str]) -> str:
    """Every face's optimum by Cramer's rule; the best that has no negative weight."""
    q = {(a, b): f"q_{min(a, b)}_{max(a, b)}" for a in names for b in names}
    sums = [f"sum(w * p_{a} * p_{b}) FILTER (WHERE h) AS {q[a, b]}" for i, a in enumerate(sorted(names)) for b in sorted(names)[i:]]
    sums += [f"sum(w * p_{a} * y) FILTER (WHERE h) AS b_{a}" for a in names]
    faces = []
    for size in range(1, len(names) + 1):
        for face in itertools.combinations(names, size):
            *some, last = face
            rows = [[f"{q[a, c]} - {q[a, last]} - {q[last, c]} + {q[last, last]}" for c in some] for a in some]
            right = [f"b_{a} - b_{last} - {q[a, last]} + {q[last, last]}" for a in some]
            share = {a: f"{_determinant([row[:i] + [r] + row[i + 1:] for row, r in zip(rows, right)])} / {_determinant(rows)}" for i, a in enumerate(some)}
            share[last] = "1" + "".join(f" - ({v})" for v in share.values())
            faces.append("SELECT " + ", ".join(f"CAST({share.get(n, '0')} AS DOUBLE) AS a_{n}" for n in names) + " FROM s")
    loss = " + ".join([f"a_{a} * a_{b} * {q[a, b]} / 2" for a in names for b in names] + [f"- a_{a} * b_{a}" for a in names]).replace("+ -", "-")
    mixed, mean = " + ".join(f"a_{n} * p_{n}" for n in names), "(" + " + ".join(f"p_{n}" for n in names) + f") / {len(names)}"
    parts = [f"SELECT '{blend}' AS blend, '{part}' AS part, {r_sql(R2SQL(p), 'r2')} FROM x WHERE {where}"
             for blend, p in (("mean", "p_mean"), ("simplex", "p_simplex")) for part, where in (("full", "true"), ("half1", "h"), ("half2", "NOT h"))]
    return (SW[:-1] + f""", v AS (SELECT *, row_number() OVER (ORDER BY date_id, time_id, symbol_id) <= count(*) OVER () // 2 AS h FROM valid WHERE {" AND ".join(f"p_{n} IS NOT NULL" for n in names)}),
 s AS (SELECT {", ".join(sums)} FROM v), f AS ({" UNION ALL ".join(faces)}),
 best AS (SELECT f.* FROM f, s WHERE {" AND ".join(f"a_{n} >= 0" for n in names)} ORDER BY {loss} LIMIT 1),
 x AS (SELECT v.*, {mixed} AS p_simplex, {mean} AS p_mean FROM v, best) """ + " UNION ALL ".join(parts))


@query("simplex_blend", _simplex_sql(STREAM_NAMES))
def simplex_blend(spark, d):
    wide = B.align(streams(spark, d), STREAM_NAMES)
    wide = wide.where(" AND ".join(f"{n} IS NOT NULL" for n in STREAM_NAMES)).persist()
    return rounded(B.simplex_report(wide, STREAM_NAMES, E.half_split(wide)), ["blend", "part"], ["r2"])


# -- splits and draws -----------------------------------------------------------------

@query("expanding_splits", with_(TRADES, RANKED) + """SELECT f.fold, date_id, CASE WHEN date_rank - 1 < 30 - (3 - f.fold) * 5 - 2 THEN 'train' ELSE 'valid' END AS role
 FROM dates, (SELECT unnest([0, 1, 2])::INTEGER AS fold) f
 WHERE date_rank - 1 < 30 - (3 - f.fold) * 5 - 2 OR (date_rank - 1 >= 30 - (3 - f.fold) * 5 AND date_rank - 1 < 30 - (2 - f.fold) * 5)""")
def expanding_splits(spark, d):
    return E.expanding_splits(fx.trades(spark, d), n_splits=3, test_size=5, gap=2)


@query("expanding_splits_short", with_(TRADES, RANKED) + """SELECT f.fold, date_id, CASE WHEN date_rank - 1 < 30 - (2 - f.fold) * 10 THEN 'train' ELSE 'valid' END AS role
 FROM dates, (SELECT unnest([0, 1])::INTEGER AS fold) f
 WHERE (date_rank - 1 < 30 - (2 - f.fold) * 10 AND date_rank - 1 >= 30 - (2 - f.fold) * 10 - 8) OR (date_rank - 1 >= 30 - (2 - f.fold) * 10 AND date_rank - 1 < 30 - (1 - f.fold) * 10)""")
def expanding_splits_short(spark, d):
    return E.expanding_splits(fx.trades(spark, d), n_splits=2, test_size=200, max_train=8)


@query("purged_folds", with_(TRADES, RANKED, "g AS (SELECT *, (date_rank - 1) * 6 // n_dates AS grp FROM dates)",
       "b AS (SELECT grp AS fold, min(date_rank) AS lo, max(date_rank) AS hi FROM g GROUP BY 1)")
       + """SELECT CAST(fold AS INTEGER) AS fold, date_id, CASE WHEN grp = fold THEN 'valid' ELSE 'train' END AS role FROM g, b
 WHERE grp = fold OR date_rank < lo - 2 OR date_rank > hi + 2""")
def purged_folds(spark, d):
    return E.purged_folds(fx.trades(spark, d), 6, 2)


@query("embargoed_train", with_(TRADES) + f"SELECT {KSQL} FROM trades WHERE date_id <= 17")
def embargoed_train(spark, d):
    return E.embargoed_train(fx.trades(spark, d), 20, 2, 25, 19).select(*K)


@query("contiguous_folds", with_(TRADES) + f"SELECT {KSQL}, CASE WHEN date_id >= 17 THEN 3 WHEN date_id >= 12 THEN 2 WHEN date_id >= 7 THEN 1 ELSE 0 END AS fold FROM trades WHERE date_id BETWEEN 2 AND 22")
def contiguous_folds(spark, d):
    return E.contiguous_folds(fx.trades(spark, d), 2, 22, 4).select(*K, "fold")


@query("date_subsample", with_(TRADES, RANKED) + "SELECT date_id FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || date_id), date_id) AS r FROM dates) WHERE r <= greatest(round(0.63 * n_dates), 1)")
def date_subsample(spark, d):
    return E.date_subsample(fx.trades(spark, d), 42)


@query("date_bootstrap", with_(TRADES, DRAWS) + "SELECT CAST(occurrence AS INTEGER) AS occurrence, date_id FROM draws")
def date_bootstrap(spark, d):
    return E.date_bootstrap(fx.trades(spark, d), 7)


@query("alignment_check", with_(TRADES_LABELLED) + """, b AS (SELECT * REPLACE (responder_6 + CASE WHEN symbol_id % 7 = 0 THEN 0.01 ELSE 0 END AS responder_6) FROM labelled WHERE date_id <> 3)
 SELECT count(*) AS n_keys, count(*) FILTER (WHERE b.symbol_id IS NULL) AS only_left, count(*) FILTER (WHERE a.symbol_id IS NULL) AS only_right,
 count(*) FILTER (WHERE abs(a.responder_6 - b.responder_6) > 0.002) AS off_responder_6, count(*) FILTER (WHERE abs(a.weight - b.weight) > 0.002) AS off_weight
 FROM (SELECT * FROM labelled WHERE date_id <> 5) a FULL JOIN b ON a.symbol_id = b.symbol_id AND a.date_id = b.date_id AND a.time_id = b.time_id""")
def alignment_check(spark, d):
    t = fx.trades_labelled(spark, d).select(*K, "responder_6", "weight")
    other = t.where("date_id <> 3").withColumn("responder_6", F.col("responder_6") + F.when(F.col("symbol_id") % 7 == 0, 0.01).otherwise(0.0))
    return E.misaligned(t.where("date_id <> 5"), other, ["responder_6", "weight"])


# -- preprocessing and the pool -----------------------------------------------------------

FIT = "fit AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.001) AS lo_{c}, quantile_cont({c}, 0.999) AS hi_{c}" for c in TF) + " FROM trades WHERE date_id <= 20)," \
    "clipped AS (SELECT symbol_id, date_id, time_id, weight, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS {c}" for c in TF) + " FROM trades, fit)," \
    "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, sqrt(greatest(var_pop({c}), 1e-12)) AS s_{c}" for c in TF) + " FROM clipped WHERE date_id <= 20)," \
    f"pool AS (SELECT {KSQL}, weight, " + ", ".join(f"coalesce(({c} - m_{c}) / s_{c}, 0) AS {c}" for c in TF) + " FROM clipped, st)"


@query("fitted_statistics", with_(TRADES, FIT) + "SELECT feature, " + ", ".join(r_sql(x, x) for x in ("lo", "hi", "mean", "std")) + " FROM (SELECT unnest([" + ", ".join(repr(c) for c in TF) + "]) AS feature, "
       + ", ".join(f"unnest([{', '.join(f'{p}_{c}' for c in TF)}]) AS {a}" for p, a in (("lo", "lo"), ("hi", "hi"), ("m", "mean"), ("s", "std"))) + " FROM fit, st)")
def fitted_statistics(spark, d):
    return rounded(N.stats_table(spark, N.fit(fx.trades(spark, d).persist(), TF, 20)), ["feature"], ["lo", "hi", "mean", "std"])


@query("standardised_pool", with_(TRADES, FIT) + f"SELECT {KSQL}, weight, " + ", ".join(r_sql(c, c) for c in TF) + " FROM pool")
def standardised_pool(spark, d):
    path = scratch_path(spark, "pool")
    pool, _ = build_pool(fx.trades(spark, d).persist(), TF, 20, keep=["weight"])
    write_pool(pool, path)
    return rounded(read_pool(spark, path), [*K, "weight"], TF)


@query("date_subsample_statistics", with_(TRADES, RANKED) + f"SELECT {', '.join(r_sql(f'avg({c})', c) for c in TF)} FROM trades JOIN dates USING (date_id) WHERE (date_rank - 1) % 4 = 0")
def date_subsample_statistics(spark, d):
    return N.every_kth_date(fx.trades(spark, d), 4).agg(*[rnd(F.avg(c)).alias(c) for c in TF])


ADAPT = ("dm AS (SELECT date_id, " + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in TF) + ", median(n) AS n FROM (SELECT *, unnest([" + ", ".join(f"n_{c}" for c in TF) + "]) AS n FROM (SELECT *, "
         + ", ".join(f"count({c}) OVER (PARTITION BY date_id) AS n_{c}" for c in TF) + " FROM clipped)) GROUP BY date_id),"
         "run AS (SELECT date_id, " + ", ".join(f"sum(n * m_{c}) OVER w / sum(n) OVER w AS mean_{c}, sqrt(greatest(sum(n * (v_{c} + m_{c} ** 2)) OVER w / sum(n) OVER w - (sum(n * m_{c}) OVER w / sum(n) OVER w) ** 2, 1e-12)) AS std_{c}" for c in TF)
         + " FROM dm WINDOW w AS (ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")


@query("adapting_transform", with_(TRADES, FIT, ADAPT) + f"SELECT {KSQL}, " + ", ".join(r_sql(f"coalesce(({c} - mean_{c}) / std_{c}, 0)", c) for c in TF) + " FROM clipped JOIN run USING (date_id) WHERE date_id >= 10")
def adapting_transform(spark, d):
    t = fx.trades(spark, d).persist()
    ranges = N.clip_ranges(t.where("date_id <= 20"), TF)
    return rounded(N.transform_adapting(t, TF, ranges, 10), K, TF)


@query("enriched_blocks", with_(TRADES_LABELLED, LAG1, "wide AS (SELECT l.*, feature_00, feature_01, feature_02 FROM lagged l JOIN trades USING (symbol_id, date_id, time_id))") + f"""SELECT {KSQL},
 {r_sql('feature_00 - feature_01', 'sub(feature_00,feature_01)')}, {r_sql(f'avg(feature_00) OVER {WDT}', 'feature_00_mkt')}, {r_sql(f'feature_00 - avg(feature_00) OVER {WDT}', 'feature_00_idio')},
 {r_sql('responder_8_lag1d - responder_6_lag1d', 'rsig_momA_short')}, {r_sql('coalesce(feature_00 - lag(feature_00, 4) OVER (PARTITION BY symbol_id, date_id ORDER BY time_id), 0)', 'feature_00_diff_4')},
 CASE WHEN symbol_id % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cluster_1,
 {r_sql('(row_number() OVER (PARTITION BY date_id, time_id ORDER BY feature_02, symbol_id) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY date_id, time_id) - 1, 1)', 'feature_02_rank01')} FROM wide""")
def enriched_blocks(spark, d):
    t = previous_day(fx.trades_labelled(spark, d).persist(), range(9))
    clusters = t.select("symbol_id").distinct().withColumn("cluster", (F.col("symbol_id") % 3).cast("int"))
    out, _ = enrich(t, TF, [("sub", "feature_00", "feature_01")], ["feature_00"], ["feature_00"], [4], clusters, 2, ["feature_02"])
    return rounded(out, K, ["sub(feature_00,feature_01)", "feature_00_mkt", "feature_00_idio", "rsig_momA_short", "feature_00_diff_4", "cluster_1", "feature_02_rank01"])


@query("variant_column_sets")
def variant_column_sets(spark, d):
    t = previous_day(fx.trades_labelled(spark, d).persist(), range(9))
    out, blocks = enrich(t, TF, [("mul", "feature_00", "feature_01")], ["feature_00"], ["feature_01"], [1, 4], ranks=["feature_02"])
    sets = nested_variants(blocks)
    return reduce(lambda a, b: a.unionByName(b), [
        out.agg(F.lit(n).alias("variant"), F.lit(len(cols)).alias("n_features"), F.count(F.lit(1)).alias("n_rows")) for n, cols in sets.items()])


@query("block_verification", with_(TRADES) + """, s AS (SELECT * FROM trades WHERE date_id IN (4, 9, 19))
 SELECT 'level' AS block, 0.5::DOUBLE AS max_abs_delta, 0::BIGINT AS n_one_sided
 UNION ALL SELECT 'spread', 0.0::DOUBLE, count(*) FILTER (WHERE symbol_id % 7 = 0 AND feature_03 IS NOT NULL) FROM s""")
def block_verification(spark, d):
    t = P.pick_dates(fx.trades(spark, d), [4, 9, 19])
    path = scratch_path(spark, "blocks")
    # What is stored differs from what is recomputed: one block shifted, one with gaps.
    stored = t.withColumns({"feature_02": F.when(F.col("symbol_id") % 5 == 0, F.col("feature_02") + 0.5).otherwise(F.col("feature_02")),
                            "feature_03": F.when(F.col("symbol_id") % 7 != 0, F.col("feature_03"))})
    blocks = {"level": ["feature_02"], "spread": ["feature_03"]}
    sinks.write_blocks(stored, path, blocks, files_per_date=2)
    out = E.block_differences(spark.read.parquet(f"{path}/rows"), t, blocks)
    return out.select("block", rnd("max_abs_delta").alias("max_abs_delta"), "n_one_sided")


@query("block_pool", with_(TRADES) + f"SELECT {KSQL}, weight, {r_sql('feature_00', 'feature_00')}, {r_sql('feature_00 - feature_01', 'sub(feature_00,feature_01)')} FROM trades")
def block_pool(spark, d):
    path = scratch_path(spark, "blocks")
    df, blocks = enrich(fx.trades(spark, d), ["feature_00"], [("sub", "feature_00", "feature_01")], ranks=[], differences=False)
    sinks.write_blocks(df, path, blocks, files_per_date=2)
    stored = spark.read.parquet(f"{path}/rows")
    listed = [r["column"] for r in spark.read.json(f"{path}/blocks").orderBy("block", "position").collect()]
    return rounded(stored, [*K, "weight"], listed)


@query("causality_probe")
def causality_probe(spark, d):
    plan = FeaturePlan(raw=[], rolled=["feature_00", "feature_02"], rolling_rows=24, min_date=None, synthetic=False, extra=["rank_per_time", "ewma_per_symbol"],
                       symbol_rows=fx.trades_steps(spark, d))
    t = fx.trades(spark, d).select(*K, "feature_00", "feature_02").persist()
    return E.causality_probe(t, lambda p: build_features(p, plan), ["feature_00", "feature_02"], plan.columns(), 15)


@query("shift_probe", SW + f"""SELECT {r_sql(R2SQL('p_lag'), 'r2')}, {r_sql(R2SQL('p_shift'), 'r2_shifted')}, (SELECT {R2SQL('p_lag')} FROM valid) > 0.03 AS suspect
 FROM (SELECT *, lag(p_lag) OVER (PARTITION BY symbol_id, date_id ORDER BY time_id) AS p0, coalesce(lag(p_lag) OVER (PARTITION BY symbol_id, date_id ORDER BY time_id), 0) AS p_shift FROM valid)""")
def shift_probe(spark, d):
    rows = one(spark, d, "lag")
    moved = E.shifted_one_step(rows.withColumn("shifted", F.col("pred")), ["shifted"]).fillna(0.0, ["shifted"])
    scores = moved.agg(r2_expr().alias("r2"), r2_expr(pred="shifted").alias("r2_shifted"))
    return rounded(E.too_good(scores), ["suspect"], ["r2", "r2_shifted"])


@query("shuffle_probe", SW + f"""SELECT {r_sql('avg(w)', 'mean_w')}, count(*) AS n_rows, CAST(sum(time_id) AS BIGINT) AS time_sum FROM valid""")
def shuffle_probe(spark, d):
    out = E.shuffled_days(one(spark, d, "lag"))
    return out.agg(rnd(F.avg("w")).alias("mean_w"), F.count(F.lit(1)).alias("n_rows"), F.sum("time_id").cast("long").alias("time_sum"))


# -- diagnostics ---------------------------------------------------------------------------

def _cuts(col: str, n: int) -> str:
    return "(SELECT [" + ", ".join(f"quantile_cont({col}, {i} / {n}.0)" for i in range(1, n)) + "] FROM valid)"


def _bucket(col: str, n: int) -> str:
    return f"1 + len(list_filter(cuts, lambda q: {col} >= q))"


@query("calibration_deciles", SW + f"""SELECT CAST(b AS INTEGER) AS decile, count(*) AS n_rows, {r_sql('sum(w * y) / sum(w)', 'mean_y')}, {r_sql('sum(w * p_mom) / sum(w)', 'mean_pred')},
 {r_sql('(sum(w * y) / sum(w)) / (sum(w * p_mom) / sum(w))', 'ratio', 4)} FROM (SELECT *, {_bucket('p_mom', 10)} AS b FROM valid, (SELECT {_cuts('p_mom', 10)} AS cuts)) GROUP BY 1""")
def calibration_deciles(spark, d):
    out = G.calibration_deciles(one(spark, d, "mom"))
    return out.select("decile", "n_rows", rnd("mean_y").alias("mean_y"), rnd("mean_pred").alias("mean_pred"), rnd("ratio", 4).alias("ratio"))


@query("residual_persistence", SW + f""", e AS (SELECT symbol_id, date_id, avg(y - p_slow) AS e FROM valid GROUP BY 1, 2) SELECT count(*) AS n_pairs, {r_sql('corr(a.e, b.e)', 'corr')}
 FROM e a JOIN e b ON a.symbol_id = b.symbol_id AND a.date_id = b.date_id + 1""")
def residual_persistence(spark, d):
    return rounded(G.residual_persistence(one(spark, d, "slow")), ["n_pairs"], ["corr"])


@query("residual_autocorrelation", SW + """, w AS (SELECT *, y - p_slow AS r, count(*) OVER s AS n FROM valid WINDOW s AS (PARTITION BY symbol_id, date_id)),
 x AS (SELECT *, r - avg(r) OVER s AS e FROM w WHERE n = 12 WINDOW s AS (PARTITION BY symbol_id, date_id)),
 z AS (SELECT *, e / stddev_pop(e) OVER s AS z, stddev_pop(e) OVER s AS sd FROM x WINDOW s AS (PARTITION BY symbol_id, date_id)),
 a AS (SELECT f.symbol_id, f.date_id, g.time_id - f.time_id AS lag, sum(f.z * g.z) / (12 - (g.time_id - f.time_id)) AS v FROM z f JOIN z g
 ON f.symbol_id = g.symbol_id AND f.date_id = g.date_id AND g.time_id - f.time_id BETWEEN 0 AND 6 WHERE f.sd > 1e-9 GROUP BY 1, 2, 3)
 SELECT CAST(lag AS INTEGER) AS lag, round(avg(v), 6) + 0.0 AS corr, count(*) AS n_series FROM a GROUP BY 1""")
def residual_autocorrelation(spark, d):
    from tidewheel.operators.forensics import residual_acf
    rows = one(spark, d, "slow").withColumn("resid", F.col("y") - F.col("pred"))
    return rounded(residual_acf(rows, "resid", 6, 12), ["lag", "n_series"], ["corr"])


@query("common_residual_share", SW + f""", s AS (SELECT date_id, count(*) AS n, avg(r) AS m FROM (SELECT *, y - p_slow AS r FROM valid) GROUP BY date_id, time_id),
 t AS (SELECT date_id, sum(n * m) / sum(n) AS dm FROM s GROUP BY 1), den AS (SELECT sum((y - p_slow - dm) ** 2) AS v FROM valid JOIN t USING (date_id)),
 num AS (SELECT sum(n * (m - dm) ** 2) AS v, count(*) / sum(n) AS fl FROM s JOIN t USING (date_id)) SELECT {r_sql('num.v / den.v', 'share')}, {r_sql('num.fl', 'floor')} FROM num, den""")
def common_residual_share(spark, d):
    return rounded(G.common_residual_share(one(spark, d, "slow")), [], ["share", "floor"])


@query("tail_share", SW + f""", c AS (SELECT quantile_cont(abs(y), 0.99) AS q FROM valid) SELECT count(*) FILTER (WHERE abs(y) >= q) AS n_tail,
 {r_sql('sum(w * (p_slow - y) ** 2) FILTER (WHERE abs(y) >= q) / sum(w * (p_slow - y) ** 2)', 'error_share')}, {r_sql('sum(w * y * y) FILTER (WHERE abs(y) >= q) / sum(w * y * y)', 'energy_share')},
 {r_sql('avg((sign(p_slow) = sign(y))::INT) FILTER (WHERE abs(y) >= q)', 'sign_accuracy')}, {r_sql('avg(abs(y)) FILTER (WHERE abs(y) >= q) / avg(abs(p_slow)) FILTER (WHERE abs(y) >= q)', 'size_ratio', 4)} FROM valid, c""")
def tail_share(spark, d):
    out = G.tail_share(one(spark, d, "slow"))
    return out.select("n_tail", *[rnd(c).alias(c) for c in ("error_share", "energy_share", "sign_accuracy")], rnd("size_ratio", 4).alias("size_ratio"))


@query("regime_scores", SW + f"""SELECT CAST(b AS INTEGER) AS vol_bucket, count(*) AS n_rows, {r_sql(R2SQL('p_slow'), 'r2', 5)}, {r_sql('corr(p_slow, y)', 'corr_pred', 5)}
 FROM (SELECT *, {_bucket('vol', 3)} AS b FROM valid, (SELECT {_cuts('vol', 3)} AS cuts)) GROUP BY 1""")
def regime_scores(spark, d):
    return rounded(G.by_regime(one(spark, d, "slow"), "vol", ["pred"]), ["vol_bucket", "n_rows"], ["r2", "corr_pred"], 5)


@query("regime_by_time", SW + f"""SELECT coalesce(CAST(b AS VARCHAR), 'all') AS vol_bucket, coalesce(CAST(time_id * 3 // 12 AS VARCHAR), 'all') AS day_part, count(*) AS n_rows, {r_sql(R2SQL('p_slow'), 'r2', 5)}, {r_sql('corr(p_slow, y)', 'corr_pred', 5)}
 FROM (SELECT *, {_bucket('vol', 3)} AS b FROM valid, (SELECT {_cuts('vol', 3)} AS cuts)) GROUP BY CUBE (b, time_id * 3 // 12)""")
def regime_by_time(spark, d):
    out = G.by_regime(one(spark, d, "slow"), "vol", ["pred"], time_parts=3, steps_per_day=12)
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("vol_bucket", "day_part")}
    return rounded(out.withColumns(named), ["vol_bucket", "day_part", "n_rows"], ["r2", "corr_pred"], 5)


@query("vol_interactions", SW + f"""SELECT {KSQL}, """ + ", ".join(r_sql(f"CASE WHEN b = {k} THEN p_slow ELSE 0 END", f"pred_x_bucket_{k}") for k in (1, 2, 3))
       + f" FROM (SELECT *, {_bucket('vol', 3)} AS b FROM valid, (SELECT {_cuts('vol', 3)} AS cuts))")
def vol_interactions(spark, d):
    from tidewheel.functions.scalars import interaction_block
    rows = G.value_buckets(one(spark, d, "slow"), "vol", 3, "bucket")
    return rounded(interaction_block(rows, ["pred"], "bucket", [1, 2, 3]), K, [f"pred_x_bucket_{k}" for k in (1, 2, 3)])


@query("market_internals", with_(TRADES_LABELLED, "i AS (SELECT date_id, avg((coalesce(responder_6, NULL) > 0)::INT) AS a, stddev_samp(responder_6) AS b, avg(abs(responder_6)) AS c FROM labelled GROUP BY 1)")
       + f"SELECT x.date_id, {r_sql('y.a', 'breadth_lag1d')}, {r_sql('y.b', 'dispersion_lag1d')}, {r_sql('y.c', 'mean_abs_lag1d')} FROM i x LEFT JOIN i y ON x.date_id = y.date_id + 1")
def market_internals(spark, d):
    return rounded(G.market_internals(fx.trades_labelled(spark, d), "responder_6"), ["date_id"], ["breadth_lag1d", "dispersion_lag1d", "mean_abs_lag1d"])


def _window_corr(cond: str) -> str:
    return "SELECT unnest([" + ", ".join(repr(c) for c in TF) + "]) AS feature, unnest([" + ", ".join(f"corr({c}, responder_8)" for c in TF) + f"]) AS s FROM labelled WHERE {cond}"


@query("score_stability", with_(TRADES_LABELLED, f"a AS ({_window_corr('date_id < 15')})", f"b AS ({_window_corr('date_id >= 15')})")
       + f"""SELECT {r_sql('corr(ra, rb)', 'spearman')}, {r_sql('avg((sign(sa) = sign(sb))::INT)', 'sign_agreement')}, count(*) AS n_features
 FROM (SELECT a.s AS sa, b.s AS sb, rank() OVER (ORDER BY a.s) AS ra, rank() OVER (ORDER BY b.s) AS rb FROM a JOIN b USING (feature))""")
def score_stability(spark, d):
    t = fx.trades_labelled(spark, d)
    a, b = (target_correlations(t.where(c), TF, "responder_8").withColumnRenamed("corr", "score") for c in ("date_id < 15", "date_id >= 15"))
    return rounded(G.score_stability(a, b), ["n_features"], ["spearman", "sign_agreement"])
