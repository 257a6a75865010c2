"""Selection, clustering, models and walk-forward evaluation."""

from pyspark.sql import functions as F

from tidewheel.catalog.evaluation import STREAM_NAMES, streams
from tidewheel.catalog.registry import (K, TRADES_LABELLED, query, r_sql, rnd, rounded, with_)
from tidewheel.catalog.statistics import _long
from tidewheel.operators import cluster as C
from tidewheel.operators import ensemble as B
from tidewheel.operators import evaluate as E
from tidewheel.operators import models as M
from tidewheel.operators import select as S
from tidewheel.operators.correlation import adjusted_rand, intra_inter, symbol_correlation
from tidewheel.operators.lags import previous_day
from tidewheel.operators.moments import gram, gram_matrix, linear_score, ridge_solve, target_correlations
from tidewheel.operators.scores import r2, r2_expr
from tidewheel.plans.blend import bag
from tidewheel.plans.pipeline import PanelPipeline, daily_walk, fold_scores, get_learner
from tidewheel.plans.walkforward import walk_forward, window_ladder
from tidewheel.sources import fixtures as fx

TF, AF = fx.TRADES_FEATURES, fx.ACTIVITY_FEATURES
GBT = {"max_iter": 4, "depth": 3}


def rows(spark, d):
    t = previous_day(fx.trades_labelled(spark, d), [6, 8])
    return t.withColumnsRenamed({"responder_6": "y", "weight": "w"}).where("y IS NOT NULL")


X = [*TF, "responder_6_lag1d", "responder_8_lag1d"]


def split(spark, d):
    t = rows(spark, d).select(*K, "y", "w", *X).persist()
    return t.where("date_id < 20"), t.where("date_id >= 20")


# -- clustering -----------------------------------------------------------------------

@query("feature_clusters")
def feature_clusters(spark, d):
    from tidewheel.operators.correlation import array_correlation
    m = array_correlation(fx.table(spark, d, "embeddings"), "embedding")
    return C.clusters_from_matrix(spark, [f"dim_{i:02d}" for i in range(len(m))], m, 0.1)


@query("panel_feature_clusters")
def panel_feature_clusters(spark, d):
    return C.feature_clusters(fx.trades_labelled(spark, d), [*TF, *[f"responder_{r}" for r in range(9)]], 0.6)


@query("symbol_clusters")
def symbol_clusters(spark, d):
    cells = fx.activity_cells(spark, d)
    whole = C.symbol_clusters(cells, "feature_00", 3, 100)
    early = C.symbol_clusters(cells.where("date_id < 15"), "feature_00", 3, 50).withColumnRenamed("cluster", "early")
    late = C.symbol_clusters(cells.where("date_id >= 15"), "feature_00", 3, 50).withColumnRenamed("cluster", "late")
    one = F.lit(1).alias("one")
    agree = adjusted_rand(early.join(late, "symbol_id"), "early", "late")
    gap = intra_inter(symbol_correlation(cells, "feature_00", 100), whole)
    return (whole.withColumn("one", F.lit(1)).join(agree.select("ari", one), "one").join(gap.select("intra", "inter", one), "one").drop("one"))


@query("profile_clusters")
def profile_clusters(spark, d):
    return C.profile_clusters(fx.trades(spark, d), TF, 6)


# -- selection ------------------------------------------------------------------------------

@query("correlation_cut", with_(TRADES_LABELLED) + f"SELECT feature, {r_sql('corr', 'corr')} FROM (SELECT {_long(TF, {'corr': 'corr({c}, responder_8)'})} FROM labelled) WHERE abs(corr) > 0.01")
def correlation_cut(spark, d):
    return rounded(S.above_correlation(target_correlations(fx.trades_labelled(spark, d), TF, "responder_8"), 0.01), ["feature"], ["corr"])


def _ends(t) -> tuple[int, int]:
    """First and last date of a panel."""
    return tuple(t.agg(F.min("date_id"), F.max("date_id")).first())


_FOLDED = "ends AS (SELECT min(date_id) AS lo, max(date_id) + 1 AS hi FROM labelled)," \
    "f AS (SELECT labelled.*, " + " + ".join(f"CAST(date_id >= lo + ({i} * (hi - lo)) // 4 AS INTEGER)" for i in (1, 2, 3)) + " AS fold FROM labelled, ends)," \
    "sc AS (SELECT fold, " + _long(TF, {"score": "abs(corr({c}, responder_8))"}) + " FROM f GROUP BY fold)," \
    "top AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, feature) AS position FROM sc)"


@query("fold_top_k", with_(TRADES_LABELLED, _FOLDED) + f"SELECT fold, feature, {r_sql('score', 'score')}, CAST(position AS INTEGER) AS position FROM top WHERE position <= 3")
def fold_top_k(spark, d):
    t = fx.trades_labelled(spark, d).select("date_id", *TF, "responder_8").persist()
    s = S.fold_correlation_scores(t, TF, "responder_8", *_ends(t), 4)
    return S.fold_top_k(s, 3).select("fold", "feature", rnd("score").alias("score"), "position")


@query("fold_consistency", with_(TRADES_LABELLED, _FOLDED) + "SELECT feature, count(*) AS n_folds FROM top WHERE position <= 3 GROUP BY 1 HAVING count(*) >= 3")
def fold_consistency(spark, d):
    t = fx.trades_labelled(spark, d).select("date_id", *TF, "responder_8").persist()
    return S.consistent(S.fold_correlation_scores(t, TF, "responder_8", *_ends(t), 4), 3, 3)


_OPS = {"sub": "{a} - {b}", "mul": "{a} * {b}", "div": "{a} / CASE WHEN abs({b}) >= 0.1 THEN {b} WHEN {b} < 0 THEN -0.1 ELSE 0.1 END",
        "min": "least({a}, {b})", "max": "greatest({a}, {b})"}
_CORE = ["feature_00", "feature_01", "feature_02", "feature_05"]
_PAIRS = [(a, b) for i, a in enumerate(_CORE) for b in _CORE[i + 1:]]


@query("combo_screen", with_(TRADES_LABELLED) + f"""SELECT op || '(' || a || ',' || b || ')' AS label, op, a, b, {r_sql('corr', 'corr')}, {r_sql('best', 'best_parent')} FROM (""" + " UNION ALL ".join(
    f"SELECT '{op}' AS op, '{a}' AS a, '{b}' AS b, corr({e.format(a=a, b=b)}, responder_8) AS corr, greatest(abs(corr({a}, responder_8)), abs(corr({b}, responder_8))) AS best FROM labelled"
    for a, b in _PAIRS for op, e in _OPS.items()) + ") WHERE abs(corr) > best")
def combo_screen(spark, d):
    out = S.combo_screen(fx.trades_labelled(spark, d), _CORE, "responder_8")
    return rounded(out, ["label", "op", "a", "b"], ["corr", "best_parent"])


@query("combo_accept")
def combo_accept(spark, d):
    t = fx.trades_labelled(spark, d).select(*_CORE, "responder_8").persist()
    screen = S.combo_screen(t, _CORE, "responder_8").orderBy(F.desc(F.abs("corr")), "label").collect()
    picked = S.accept_combos(t.where("responder_8 IS NOT NULL"), [(r["op"], r["a"], r["b"]) for r in screen], 5, 0.9)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(picked)] or [(0, "none", "", "")], "position int, op string, a string, b string")


@query("combo_tree_screen")
def combo_tree_screen(spark, d):
    train, _ = split(spark, d)
    ranked = M.combo_tree_gains(train, S.combo_candidates(_CORE), batch=10, **GBT)
    picked = S.accept_combos(train, [c for c, g in ranked if g > 0], 5, 0.9)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(picked)] or [(0, "none", "", "")], "position int, op string, a string, b string")


@query("fold_tree_consistency")
def fold_tree_consistency(spark, d):
    train, _ = split(spark, d)
    scores = M.fold_importances(E.contiguous_folds(train, *_ends(train), 3), X, **GBT)
    return S.consistent(scores, 4, 2)


_INC = ("dd AS (SELECT *, " + ", ".join(f"{c} - lag({c}) OVER (PARTITION BY symbol_id ORDER BY date_id, time_id) AS d_{c}" for c in TF) + " FROM ok),"
        "ee AS (SELECT *, " + ", ".join(f"lag(d_{c}) OVER (PARTITION BY symbol_id ORDER BY date_id, time_id) AS e_{c}" for c in TF) + " FROM dd),"
        "ps AS (SELECT symbol_id, " + ", ".join(f"var_samp(d_{c}) AS v_{c}, corr(d_{c}, e_{c}) AS r_{c}" for c in TF) + " FROM ee GROUP BY 1),"
        f"vr AS (SELECT {_long(TF, {'v': 'avg(v_{c})', 'r': 'avg(r_{c})'})} FROM ps), cr AS (SELECT {_long(TF, {'c': 'abs(corr({c}, responder_8))'})} FROM ok)")


@query("channel_scores", with_(TRADES_LABELLED, "ok AS (SELECT * FROM labelled WHERE responder_8 IS NOT NULL)", _INC.replace("FROM ok)", "FROM labelled)", 1)) + f"""SELECT feature, {r_sql('c', 'abs_corr')},
 {r_sql('v', 'returns_var')}, {r_sql('r', 'autocorr_lag1')}, {r_sql('''(c - avg(c) OVER ()) / (stddev_pop(c) OVER () + 1e-12) + 0.5 * (ln(1 + v) - avg(ln(1 + v)) OVER ()) / (stddev_pop(ln(1 + v)) OVER () + 1e-12) + 0.25 * abs(r)''', 'score', 5)}
 FROM vr JOIN cr USING (feature)""")
def channel_scores(spark, d):
    out = S.channel_scores(fx.trades_labelled(spark, d), TF, "responder_8")
    return out.select("feature", *[rnd(c).alias(c) for c in ("abs_corr", "returns_var", "autocorr_lag1")], rnd("score", 5).alias("score"))


@query("channel_pick")
def channel_pick(spark, d):
    t = fx.trades_labelled(spark, d)
    names = S.pick_channels(t, S.channel_scores(t, TF, "responder_8"), 3, 0.6)
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, feature string")


@query("ar_channel_scores")
def ar_channel_scores(spark, d):
    return rounded(S.ar_channel_scores(fx.activity_labelled(spark, d), AF[:2], "responder_6", 3, 1), ["feature"], ["r2_levels", "r2_increments", "r2_max"])


# -- models ------------------------------------------------------------------------------------

@query("ridge_scores", with_(TRADES_LABELLED, "r AS (SELECT responder_6 AS y, weight AS w, feature_00 AS a, feature_01 AS b, date_id FROM labelled WHERE responder_6 IS NOT NULL)",
       "g AS (SELECT sum(w*a*a) + 100 AS aa, sum(w*a*b) AS ab, sum(w*b*b) + 100 AS bb, sum(w*a*y) AS ay, sum(w*b*y) AS yb FROM r WHERE date_id < 20)",
       "c AS (SELECT (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM g)")
       + f"SELECT {r_sql('ca', 'coef_a', 5)}, {r_sql('cb', 'coef_b', 5)}, {r_sql('(SELECT 1 - sum(w * (ca * a + cb * b - y) ** 2) / sum(w * y * y) FROM r WHERE date_id >= 20)', 'r2', 5)} FROM c")
def ridge_scores(spark, d):
    train, valid = split(spark, d)
    cols = ["feature_00", "feature_01"]
    coef = ridge_solve(gram_matrix(gram(train, [*cols, "y"], "w"), 3), 2, 100.0)
    out = valid.withColumn("pred", linear_score(cols, coef)).agg(r2_expr().alias("r2"))
    return rounded(out.withColumns({"coef_a": F.lit(float(coef[0])), "coef_b": F.lit(float(coef[1]))}), [], ["coef_a", "coef_b", "r2"], 5)


@query("boosted_trees")
def boosted_trees(spark, d):
    train, valid = split(spark, d)
    preds, _ = M.fit_eval("boosted_trees", train, valid, X, early_stop=True, max_iter=1000, depth=6)
    return preds.groupBy("date_id").agg(r2_expr().alias("r2"), F.count(F.lit(1)).alias("n_rows"))


@query("linear_model")
def linear_model(spark, d):
    train, valid = split(spark, d)
    _, score = M.fit_eval("linear", train, valid, X)
    return score


@query("volatility_model")
def volatility_model(spark, d):
    train, valid = split(spark, d)
    vol = M.volatility(M.volatility_model(train, X, **GBT), valid, X)
    return vol.select(*K, "vol")


@query("regime_specialists")
def regime_specialists(spark, d):
    train, valid = split(spark, d)
    quiet = F.abs("responder_8_lag1d") < 0.3
    return B.singles(M.specialists(train, valid, X, {"calm": quiet, "storm": ~quiet}, **GBT))


@query("label_chain")
def label_chain(spark, d):
    t = fx.trades_labelled(spark, d).persist().withColumnRenamed("weight", "w")
    first, last = _ends(t)
    return M.chain_predictions(t, TF, ["responder_6", "responder_8"], first, 19, 20, last, **GBT)


@query("two_window_chain")
def two_window_chain(spark, d):
    t = fx.trades_labelled(spark, d).persist().withColumnRenamed("weight", "w").persist()
    table, _, _ = M.responder_table(t.where("date_id < 10"), t.where("date_id BETWEEN 10 AND 19"), t.where("date_id >= 20"), TF,
                                    ["responder_6", "responder_8"], **GBT)
    return table


@query("variant_ablation")
def variant_ablation(spark, d):
    train, valid = split(spark, d)
    return M.ablation(train, valid, {"base": TF, "lags": X}, **GBT)


@query("bagged_members")
def bagged_members(spark, d):
    train, valid = split(spark, d)
    members = {}
    for seed in (1, 2):
        part = train.join(E.date_subsample(train, seed), "date_id", "left_semi")
        members[f"ridge_s{seed}"] = M.ridge_predictions(part, valid, X)
    s = bag(members)
    return B.singles(s.unionByName(B.blend(s, list(members), "bag")))


@query("stacker")
def stacker(spark, d):
    wide, cols = B.stack_features(B.align(streams(spark, d), STREAM_NAMES), ["lag", "slow", "mom"], "lag")
    wide = wide.withColumn("target", F.col("y") - F.col("lag")).persist()
    h = E.half_split(wide)
    model = M.fit("boosted_trees", wide.where(h), cols, label="target", **GBT)
    out = M.predict(model, wide.where(~h), cols, bound=None).withColumn("pred", F.col("pred") + F.col("lag"))
    return r2(out)


# -- walk-forward -----------------------------------------------------------------------------------

def _walk(spark, d, **kw):
    return r2(walk_forward(rows(spark, d).select(*K, "y", "w", *X), X, 20, **kw), ["date_id"])


_WF = """r AS (SELECT date_id, responder_6 AS y, weight AS w, feature_00 AS a, feature_01 AS b FROM labelled WHERE responder_6 IS NOT NULL),
g AS (SELECT date_id, sum(w*a*a) AS aa, sum(w*a*b) AS ab, sum(w*b*b) AS bb, sum(w*a*y) AS ay, sum(w*b*y) AS yb FROM r GROUP BY 1),
s AS (SELECT date_id, sum(aa) OVER q + 100 AS aa, sum(ab) OVER q AS ab, sum(bb) OVER q + 100 AS bb, sum(ay) OVER q AS ay, sum(yb) OVER q AS yb FROM g WINDOW q AS (ORDER BY date_id RANGE BETWEEN {frame} AND 1 PRECEDING)),
c AS (SELECT date_id, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
p AS (SELECT r.*, least(greatest(ca * a + cb * b, -5), 5) AS pred FROM r JOIN c USING (date_id) WHERE date_id >= 20)"""


@query("walk_forward_online", with_(TRADES_LABELLED, _WF.format(frame="UNBOUNDED PRECEDING")) + f"SELECT date_id, {r_sql('1 - sum(w * (pred - y) ** 2) / sum(w * y * y)', 'r2', 5)} FROM p GROUP BY 1")
def walk_forward_online(spark, d):
    t = rows(spark, d).select(*K, "y", "w", "feature_00", "feature_01").persist()
    return rounded(r2(walk_forward(t, ["feature_00", "feature_01"], 20), ["date_id"]), ["date_id"], ["r2"], 5)


_STATIC = _WF.format(frame="UNBOUNDED PRECEDING").replace("FROM r JOIN c USING (date_id) WHERE date_id >= 20", "FROM r, (SELECT * EXCLUDE (date_id) FROM c WHERE date_id = 20) c WHERE date_id >= 20")


@query("walk_forward_static", with_(TRADES_LABELLED, _STATIC) + f"SELECT date_id, {r_sql('1 - sum(w * (pred - y) ** 2) / sum(w * y * y)', 'r2', 5)} FROM p GROUP BY 1")
def walk_forward_static(spark, d):
    t = rows(spark, d).select(*K, "y", "w", "feature_00", "feature_01").persist()
    return rounded(r2(walk_forward(t, ["feature_00", "feature_01"], 20, online=False), ["date_id"]), ["date_id"], ["r2"], 5)


@query("walk_forward_all_features")
def walk_forward_all_features(spark, d):
    return _walk(spark, d)


@query("window_ladder", with_(TRADES_LABELLED) + " UNION ALL ".join(
    f"SELECT {n}::INTEGER AS length, (WITH {_WF.format(frame=f'{n} PRECEDING')} SELECT {r_sql('1 - sum(w * (pred - y) ** 2) / sum(w * y * y)', 'r2', 5)} FROM p) AS r2" for n in (3, 6, 12)))
def window_ladder_(spark, d):
    t = rows(spark, d).select(*K, "y", "w", "feature_00", "feature_01").persist()
    return rounded(window_ladder(t, ["feature_00", "feature_01"], 20, [3, 6, 12]), ["length"], ["r2"], 5)


# -- the pipeline: preprocess, fit, predict and update day by day ---------------------------------------

_PIPE_X = ["feature_03", "feature_05"]


def _pipeline_sql(lo: str, hi: str, factor: float) -> str:
    """The day loop as two recursions over blocks: the training dates, then each day that is learned."""
    merge = ", ".join(f"s.m{c} + (m.m{c} - s.m{c}) * m.n / (s.n + m.n), s.q{c} + m.v{c} * m.n + (m.m{c} - s.m{c}) ** 2 * s.n * m.n / (s.n + m.n)" for c in "ab")
    z = {c: f"coalesce(({c} - m{c}) / sqrt(greatest(q{c} / n, 1e-12)), 0)" for c in "ab"}
    return with_(TRADES_LABELLED, f"""r AS (SELECT date_id, responder_6 AS y, weight AS w, feature_03 AS a, feature_05 AS b FROM labelled),
lim AS (SELECT quantile_cont(a, 0.001) AS la, quantile_cont(a, 0.999) AS ha, quantile_cont(b, 0.001) AS lb, quantile_cont(b, 0.999) AS hb FROM r WHERE date_id < {lo}),
c AS (SELECT date_id, y, w, CASE WHEN a IS NOT NULL THEN least(greatest(a, la), ha) END AS a, CASE WHEN b IS NOT NULL THEN least(greatest(b, lb), hb) END AS b FROM r, lim),
vd AS (SELECT DISTINCT date_id FROM r WHERE date_id >= {lo} AND date_id < {hi}),
blk AS (SELECT DISTINCT date_id, 0 AS block FROM r WHERE date_id < {lo} UNION ALL
        SELECT date_id, row_number() OVER (ORDER BY date_id) FROM vd WHERE date_id + 1 IN (SELECT date_id FROM vd)),
m AS (SELECT block, (count(a) + count(b)) / 2 AS n, avg(a) AS ma, var_pop(a) AS va, avg(b) AS mb, var_pop(b) AS vb FROM c JOIN blk USING (date_id) GROUP BY 1),
st AS (SELECT block, n, ma, va * n AS qa, mb, vb * n AS qb FROM m WHERE block = 0 UNION ALL SELECT m.block, s.n + m.n, {merge} FROM st s JOIN m ON m.block = s.block + 1),
z AS (SELECT block, y, w, {z['a']} AS a, {z['b']} AS b FROM c JOIN blk USING (date_id) JOIN st USING (block) WHERE y IS NOT NULL),
g AS (SELECT block, sum(w*a*a) AS aa, sum(w*a*b) AS ab, sum(w*b*b) AS bb, sum(w*a*y) AS ay, sum(w*b*y) AS yb FROM z GROUP BY 1),
s AS (SELECT * FROM g WHERE block = 0 UNION ALL SELECT g.block, {', '.join(f'{factor} * s.{x} + g.{x}' for x in ('aa', 'ab', 'bb', 'ay', 'yb'))} FROM s JOIN g ON g.block = s.block + 1),
co AS (SELECT block, (ay * (bb + 100) - yb * ab) / ((aa + 100) * (bb + 100) - ab * ab) AS ca, (yb * (aa + 100) - ay * ab) / ((aa + 100) * (bb + 100) - ab * ab) AS cb FROM s),
u AS (SELECT date_id, (SELECT count(*) FROM blk WHERE block > 0 AND blk.date_id < vd.date_id) AS block FROM vd),
p AS (SELECT date_id, y, w, least(greatest(ca * {z['a']} + cb * {z['b']}, -5), 5) AS pred FROM c JOIN u USING (date_id) JOIN st USING (block) JOIN co USING (block))
""").replace("WITH", "WITH RECURSIVE", 1)


_DAILY_R2 = f"date_id, {r_sql('1 - sum(w * (pred - y) ** 2) / sum(w * y * y)', 'r2', 5)} FROM p WHERE y IS NOT NULL GROUP BY date_id"


def _pipeline_rows(spark, d):
    t = fx.trades_labelled(spark, d).select(*K, F.col("responder_6").alias("y"), F.col("weight").alias("w"), *_PIPE_X).persist()
    return t, [r["date_id"] for r in t.select("date_id").distinct().orderBy("date_id").collect()]


@query("pipeline_daily_scores", _pipeline_sql("20", "1000000", 0.98) + "SELECT " + _DAILY_R2)
def pipeline_daily_scores(spark, d):
    t, dates = _pipeline_rows(spark, d)
    out = daily_walk(t, _PIPE_X, [x for x in dates if x < 20], [x for x in dates if x >= 20], factor=0.98)
    return rounded(r2(out, ["date_id"]), ["date_id"], ["r2"], 5)


@query("pipeline_static_scores", _pipeline_sql("20", "1000000", 1.0).replace("SELECT date_id, (SELECT count(*) FROM blk WHERE block > 0 AND blk.date_id < vd.date_id) AS block FROM vd", "SELECT date_id, 0 AS block FROM vd") + "SELECT " + _DAILY_R2)
def pipeline_static_scores(spark, d):
    t, _ = _pipeline_rows(spark, d)
    pipe = PanelPipeline(_PIPE_X, get_learner("ridge")).fit(t.where("date_id < 20"))
    return rounded(r2(pipe.predict(t.where("date_id >= 20")), ["date_id"]), ["date_id"], ["r2"], 5)


@query("pipeline_fold_scores", "SELECT * FROM (" + _pipeline_sql("15", "20", 1.0) + "SELECT 0 AS fold, " + _DAILY_R2 + ") UNION ALL SELECT * FROM ("
       + _pipeline_sql("20", "1000000", 1.0) + "SELECT 1 AS fold, " + _DAILY_R2 + ")")
def pipeline_fold_scores(spark, d):
    t, dates = _pipeline_rows(spark, d)
    folds = [([x for x in dates if x < 15], [x for x in dates if 15 <= x < 20]), ([x for x in dates if x < 20], [x for x in dates if x >= 20])]
    return rounded(fold_scores(t, _PIPE_X, folds), ["fold", "date_id"], ["r2"], 5)
