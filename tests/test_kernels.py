"""Array kernels, matrices and selection against brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.operators import cluster as C
from tidewheel.operators import correlation as K
from tidewheel.operators import forensics as Z
from tidewheel.operators import moments as M
from tidewheel.operators import select as S
from tidewheel.operators import signatures as G
from tidewheel.operators.quantiles import exact_quantiles
from tidewheel.plans.walkforward import walk_forward

T = 10


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(3):
        for d in range(4):
            x = rng.normal(size=(T, 3)).cumsum(axis=0)
            rows += [(s, d, t, *map(float, x[t]), float(rng.normal()), float(rng.random() + 0.1)) for t in range(T)]
    return spark.createDataFrame(rows, "symbol_id long, date_id int, time_id int, a double, b double, c double, y double, w double").persist()


def table(df, *cols):
    p = df.orderBy("symbol_id", "date_id", "time_id").toPandas()
    return p[list(cols)].to_numpy(dtype=float)


def signature_by_tuples(path, depth):
    """Iterated sums over ordered increments, equal ones weighted 1/k!."""
    d = np.diff(path, axis=0)
    n, c = d.shape
    out = [d.sum(axis=0)]
    if depth >= 2:
        out.append(sum(np.outer(d[i], d[j]) * (0.5 if i == j else 1.0) for i in range(n) for j in range(i, n)))
    if depth >= 3:
        s3 = np.zeros((c, c, c))
        for i, j, k in itertools.combinations_with_replacement(range(n), 3):
            f = {1: 1 / 6, 2: 0.5, 3: 1.0}[len({i, j, k})]
            s3 += f * np.einsum("i,j,k->ijk", d[i], d[j], d[k])
        out.append(s3)
    return out


def test_rolling_signature_depth3(panel):
    got = {(r[0], r[1], r[2]): r[3] for r in G.rolling_signature(panel, ["a", "b"], 4, 3, None, False, T).collect()}
    x = table(panel.where("symbol_id = 1 AND date_id = 2"), "a", "b")
    path = np.column_stack([np.linspace(0, 1, T), x])
    for t in (0, 1, 5, 9):
        seg = path[max(0, t - 3):t + 1]
        want = np.concatenate([v.ravel() for v in signature_by_tuples(seg, 3)]) if t else np.zeros(39)
        np.testing.assert_allclose(got[(1, 2, t)], want, atol=1e-12)


def test_hurst_weights_and_half_is_plain(panel):
    def sig(h):
        return {(r[0], r[1], r[2]): r[3] for r in G.rolling_signature(panel, ["a"], 5, 2, h, False, T).collect()}
    plain, half, rough = sig(None), sig(0.5), sig(0.1)
    np.testing.assert_allclose(plain[(0, 0, 7)], half[(0, 0, 7)], atol=1e-12)
    x = np.column_stack([np.linspace(0, 1, T), table(panel.where("symbol_id = 0 AND date_id = 0"), "a")])[3:8]
    inc = np.diff(x, axis=0) * ((1 - np.linspace(0, 1, 5)[:-1] + 1e-6) ** -0.4)[:, None]
    want = signature_by_tuples(np.vstack([np.zeros(2), inc.cumsum(axis=0)]), 2)
    np.testing.assert_allclose(rough[(0, 0, 7)], np.concatenate([v.ravel() for v in want]), atol=1e-9)


def test_column_signature_equals_kernel(panel):
    cols = ["s1_0", "s1_1", "s1_2"] + [f"s2_{i}_{j}" for i in range(3) for j in range(3)]
    a = table(G.window_signature(panel, ["a", "b"], 4, T), *cols)
    b = np.stack(G.rolling_signature(panel, ["a", "b"], 4, 2, None, False, T).orderBy("symbol_id", "date_id", "time_id").toPandas()["signature"])
    np.testing.assert_allclose(a, b, atol=1e-10)


def test_log_signature_level3_vanishes_on_a_line():
    line = np.linspace(0, 1, 6)[None, :, None] * np.array([1.0, 2.0])
    log = G.signature_vector(line, 3, None, True)[0]
    np.testing.assert_allclose(log[:2], [1, 2])
    np.testing.assert_allclose(log[2:], 0, atol=1e-12)


def test_story_signature_needs_all_days(panel):
    got = {(r[0], r[1]): r[2] for r in G.story_signature(panel, ["a", "b"], 2, 3, T).collect()}
    assert set(got) == {(s, d) for s in range(3) for d in (2, 3)}
    x = table(panel.where("symbol_id = 2 AND date_id IN (1, 2)"), "a", "b")[::3]
    path = np.column_stack([np.linspace(0, 1, len(x)), x])
    s1, s2 = signature_by_tuples(path, 2)
    area = (s2 - s2.T) / 2
    np.testing.assert_allclose(got[(2, 3)], np.concatenate([s1, area[np.triu_indices(3, 1)]]), atol=1e-10)


def test_sma_inverse_recovers_the_signal():
    rng = np.random.default_rng(2)
    t, rows = 60, 4
    s = rng.normal(size=t + rows - 1)
    r = np.array([s[i:i + rows].mean() for i in range(t)])
    m = Z.sma_inverse(t, rows, 1e-9)
    assert m.shape == (t + rows - 1, t)
    back = m @ r
    np.testing.assert_allclose([back[i:i + rows].mean() for i in range(t)], r, atol=1e-6)


def test_deconvolution_labels(panel):
    out = Z.deconvolve(panel, "y", 4, 0.5, T)
    got = table(out.where("symbol_id = 1 AND date_id = 1"), "signal", "innov1", "innov4")
    s = np.append(Z.sma_inverse(T, 4, 0.5) @ table(panel.where("symbol_id = 1 AND date_id = 1"), "y")[:, 0], 0.0)
    np.testing.assert_allclose(got[:, 0], s[:T], atol=1e-12)
    np.testing.assert_allclose(got[:, 1], s[1:T + 1], atol=1e-12)
    np.testing.assert_allclose(got[:, 2], [s[t + 1:t + 5].sum() / 4 for t in range(T)], atol=1e-12)


def test_lag_curve_by_direct_sums(panel):
    got = {r["lag"]: r["corr"] for r in Z.lag_curves(panel, ["a"], ["b"], 3, 3, T).where("kind = 'll:b'").collect()}
    p = panel.toPandas().sort_values(["symbol_id", "date_id", "time_id"])
    sums = {k: [] for k in range(-3, 4)}
    for _, g in p.groupby(["symbol_id", "date_id"]):
        za, zb = ((g[c] - g[c].mean()) / g[c].std(ddof=0) for c in "ab")
        for k in sums:
            sums[k].append(sum(za.iloc[t] * zb.iloc[t + k] for t in range(T) if 0 <= t + k < T) / (T - abs(k)))
    for k, v in sums.items():
        assert abs(got[k] - np.mean(v)) < 1e-12


@pytest.mark.parametrize("tile", [512, 2])
def test_symbol_correlation_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(K, "TILE_SYMBOLS", tile)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 7))
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(s, i // 10, i % 10, float(x[i, s])) for i in range(50) for s in range(7) if not np.isnan(x[i, s])]
    df = spark.createDataFrame(rows, "symbol_id long, date_id int, time_id int, x double")
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in K.symbol_correlation(df, "x", 1).collect()}
    assert set(got) == set(itertools.combinations(range(7), 2))
    for (a, b), (n, c) in got.items():
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        assert n == both.sum() and abs(c - np.corrcoef(x[both, a], x[both, b])[0, 1]) < 1e-9


def test_gram_and_ridge(panel):
    x, y, w = table(panel, "a", "b"), table(panel, "y")[:, 0], table(panel, "w")[:, 0]
    coef = M.ridge_fit(panel, ["a", "b"], "y", "w", 2.0)
    np.testing.assert_allclose(coef, np.linalg.solve((x * w[:, None]).T @ x + 2 * np.eye(2), (x * w[:, None]).T @ y))


def test_walk_forward_equals_day_loop(panel):
    out = walk_forward(panel, ["a", "b"], 2, lam=1.0).orderBy("symbol_id", "date_id", "time_id").toPandas()
    p = panel.toPandas()
    for d in (2, 3):
        past = p[p.date_id < d]
        x, w = past[["a", "b"]].to_numpy(), past["w"].to_numpy()
        coef = np.linalg.solve((x * w[:, None]).T @ x + np.eye(2), (x * w[:, None]).T @ past["y"].to_numpy())
        here = out[out.date_id == d]
        np.testing.assert_allclose(here["pred"], np.clip(here[["a", "b"]].to_numpy() @ coef, -5, 5), atol=1e-9)


def test_ar_holdout_against_numpy(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(3):
        for d in range(5):
            x = rng.normal(size=40).cumsum()
            rows += [(s, d, t, float(x[t]), float(0.5 * x[t - 1] if t else 0) + float(rng.normal())) for t in range(40)]
    df = spark.createDataFrame(rows, "symbol_id long, date_id int, time_id int, x double, y double")
    p = df.toPandas().sort_values(["symbol_id", "date_id", "time_id"])
    for inc, ma in ((False, 0), (True, 2)):
        src = p.groupby(["symbol_id", "date_id"])["x"].diff() if inc else p["x"]
        q = p.assign(_x=src)
        lags = np.column_stack([q.groupby(["symbol_id", "date_id"])["_x"].shift(k) for k in (1, 2, 3)])
        ok = ~np.isnan(lags).any(axis=1)
        x, y = lags[ok], p["y"].to_numpy()[ok]
        for k in range(1, ma + 1):
            x = np.column_stack([x, np.concatenate([np.zeros(k), y[:-k]])])
        n = int(0.7 * len(y))
        mu, sd = x[:n].mean(0), x[:n].std(0) + 1e-12
        z = (x - mu) / sd
        w = np.linalg.solve(z[:n].T @ z[:n] + 1e-2 * np.eye(x.shape[1]), z[:n].T @ (y[:n] - y[:n].mean()))
        want = 1 - ((y[n:] - z[n:] @ w - y[:n].mean()) ** 2).sum() / ((y[n:] - y[n:].mean()) ** 2).sum()
        assert abs(S.ar_holdout(df, "x", "y", 3, inc, ma) - want) < 1e-8


def test_linkages_by_brute_force():
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(9, 3))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    dist = {"complete": lambda a, b: max(d[i, j] for i in a for j in b),
            "average": lambda a, b: np.mean([d[i, j] for i in a for j in b]),
            "ward": lambda a, b: np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(pts[a].mean(0) - pts[b].mean(0))}
    for method, f in dist.items():
        groups, heights = [[i] for i in range(9)], []
        while len(groups) > 1:
            (i, j), h = min((((i, j), f(groups[i], groups[j])) for i, j in itertools.combinations(range(len(groups)), 2)), key=lambda v: v[1])
            heights.append(h)
            groups[i] += groups.pop(j)
            if len(groups) == 3:
                three = {frozenset(g) for g in groups}
        merges = C.merge_order(d, method)
        np.testing.assert_allclose([m[2] for m in merges], heights)
        labels = C.cut(9, merges, k=3)
        assert {frozenset(i for i in range(9) if labels[i] == lb) for lb in set(labels)} == three


def test_ward_in_rounds(spark):
    """Rounds of mutual nearest clusters cut like one merge at a time; equal profiles; a far pair that meets early and is parted."""
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(size=(150, 3)) + 9 * rng.integers(0, 3, size=(150, 1)), [[400, 0, 0], [460, 0, 0]]])
    pts = np.concatenate([pts, pts[:40], pts[:40]])
    rows = spark.createDataFrame([(1000 - i, *map(float, p)) for i, p in enumerate(pts)], "symbol_id long, a double, b double, c double")
    whole = {tuple(r) for r in C.ward_labels(rows, ["a", "b", "c"], 6).collect()}
    assert {tuple(r) for r in C.ward_labels(rows, ["a", "b", "c"], 6, few=50).collect()} == whole


def test_ward_rounds_keep_small_estimates(spark, monkeypatch):
    """A round's table does not carry the product of all sizes before it, whose digits doubled every round."""
    digits, one_round = [], C._ward_round

    def watched(clusters, n, xs):
        digits.append(len(str(clusters._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return one_round(clusters, n, xs)
    monkeypatch.setattr(C, "_ward_round", watched)
    rows = spark.createDataFrame([(i, float(i * i % 97 + i / 200)) for i in range(120)], "symbol_id long, a double")
    assert C.ward_labels(rows, ["a"], 3, few=20).count() == 120
    assert len(digits) > 3 and max(digits) < 12


def test_profiles_of_many_symbols(spark):
    n = C.MAX_ITEMS + 500
    panel = spark.range(n).select(F.col("id").alias("symbol_id"), F.lit(0).alias("date_id"), F.lit(0).alias("time_id"),
                                  ((F.col("id") % 3) * 10 + (F.col("id") % 50) / 100).alias("a"))
    got = {r.symbol_id: r.cluster for r in C.profile_clusters(panel, ["a"], 3).collect()}
    assert len(got) == n and all(c == s % 3 + 1 for s, c in got.items())


def test_combo_equal_to_a_parent_does_not_beat_it(spark):
    """The larger of columns that never cross is the larger column, in whatever order its rows are summed."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6)) + 20 * np.arange(6)
    rows = spark.createDataFrame([(*map(float, v), float(y)) for v, y in zip(x, x.sum(axis=1) + rng.normal(size=4000))], "a double, b double, c double, d double, e double, f double, y double")

    def shuffled(batches):
        import random
        for pdf in batches:
            yield pdf.sample(frac=1, random_state=random.SystemRandom().randrange(2**31))
    found = S.combo_screen(rows.mapInPandas(shuffled, rows.schema), list("abcdef"), "y").collect()
    assert not [r["label"] for r in found if r["op"] in ("min", "max")]


def test_greedy_pick_cap():
    corr = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert S.greedy_pick(["a", "b", "c"], corr, 2, 0.6) == ["a", "c"]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9), st.sampled_from([0.0, 1.0, 1e-300, 1e12])), min_size=1, max_size=60))
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, {"x": [0.001, 0.5, 0.9]})["x"]
    kept = np.array([v for v in values if v is not None])
    if not len(kept):
        assert got == [None] * 3
    else:
        np.testing.assert_allclose(got, np.quantile(kept, [0.001, 0.5, 0.9]), rtol=1e-12, atol=1e-300)


def test_quantiles_narrow_a_skewed_column(spark):
    """Large enough that brackets are cut by histograms, with one heavy value."""
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.exp((F.col("id") * 7919 % 60000) / 3000.0)).alias("x"))
    x = np.array([r[0] for r in df.collect()])
    got = exact_quantiles(df, {"x": [0.001, 0.3, 0.999]})["x"]
    np.testing.assert_allclose(got, np.quantile(x, [0.001, 0.3, 0.999]), rtol=1e-12)


def test_ordered_rows_counts_from_zero(spark):
    df = spark.range(500).select((F.col("id") * 70001 % 997).alias("symbol_id"), (F.col("id") % 4).cast("int").alias("date_id"),
                                 F.col("id").cast("int").alias("time_id"))
    got = [r["_row"] for r in S.ordered_rows(df).orderBy("symbol_id", "date_id", "time_id").collect()]
    assert got == list(range(500))


def test_simplex_optimum_against_all_faces():
    from tidewheel.operators.ensemble import simplex_optimum
    rng = np.random.default_rng(11)
    for trial in range(200):
        m = int(rng.integers(1, 6))
        x = rng.normal(size=(8, m)) * 10.0 ** rng.integers(-3, 4)
        if trial % 5 == 0 and m > 1:
            x[:, -1] = x[:, 0]
        q, b = x.T @ x, x.T @ (x @ rng.dirichlet(np.ones(m)) + rng.normal(size=8) * np.abs(x).mean())
        a = simplex_optimum(q, b)
        best = np.inf
        for size in range(1, m + 1):
            for face in itertools.combinations(range(m), size):
                f = list(face)
                system = np.block([[q[np.ix_(f, f)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
                w = np.zeros(m)
                w[f] = np.linalg.lstsq(system, np.append(b[f], 1.0), rcond=None)[0][:size]
                if (w >= -1e-9).all() and abs(w.sum() - 1) < 1e-6:
                    best = min(best, w @ q @ w / 2 - b @ w)
        assert (a >= 0).all() and abs(a.sum() - 1) < 1e-9
        assert a @ q @ a / 2 - b @ a <= best + 1e-8 * max(1.0, abs(best))


@pytest.mark.parametrize("shape", [(5, 30, 7), (3, 10, 9), (1, 1, 0), (4, 13, 3)])
def test_lag_sums_by_direct_sums(shape):
    n, t, reach = shape
    rng = np.random.default_rng(t)
    a, b = rng.normal(size=(n, t)), rng.normal(size=(n, t))
    want = [(a[:, :t - k] * b[:, k:]).sum() for k in range(reach + 1)]
    np.testing.assert_allclose(Z.lag_sums(a, b, reach), want, atol=1e-10)


def test_lag_curves_leave_flat_and_missing_series_out(spark):
    rows = [(s, 0, t, {0: 1.0, 1: float(t % 3), 2: None if t < 7 else 1.0 * t, 3: float("nan") if t == 2 else float(t * t)}[s]) for s in range(4) for t in range(12)]
    df = spark.createDataFrame([*rows, (4, 0, 0, 1.0)], "symbol_id long, date_id int, time_id int, x double")
    got = {r["lag"]: (r["corr"], r["n_series"]) for r in Z.lag_curves(df, ["x"], [], 0, 2, 12).collect()}
    z = np.array([[t % 3 for t in range(12)], [t * t for t in range(12)]], dtype=float)
    z[1, 2] = np.delete(z[1], 2).mean()
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, keepdims=True)
    assert {k: n for k, (_, n) in got.items()} == {0: 2, 1: 2, 2: 2}
    for k, (c, _) in got.items():
        assert abs(c - (z[:, :12 - k] * z[:, k:]).sum() / (12 - k) / 2) < 1e-12


@pytest.mark.parametrize("rows", [8, 5])
def test_band_energy_against_a_transform(spark, rows):
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(3, 20)) + np.array([[0.0], [1e6], [5.0]])
    x[2] = 7e5
    df = spark.createDataFrame([(s, 0, t, float(x[s, t])) for s in range(3) for t in range(20)] + [(9, 0, 0, 1.0)], "symbol_id long, date_id int, time_id int, x double")
    bands = [(1, 2), (2, rows // 2 + 1)]
    out = Z.band_energy(df, ["x"], rows, bands, 20)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["symbol_id"], r["time_id"]): (r["x_band0"], r["x_band1"]) for r in out.collect()}
    assert len(got) == 60
    for s in range(3):
        for t in range(20):
            if t < rows - 1:
                assert got[s, t] == (None, None)
                continue
            window = x[s, t - rows + 1:t + 1]
            e = np.abs(np.fft.rfft(window - window.mean())) ** 2
            want = [np.log(e[lo:hi].sum() / (e[1:].sum() + 1e-12) + 1e-6) for lo, hi in bands]
            np.testing.assert_allclose(got[s, t], want, atol=1e-5)
