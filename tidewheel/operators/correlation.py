"""Correlation matrices of columns and of symbols, and partition agreement."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scalars import zero_fill
from tidewheel.names import STEP, SYMBOL

TILE_SYMBOLS = 512


def column_correlation(df: DataFrame, cols: list[str]) -> np.ndarray:
    """K x K Pearson matrix, missing = 0, undefined = 0."""
    filled = df.select(*[zero_fill(F.col(c).cast("double")).alias(c) for c in cols])
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(filled)
    return _matrix(vec.select("_v"))


def array_correlation(df: DataFrame, array_col: str) -> np.ndarray:
    """The same for the positions of an array column."""
    vec = df.select(array_to_vector(F.transform(array_col, lambda x: x.cast("double"))).alias("_v"))
    return _matrix(vec)


def _matrix(vec: DataFrame) -> np.ndarray:
    c = Correlation.corr(vec, "_v").head()[0].toArray()
    c = np.nan_to_num(c, nan=0.0)
    np.fill_diagonal(c, 1.0)
    return c


def stream_correlation(wide: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, corr) for each pair of aligned prediction columns."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    row = wide.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])).alias("_r")).select("_r.*")


def symbol_correlation(df: DataFrame, col: str, min_obs: int = 501) -> DataFrame:
    """(a, b, n, corr), a < b, pairwise complete over steps, n >= min_obs.

    Symbols fall into tiles of about TILE_SYMBOLS.  A step contributes one
    vector per tile, tiles are paired per step, and each Arrow batch becomes
    blocks of cross products by matrix multiplication, so symbol pairs appear
    only as sums.  Bounded: a vector holds one tile's symbols.
    """
    symbols = df.select(SYMBOL).distinct().count()
    tiles = max(1, -(-symbols // TILE_SYMBOLS))
    x = df.where(F.col(col).isNotNull() & ~F.isnan(col)).select(
        *STEP, F.pmod(F.xxhash64(SYMBOL), F.lit(tiles)).alias("_t"), F.col(SYMBOL).cast("long").alias("s"),
        F.col(col).cast("double").alias("x"))
    vec = x.groupBy(*STEP, "_t").agg(F.collect_list(F.struct("s", "x")).alias("_v"))
    left = vec.select(*STEP, F.col("_t").alias("_ta"), F.col("_v.s").alias("sa"), F.col("_v.x").alias("xa"))
    if tiles == 1:
        pairs = left.select("_ta", F.col("_ta").alias("_tb"), "sa", "xa", F.col("sa").alias("sb"), F.col("xa").alias("xb"))
    else:
        right = vec.select(*STEP, F.col("_t").alias("_tb"), F.col("_v.s").alias("sb"), F.col("_v.x").alias("xb"))
        pairs = left.join(right, STEP).where("_ta <= _tb").select("_ta", "_tb", "sa", "xa", "sb", "xb")

    def dense(ids: list, xs: list) -> tuple[np.ndarray, np.ndarray]:
        names = np.unique(np.concatenate(ids))
        m = np.full((len(ids), len(names)), np.nan)
        for r, (s, v) in enumerate(zip(ids, xs)):
            m[r, np.searchsorted(names, s)] = v
        return names, m

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(["_ta", "_tb"], sort=False):
                na, a = dense(list(part["sa"]), list(part["xa"]))
                nb, b = dense(list(part["sb"]), list(part["xb"]))
                ma, mb = ~np.isnan(a), ~np.isnan(b)
                a, b = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
                fa, fb = ma.astype(float), mb.astype(float)
                out = {"n": fa.T @ fb, "sa": a.T @ fb, "sb": fa.T @ b, "qa": (a * a).T @ fb,
                       "qb": fa.T @ (b * b), "ab": a.T @ b}
                ia, ib = np.nonzero(out["n"])
                pa, pb = na[ia], nb[ib]
                # Tiles pair once, so a pair may come out in either order.
                flip = pa > pb
                keep = (pa != pb) if part["_ta"].iloc[0] != part["_tb"].iloc[0] else pa < pb
                v = {k: m[ia, ib] for k, m in out.items()}
                yield pd.DataFrame({
                    "a": np.where(flip, pb, pa), "b": np.where(flip, pa, pb), "n": v["n"],
                    "sa": np.where(flip, v["sb"], v["sa"]), "sb": np.where(flip, v["sa"], v["sb"]),
                    "qa": np.where(flip, v["qb"], v["qa"]), "qb": np.where(flip, v["qa"], v["qb"]),
                    "ab": v["ab"]})[keep]

    parts = pairs.mapInPandas(sums, "a long, b long, n double, sa double, sb double, qa double, qb double, ab double")
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")])
    va = F.col("qa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("qb") - F.col("sb") * F.col("sb") / F.col("n")
    r = F.try_divide(F.col("ab") - F.col("sa") * F.col("sb") / F.col("n"), F.sqrt(F.greatest(va * vb, F.lit(0.0))))
    return total.where(F.col("n") >= min_obs).select("a", "b", F.col("n").cast("long").alias("n"), r.alias("corr"))


def intra_inter(corr: DataFrame, mapping: DataFrame, value: str = "cluster") -> DataFrame:
    """Mean pairwise correlation inside and between clusters."""
    ma = mapping.select(F.col(SYMBOL).alias("a"), F.col(value).alias("_ca"))
    mb = mapping.select(F.col(SYMBOL).alias("b"), F.col(value).alias("_cb"))
    same = F.col("_ca") == F.col("_cb")
    return (corr.join(ma, "a").join(mb, "b")
            .agg(F.avg(F.when(same, F.col("corr"))).alias("intra"), F.avg(F.when(~same, F.col("corr"))).alias("inter")))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))

    def pairs(n):
        return n * (n - 1) / 2.0

    def margin(key: str, name: str) -> DataFrame:
        return cells.groupBy(key).agg(F.sum("_n").alias("_n")).agg(F.sum(pairs(F.col("_n"))).alias(name), F.lit(1).alias("_one"))

    joint = cells.agg(F.sum(pairs(F.col("_n"))).alias("_ij"), F.sum("_n").alias("_t"), F.lit(1).alias("_one"))
    row = joint.join(margin(a, "_i"), "_one").join(margin(b, "_j"), "_one")
    expected = F.try_divide(F.col("_i") * F.col("_j"), pairs(F.col("_t")))
    best = (F.col("_i") + F.col("_j")) / 2.0
    # Both labelings trivial: they agree by definition.
    return row.select(F.coalesce(F.try_divide(F.col("_ij") - expected, best - expected), F.lit(1.0)).alias("ari"))


def cluster_sizes(mapping: DataFrame, value: str = "cluster") -> DataFrame:
    """Cluster sizes with the members in order (symbol maps are small)."""
    return mapping.groupBy(value).agg(
        F.count(F.lit(1)).alias("size"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(SYMBOL)), lambda s: s.cast("string"))).alias("members"))


def pair_table(names: Iterable[str], matrix: np.ndarray) -> list[tuple[str, str, float]]:
    """Upper triangle of a matrix as (a, b, corr) rows."""
    names = list(names)
    return [(a, names[j], float(matrix[i, j])) for i, a in enumerate(names) for j in range(i + 1, len(names))]
