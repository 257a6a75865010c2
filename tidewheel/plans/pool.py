"""Standardised pool and block-structured enriched pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.scalars import combo, combo_name, one_hot
from tidewheel.names import KEYS, RANKED_FEATURES
from tidewheel.operators.crosssection import market_split, rank_unit
from tidewheel.operators.lags import attach_map
from tidewheel.operators.preprocess import FeatureStats, fit, transform
from tidewheel.operators.shifts import day_differences, lag_differences
from tidewheel.sources.panel import manifest
from tidewheel.sources.sinks import write_by_date, write_metrics


def build_pool(features: DataFrame, cols: list[str], train_until: int, every: int = 1,
               keep: list[str] = ("weight", "responder_6")) -> tuple[DataFrame, dict[str, FeatureStats]]:
    """Fit on training dates, freeze, standardise every row."""
    stats = fit(features, cols, train_until, every)
    return transform(features.select(*KEYS, *keep, *cols), stats), stats


def write_pool(pool: DataFrame, path: str, files_per_date: int | None = None) -> None:
    """Rows by date and the per-date manifest beside them."""
    write_by_date(pool, f"{path}/rows", files_per_date)
    written = pool.sparkSession.read.parquet(f"{path}/rows")
    write_metrics(manifest(written), f"{path}/manifest")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def enrich(pool: DataFrame, base: list[str], combos: list[tuple[str, str, str]] = (), split: list[str] = (),
           trailing: list[str] = (), deltas: list[int] = (1, 8, 40), clusters: DataFrame | None = None,
           n_clusters: int = 0, ranks: list[str] = RANKED_FEATURES, chain: DataFrame | None = None,
           differences: bool = True) -> tuple[DataFrame, dict[str, list[str]]]:
    """Base columns plus named blocks, and the block -> columns table."""
    blocks = {"base": list(base)}
    df = pool
    if combos:
        df = df.withColumns({combo_name(op, a, b): combo(op, a, b) for op, a, b in combos})
        blocks["combos"] = [combo_name(*c) for c in combos]
    if split:
        df = market_split(df, split)
        blocks["decomp"] = [f"{c}_mkt" for c in split] + [f"{c}_idio" for c in split]
    if differences:
        before = set(df.columns)
        df = lag_differences(df)
        blocks["rsig"] = [c for c in df.columns if c not in before]
    if trailing:
        df = day_differences(df, trailing, deltas)
        blocks["innov"] = [f"{c}_diff_{k}" for c in trailing for k in deltas]
    if clusters is not None:
        df = one_hot(attach_map(df, clusters, "cluster", 0), "cluster", list(range(1, n_clusters + 1)), "cluster")
        blocks["cluster"] = [f"cluster_{k}" for k in range(1, n_clusters + 1)]
    if chain is not None:
        names = [c for c in chain.columns if c not in KEYS]
        df = df.join(chain, KEYS, "left")
        blocks["chain"] = names
    if ranks:
        df = rank_unit(df, ranks)
        blocks["ranks"] = [f"{c}_rank01" for c in ranks]
    return df, blocks


def nested_variants(blocks: dict[str, list[str]]) -> dict[str, list[str]]:
    """Growing column sets: each variant adds one block to the previous."""
    out, cols = {}, []
    for name, block in blocks.items():
        cols = cols + block
        out[name] = list(cols)
    return out


def storage(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in cols})
