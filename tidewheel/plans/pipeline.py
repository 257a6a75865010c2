"""Preprocess, fit, predict and update, day by day: one contract, two ways to run it.

``PanelPipeline`` holds a clipper, a running scaler and a model; ``update``
moves the scaler by a day's rows, then lets the model learn from them.
``daily_walk`` evaluates the same recursion for a ridge model over a whole
validation period as one plan.  A day's rows enter only through their moments
and the products of (values, presence, label): from those, the standardised
Gram table follows under whatever scaler state the day is learned with.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.scalars import clip, clip_prediction, nan_to_null
from tidewheel.names import DATE
from tidewheel.operators.decay import decayed_sums
from tidewheel.operators.moments import VAR_FLOOR, daily_moments, gram, gram_matrix, linear_score, ridge_solve, running_moments
from tidewheel.operators.preprocess import FeatureStats, clip_ranges, standardise, transform
from tidewheel.operators.scores import r2

BLOCK = "_block"


class Learner(Protocol):
    """What a pipeline's model does; frames hold standardised columns, ``y`` and ``w``."""

    def fit(self, rows: DataFrame, cols: list[str]) -> None: ...

    def update(self, rows: DataFrame, cols: list[str]) -> None: ...

    def predict(self, rows: DataFrame, cols: list[str]) -> DataFrame: ...

    def state(self) -> dict[str, Any]: ...


@dataclass
class RidgeLearner:
    """Weighted ridge without intercept; ``factor`` is what a day keeps of all before it."""

    lam: float = 100.0
    factor: float = 1.0
    table: list[list[float]] | None = None

    def _products(self, rows: DataFrame, cols: list[str]) -> np.ndarray:
        return gram_matrix(gram(rows.where(F.col("y").isNotNull()), [*cols, "y"], "w"), len(cols) + 1)

    def fit(self, rows: DataFrame, cols: list[str]) -> None:
        self.table = self._products(rows, cols).tolist()

    def update(self, rows: DataFrame, cols: list[str]) -> None:
        self.table = (self.factor * np.array(self.table) + self._products(rows, cols)).tolist()

    def predict(self, rows: DataFrame, cols: list[str]) -> DataFrame:
        return rows.withColumn("pred", linear_score(cols, ridge_solve(np.array(self.table), len(cols), self.lam)))

    def state(self) -> dict[str, Any]:
        return asdict(self)


LEARNERS: dict[str, type] = {"ridge": RidgeLearner}


def get_learner(name: str, **settings: Any) -> Learner:
    if name not in LEARNERS:
        raise KeyError(f"unknown model {name}; have {sorted(LEARNERS)}")
    return LEARNERS[name](**settings)


@dataclass
class PanelPipeline:
    """Clip ranges and scaler of the fit, a scaler that goes on learning, and a model.

    Frames have the feature columns, ``y`` and ``w``.  NaN is missing; rows
    without label move the scaler but teach nothing.
    """

    cols: list[str]
    model: Learner
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    n: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    m2: dict[str, float] = field(default_factory=dict)

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in self.cols})

    def _absorb(self, clipped: DataFrame) -> None:
        """Merge the moments of a block; its count is the median over the columns."""
        for r in daily_moments(clipped.withColumn(DATE, F.lit(0)), self.cols).collect():
            c, new = r["feature"], float(r["n"])
            if r["mean"] is None or new == 0:
                continue
            before, mean = self.n.get(c, 0.0), self.mean.get(c, 0.0)
            delta, total = r["mean"] - mean, before + new
            self.m2[c] = self.m2.get(c, 0.0) + r["var"] * new + delta * delta * before * new / total
            self.mean[c], self.n[c] = mean + delta * new / total, total

    def stats(self) -> dict[str, FeatureStats]:
        out = {}
        for c in self.cols:
            lo, hi = self.ranges.get(c, (None, None))
            lo, hi = (float("-inf"), float("inf")) if lo is None else (lo, hi)
            var = self.m2.get(c, 0.0) / max(self.n.get(c, 0.0), 1.0)
            out[c] = FeatureStats(lo, hi, self.mean.get(c, 0.0), max(var, VAR_FLOOR) ** 0.5)
        return out

    def _clipped(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(c, *self.ranges[c]) for c in self.cols if self.ranges[c][0] is not None})

    def fit(self, train: DataFrame) -> "PanelPipeline":
        train = self._clean(train)
        self.ranges = clip_ranges(train, self.cols)
        self.n, self.mean, self.m2 = {}, {}, {}
        self._absorb(self._clipped(train))
        self.model.fit(transform(train, self.stats()), self.cols)
        return self

    def predict(self, df: DataFrame, bound: float = 5.0) -> DataFrame:
        """``df`` with ``pred``; its other columns are left as they are."""
        kept = df.columns
        rows = self._clean(df).withColumns({f"_raw_{c}": F.col(c) for c in self.cols})
        scored = self.model.predict(transform(rows, self.stats()), self.cols)
        scored = scored.withColumn("pred", clip_prediction("pred", bound))
        return scored.withColumns({c: F.col(f"_raw_{c}") for c in self.cols}).select(*kept, "pred")

    def update(self, day: DataFrame) -> None:
        day = self._clean(day)
        self._absorb(self._clipped(day))
        self.model.update(transform(day, self.stats()), self.cols)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON row; written through Spark, so any store will do."""
        name = next(k for k, v in LEARNERS.items() if isinstance(self.model, v))
        state = {"cols": self.cols, "ranges": self.ranges, "n": self.n, "mean": self.mean, "m2": self.m2, "model": name, "settings": self.model.state()}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PanelPipeline":
        state = json.loads(spark.read.text(path).first()["value"])
        model = get_learner(state.pop("model"), **state.pop("settings"))
        ranges = {c: tuple(v) for c, v in state.pop("ranges").items()}
        return PanelPipeline(model=model, ranges=ranges, **state)


def learned_dates(valid: Iterable[int]) -> list[int]:
    """Validation dates that are learned from: those whose next day is evaluated too."""
    valid = set(valid)
    return sorted(v for v in valid if v + 1 in valid)


def daily_walk(df: DataFrame, cols: list[str], train: Iterable[int], valid: Iterable[int], lam: float = 100.0,
               factor: float = 1.0, bound: float = 5.0) -> DataFrame:
    """``pred`` for every row of the ``valid`` dates, as fit, predict and update would give day by day.

    The training dates are one block, every learned validation date is another;
    a date is predicted with the blocks before it and nothing later.  The rows
    are read three times: for the clip ranges, for the moments and products of
    the blocks, and for the predictions.
    """
    train, valid = sorted(set(train)), sorted(set(valid))
    if not train or not valid or train[-1] >= valid[0]:
        raise ValueError("training dates come before validation dates")
    learned = learned_dates(valid)
    spark, k = df.sparkSession, len(cols)
    rows = df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in cols})
    ranges = clip_ranges(rows.where(F.col(DATE).isin(train)), cols)
    wide = {c: (lo if lo is not None else float("-inf"), hi if hi is not None else float("inf")) for c, (lo, hi) in ranges.items()}
    clipped = rows.withColumns({c: clip(c, *wide[c]) for c in cols})
    number = spark.createDataFrame([(d, 0) for d in train] + [(d, i) for i, d in enumerate(learned, 1)], f"{DATE} {dict(df.dtypes)[DATE]}, {BLOCK} int")
    blocks = clipped.join(F.broadcast(number), DATE).drop(DATE)

    # Scaler after each block, the same merge as in ``PanelPipeline``.
    state = running_moments(daily_moments(blocks.withColumnRenamed(BLOCK, DATE), cols)).withColumnRenamed(DATE, BLOCK)
    state = state.groupBy(BLOCK).agg(*[F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"{v}_{i}") for i, c in enumerate(cols) for v in ("mean", "std")])
    state = state.select(BLOCK, F.array(*[F.coalesce(f"mean_{i}", F.lit(0.0)) for i in range(k)]).alias("mean"),
                         F.array(*[F.coalesce(f"std_{i}", F.lit(VAR_FLOOR ** 0.5)) for i in range(k)]).alias("std"))

    # Products of (values, presence, label); values are measured on the training scale, which keeps digits.
    first = state.where(F.col(BLOCK) == 0).first()
    centre, scale = (np.array(first["mean"]), np.array(first["std"])) if first else (np.zeros(k), np.ones(k))
    taught = blocks.where(F.col("y").isNotNull()).select(
        BLOCK, "w", "y", *[((F.col(c) - F.lit(float(centre[i]))) / F.lit(float(scale[i]))).alias(f"_u{i}") for i, c in enumerate(cols)],
        *[F.col(c).isNotNull().cast("double").alias(f"_m{i}") for i, c in enumerate(cols)])
    products = gram(taught, [*[f"_u{i}" for i in range(k)], *[f"_m{i}" for i in range(k)], "y"], "w", by=[BLOCK])

    def standardised(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((2 * k + 1, 2 * k + 1))
        g[pdf["i"], pdf["j"]] = g[pdf["j"], pdf["i"]] = pdf["value"]
        std = np.asarray(pdf["std"].iloc[0]) / scale
        mean = (np.asarray(pdf["mean"].iloc[0]) - centre) / scale
        # A standardised value is (u - mean * m) / std, u and m being 0 where it is missing.
        to = np.zeros((k + 1, 2 * k + 1))
        to[np.arange(k), np.arange(k)], to[np.arange(k), k + np.arange(k)], to[k, 2 * k] = 1 / std, -mean / std, 1.0
        out, (i, j) = to @ g @ to.T, np.triu_indices(k + 1)
        return pd.DataFrame({BLOCK: pdf[BLOCK].iloc[0], "i": i, "j": j, "value": out[i, j]})

    tables = products.join(F.broadcast(state), BLOCK).groupBy(BLOCK).applyInPandas(standardised, f"{BLOCK} int, i int, j int, value double")
    cells = spark.range((k + 1) * (k + 1)).select(F.floor(F.col("id") / (k + 1)).cast("int").alias("i"), (F.col("id") % (k + 1)).cast("int").alias("j")).where("i <= j")
    blank = cells.withColumn(BLOCK, F.explode(F.sequence(F.lit(0), F.lit(len(learned))))).select(BLOCK, "i", "j", F.lit(0.0).alias("value"))
    every = tables.unionByName(blank).groupBy(BLOCK, "i", "j").agg(F.sum("value").alias("value"))
    carried = decayed_sums(every, ["i", "j"], BLOCK, "value", factor, len(learned) + 1)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((k + 1, k + 1))
        g[pdf["i"], pdf["j"]] = g[pdf["j"], pdf["i"]] = pdf["value"]
        return pd.DataFrame({BLOCK: [pdf[BLOCK].iloc[0]], "coef": [ridge_solve(g, k, lam).tolist()]})

    coefs = carried.groupBy(BLOCK).applyInPandas(solve, f"{BLOCK} int, coef array<double>").join(state, BLOCK)
    # The latest block whose date lies before the predicted one.
    used = spark.createDataFrame([(d, sum(x < d for x in learned)) for d in valid], f"{DATE} {dict(df.dtypes)[DATE]}, {BLOCK} int")
    scored = df.withColumns({f"_z{i}": nan_to_null(F.col(c).cast("double")) for i, c in enumerate(cols)})
    scored = scored.join(F.broadcast(coefs.join(used, BLOCK).drop(BLOCK)), DATE)
    pred = sum((F.col("coef")[i] * standardise(f"_z{i}", *wide[c], F.col("mean")[i], F.col("std")[i]) for i, c in enumerate(cols)), F.lit(0.0))
    return scored.withColumn("pred", clip_prediction(pred, bound)).select(*df.columns, "pred")


def fold_scores(df: DataFrame, cols: list[str], folds: Iterable[tuple[Iterable[int], Iterable[int]]], **settings: Any) -> DataFrame:
    """(fold, date_id, r2): every fold's daily scores."""
    parts = [r2(daily_walk(df, cols, train, valid, **settings), [DATE]).select(F.lit(i).alias("fold"), DATE, "r2") for i, (train, valid) in enumerate(folds)]
    if not parts:
        raise ValueError("no folds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
