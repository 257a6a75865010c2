"""Named model factories on MLlib, and the fit patterns around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scalars import clip_prediction, combo, log_abs, vol_from_log, zero_fill
from tidewheel.names import DATE, KEYS
from tidewheel.operators.moments import linear_score, ridge_fit
from tidewheel.operators.scores import r2
from tidewheel.session import scratch_path


def _vector(cols: list[str], vec: str) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=vec, handleInvalid="error")


def boosted_trees(cols: list[str], label: str, weight: str, vec: str = "_vec", max_iter: int = 20, depth: int = 5,
                  step: float = 0.05, subsample: float = 0.8, features: str = "0.5", seed: int = 42,
                  validation: str | None = None) -> Pipeline:
    """Weighted boosted trees; with a validation flag column, early stopping."""
    gbt = GBTRegressor(featuresCol=vec, labelCol=label, weightCol=weight, predictionCol="pred", maxIter=max_iter,
                       maxDepth=depth, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=features, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[_vector(cols, vec), gbt])


def linear(cols: list[str], label: str, weight: str, vec: str = "_vec", reg: float = 0.0) -> Pipeline:
    """Weighted linear model solved from the normal equations."""
    lr = LinearRegression(featuresCol=vec, labelCol=label, weightCol=weight, predictionCol="pred", regParam=reg,
                          fitIntercept=True, solver="normal")
    return Pipeline(stages=[_vector(cols, vec), lr])


MODELS: dict[str, Callable[..., Pipeline]] = {"boosted_trees": boosted_trees, "linear": linear}


def get_model(name: str, cols: list[str], label: str, weight: str, **kw) -> Pipeline:
    if name not in MODELS:
        raise KeyError(f"unknown model {name}; have {sorted(MODELS)}")
    return MODELS[name](cols, label, weight, **kw)


def _ready(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: zero_fill(c) for c in cols})


def fit(name: str, train: DataFrame, cols: list[str], label: str = "y", weight: str = "w", **kw) -> PipelineModel:
    rows = _ready(train, cols).where(F.col(label).isNotNull() & (F.col(weight) > 0))
    return get_model(name, cols, label, weight, **kw).fit(rows)


def predict(model: PipelineModel, df: DataFrame, cols: list[str], bound: float | None = 5.0) -> DataFrame:
    """``pred`` beside the untouched columns, clipped to +-bound."""
    raw = _ready(df.select(*df.columns, *[F.col(c).alias(f"_raw_{c}") for c in cols]), cols)
    out = model.transform(raw).drop("_vec")
    out = out.withColumns({c: F.col(f"_raw_{c}") for c in cols}).drop(*[f"_raw_{c}" for c in cols])
    return out.withColumn("pred", clip_prediction("pred", bound)) if bound else out


def importances(model: PipelineModel, cols: list[str]) -> list[tuple[str, float]]:
    return list(zip(cols, (float(v) for v in model.stages[-1].featureImportances.toArray())))


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the lowest error, whether ``patience`` more did not better it)."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def _first_rounds(model: PipelineModel, n: int) -> PipelineModel:
    """The model of the first ``n`` trees."""
    whole = model.stages[-1]
    jvm = whole._java_obj
    trees = jvm.trees()
    gateway = SparkContext._active_spark_context._gateway
    first = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, w in enumerate(whole.treeWeights[:n]):
        first[i], weights[i] = trees[i], w
    part = GBTRegressionModel(gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(whole.uid, first, weights))
    return PipelineModel([*model.stages[:-1], part.setFeaturesCol(whole.getFeaturesCol()).setPredictionCol(whole.getPredictionCol())])


def fit_stopped(train: DataFrame, valid: DataFrame, cols: list[str], label: str = "y", weight: str = "w", max_iter: int = 1000,
                patience: int = 50, **kw) -> PipelineModel:
    """Boosted trees of up to ``max_iter`` rounds, kept up to the best on ``valid`` once ``patience`` more have not bettered it.

    The first rounds of a longer fit are those of a shorter one, so the rounds
    are doubled until the stop is seen.
    """
    scratch_path(train.sparkSession, "fit")  # names the checkpoint folder, where the fit cuts its lineage every few rounds
    train, valid = (_ready(df.select(label, weight, *cols), cols).where(F.col(label).isNotNull() & (F.col(weight) > 0)).persist() for df in (train, valid))
    try:
        n, done = min(2 * patience, max_iter), False
        while not done:
            model = get_model("boosted_trees", cols, label, weight, max_iter=n, **kw).fit(train)
            rows = model.stages[0].transform(valid)
            best, stopped = best_round(model.stages[-1].evaluateEachIteration(rows, "squared"), patience)
            done, n = stopped or n >= max_iter, min(2 * n, max_iter)
        return _first_rounds(model, best)
    finally:
        train.unpersist()
        valid.unpersist()


def fit_eval(name: str, train: DataFrame, valid: DataFrame, cols: list[str], early_stop: bool = False,
             **kw) -> tuple[DataFrame, DataFrame]:
    """(predictions on valid, one-row R2); early stopping watches ``valid`` and is the boosted trees' own."""
    model = fit_stopped(train, valid, cols, **kw) if early_stop else fit(name, train, cols, **kw)
    preds = predict(model, valid, cols)
    return preds, r2(preds)


def ridge_predictions(train: DataFrame, valid: DataFrame, cols: list[str], lam: float = 100.0) -> DataFrame:
    coef = ridge_fit(train, cols, "y", "w", lam)
    return valid.withColumn("pred", linear_score(cols, coef))


def volatility_model(train: DataFrame, cols: list[str], name: str = "boosted_trees", **kw) -> PipelineModel:
    """Model of log1p|y|."""
    return fit(name, train.withColumn("_la", log_abs("y")), cols, label="_la", **kw)


def volatility(model: PipelineModel, df: DataFrame, cols: list[str]) -> DataFrame:
    """Predicted volatility ``vol``, floored at 0.05."""
    return predict(model, df, cols, bound=None).withColumn("vol", vol_from_log("pred")).drop("pred")


def specialists(train: DataFrame, valid: DataFrame, cols: list[str], masks: dict[str, Column],
                name: str = "boosted_trees", **kw) -> DataFrame:
    """One model per regime mask, each predicting all validation rows, as streams."""
    out = None
    for regime, mask in masks.items():
        preds = predict(fit(name, train.where(mask), cols, **kw), valid, cols)
        part = preds.select(F.lit(regime).alias("stream"), *KEYS, "y", "w", "pred")
        out = part if out is None else out.unionByName(part)
    return out


def chain_predictions(df: DataFrame, cols: list[str], labels: list[str], train_lo: int, train_hi: int, valid_lo: int,
                      valid_hi: int, weight: str = "w", name: str = "boosted_trees", **kw) -> DataFrame:
    """(keys, {label}_hat): two-fold out-of-fold on the training range, and a
    refit on all of it for the validation range; never in-sample."""
    mid = (train_lo + train_hi) // 2
    halves = [((train_lo, mid), (mid + 1, train_hi)), ((mid + 1, train_hi), (train_lo, mid)),
              ((train_lo, train_hi), (valid_lo, valid_hi))]
    out = None
    for fit_on, predict_on in halves:
        train = df.where(F.col(DATE).between(*fit_on))
        part = df.where(F.col(DATE).between(*predict_on))
        for label in labels:
            model = fit(name, train, cols, label=label, weight=weight, **kw)
            part = predict(model, part, cols, bound=None).withColumnRenamed("pred", f"{label}_hat")
        part = part.select(*KEYS, *[f"{x}_hat" for x in labels])
        out = part if out is None else out.unionByName(part)
    return out


def responder_table(stage1: DataFrame, mid: DataFrame, tail: DataFrame, cols: list[str], labels: list[str],
                    weight: str = "w", name: str = "boosted_trees", **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two-window chain: models fitted on the first window predict the second
    and the tail.  Returns (responder, r2_mid, r2_tail) and both with ``_hat``."""
    table = None
    for label in labels:
        model = fit(name, stage1, cols, label=label, weight=weight, **kw)
        mid = predict(model, mid, cols, bound=None).withColumnRenamed("pred", f"{label}_hat")
        tail = predict(model, tail, cols, bound=None).withColumnRenamed("pred", f"{label}_hat")
        one = F.lit(1).alias("_one")
        row = (r2(mid, y=label, pred=f"{label}_hat", w=weight, name="r2_mid").select("r2_mid", one)
               .join(r2(tail, y=label, pred=f"{label}_hat", w=weight, name="r2_tail").select("r2_tail", one), "_one")
               .select(F.lit(label).alias("responder"), "r2_mid", "r2_tail"))
        table = row if table is None else table.unionByName(row)
    return table, mid, tail


def ablation(train: DataFrame, valid: DataFrame, variants: dict[str, list[str]], name: str = "boosted_trees",
             **kw) -> DataFrame:
    """(variant, n_features, r2, delta_vs_base) of nested column sets, first = base."""
    rows, base = [], None
    for variant, cols in variants.items():
        _, score = fit_eval(name, train, valid, cols, **kw)
        value = score.first()[0]
        base = value if base is None else base
        rows.append((variant, len(cols), value, value - base))
    return train.sparkSession.createDataFrame(rows, "variant string, n_features int, r2 double, delta_vs_base double")


def fold_importances(folds: DataFrame, cols: list[str], label: str = "y", weight: str = "w",
                     name: str = "boosted_trees", **kw) -> DataFrame:
    """(fold, feature, score): tree importances fitted on each fold's rows."""
    rows = []
    for f in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        model = fit(name, folds.where(F.col("fold") == f), cols, label, weight, **kw)
        rows += [(f, c, v) for c, v in importances(model, cols)]
    return folds.sparkSession.createDataFrame(rows, "fold int, feature string, score double")


def combo_tree_gains(df: DataFrame, candidates: list[tuple[str, str, str]], batch: int = 60, label: str = "y", weight: str = "w",
                     **kw) -> list[tuple[tuple[str, str, str], float]]:
    """Candidates by tree importance, fitted on batches of candidates alone, so
    that known columns do not take their gain."""
    scored = []
    for at in range(0, len(candidates), batch):
        chunk = candidates[at:at + batch]
        cols = [f"_k{i}" for i in range(len(chunk))]
        table = df.select(label, weight, *[combo(*c).alias(k) for c, k in zip(chunk, cols)])
        model = fit("boosted_trees", table, cols, label, weight, **kw)
        scored += [(c, v) for c, (_, v) in zip(chunk, importances(model, cols))]
    return sorted(scored, key=lambda s: (-s[1], s[0]))
