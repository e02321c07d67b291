"""Extensions: fitting weights to ratings, choosing by cross-validation, the gate for adopting a fit, retention."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..plans.spec import RULES, ScoringSpec
from .evaluation import ORDINAL, accuracy, ordinal
from .features import feature_vector


def training_rows(judged: DataFrame) -> DataFrame:
    """vector, target from a table with the features and a label (green, yellow, red); rows without a label are left out."""
    return judged.where(F.col("label").isin(list(ORDINAL))).select(array_to_vector(feature_vector()).alias("vector"), ordinal(F.col("label")).cast("double").alias("target"))


def fit_multinomial(judged: DataFrame, regularization: float = 0.05, iterations: int = 100):
    """L2 multinomial logistic model of the three classes on the 27 features."""
    estimator = LogisticRegression(featuresCol="vector", labelCol="target", family="multinomial", regParam=regularization, elasticNetParam=0.0, maxIter=iterations)
    return estimator.fit(training_rows(judged))


def cross_validated(judged: DataFrame, grid: tuple[float, ...] = (0.01, 0.05, 0.2), folds: int = 5, seed: int = 1):
    """The best of a grid of regularizations by k-fold accuracy: (model, mean accuracies)."""
    estimator = LogisticRegression(featuresCol="vector", labelCol="target", family="multinomial", elasticNetParam=0.0)
    candidates = ParamGridBuilder().addGrid(estimator.regParam, list(grid)).build()
    judge = MulticlassClassificationEvaluator(labelCol="target", predictionCol="prediction", metricName="accuracy")
    fitted = CrossValidator(estimator=estimator, estimatorParamMaps=candidates, evaluator=judge, numFolds=folds, seed=seed).fit(training_rows(judged))
    return fitted.bestModel, list(fitted.avgMetrics)


# ---- all folds in one pass -------------------------------------------------------------------------------


def fold_of(id_col: str, folds: int) -> Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds).cast("int")


def fold_rows(judged: DataFrame, fold: Column, positive: str = "red") -> DataFrame:
    """vector (the features and a 1 for the bias), target (1: the label is `positive`), fold (a number from 0 on, such as fold_of()): rows with a label."""
    vector = F.concat(feature_vector(), F.array(F.lit(1.0))).alias("vector")
    return judged.where(F.col("label").isin(list(ORDINAL))).select(vector, (F.col("label") == positive).cast("double").alias("target"), fold.cast("int").alias("fold"))


def _sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Gradient and curvature of each fold's model over the rows outside its fold, as one row a fold and task."""
    folds, size = weights.shape
    gradient, curve, n = np.zeros((folds, size)), np.zeros((folds, size, size)), np.zeros(folds)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
        y, fold = batch.column("target").to_numpy(), batch.column("fold").to_numpy()
        for k in range(folds):
            own, target = x[fold != k], y[fold != k]
            p = 1 / (1 + np.exp(-np.clip(own @ weights[k], -40, 40)))
            gradient[k] += own.T @ (p - target)
            curve[k] += (own * (p * (1 - p))[:, None]).T @ own
            n[k] += len(own)
    columns = [pa.array(range(folds), pa.int32()), pa.array(n), pa.array(list(gradient), pa.list_(pa.float64())), pa.array(list(curve.reshape(folds, -1)), pa.list_(pa.float64()))]
    yield pa.RecordBatch.from_arrays(columns, ["model", "n", "gradient", "curve"])


def fold_sums(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """model, n, gradient (28), curve (28 x 28): what a Newton step of each fold's model needs, from one pass over the rows.

    weights: a row for each fold. A task gives one row a fold; these are added up by place, with map-side combine.
    """
    parts = rows.mapInArrow(partial(_sums, weights=weights), "model int, n double, gradient array<double>, curve array<double>")
    long = parts.select("model", "n", F.posexplode(F.concat("gradient", "curve")).alias("at", "x")).groupBy("model", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    size = weights.shape[1]
    both = long.groupBy("model").agg(F.first("n").alias("n"), every.alias("all"))
    return both.select("model", "n", F.slice("all", 1, size).alias("gradient"), F.slice("all", size + 1, size * size).alias("curve"))


def fit_folds(rows: DataFrame, folds: int, ridge: float = 0.05, steps: int = 30, close: float = 1e-8) -> np.ndarray:
    """Weights (fold, 28) of a logistic model with an L2 ridge (not on the bias) for each fold, fitted to all other folds.

    Newton's method: each step is one job that sums up all folds at once; the driver solves 28 equations a
    fold. A fold without rows outside it keeps zeros. rows: from fold_rows(), cached or cut by the caller.
    """
    size = len(L.KEYS) + 1
    weights, hold = np.zeros((folds, size)), np.diag([ridge] * (size - 1) + [1e-9])
    for _ in range(steps):
        moved = 0.0
        for r in fold_sums(rows, weights).collect():
            if r.n:
                step = np.linalg.solve(np.array(r.curve).reshape(size, size) / r.n + hold, np.array(r.gradient) / r.n + hold @ weights[r.model])
                weights[r.model] -= step
                moved = max(moved, float(np.abs(step).max()))
        if moved < close:
            break
    return weights


def out_of_fold(judged: DataFrame, weights: np.ndarray, id_col: str, fold: Column) -> DataFrame:
    """id, fold, label, probability of the positive class by the model that has not seen the row."""
    table = F.array(*(F.array(*map(F.lit, map(float, w))) for w in weights))
    vector = F.concat(feature_vector(), F.array(F.lit(1.0)))
    z = F.aggregate(F.zip_with(vector, F.get(table, fold.cast("int")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return judged.where(F.col("label").isin(list(ORDINAL))).select(F.col(id_col), fold.cast("int").alias("fold"), "label", (1 / (1 + F.exp(-z))).alias("probability"))


def as_spec(model, base: ScoringSpec = RULES, version: str = "fitted-1") -> ScoringSpec:
    """A specification whose weights are the model's pull towards red over green."""
    pull = model.coefficientMatrix.toArray()[2] - model.coefficientMatrix.toArray()[0]
    return replace(base, version=version, weights={k: float(w) for k, w in zip(L.KEYS, pull, strict=True)})


def wrong_signs(spec: ScoringSpec) -> list[str]:
    """Features whose weight contradicts what they measure."""
    return [f[0] for f in L.FEATURES if (f[2] == "slop" and spec.weights.get(f[0], 0) < 0) or (f[2] == "quality" and spec.weights.get(f[0], 0) > 0)]


def may_adopt(held_out: DataFrame, spec: ScoringSpec, current: ScoringSpec = RULES) -> bool:
    """Whether a spec may replace the current one: no inversions, no worse on held-out rows (features, label), no wrong signs."""
    from .scoring import classify

    new, old = (accuracy(classify(held_out, s)).first() for s in (spec, current))
    return new.inversions == 0 and new.exact >= old.exact and not wrong_signs(spec)


def retained(contributions: DataFrame, now: str, months: int = 12, versions: tuple[str, ...] = (L.SCORER_VERSION,), most: int = 1000) -> DataFrame:
    """Rows (install, at, scorerVersion, ...) younger than `months`, of a live version, the newest `most` of each install.

    The cap is the feature. Each install's rows are ranked in one window; an install is one reader.
    """
    from pyspark.sql import Window

    fresh = contributions.where((F.to_timestamp("at") >= F.add_months(F.to_timestamp(F.lit(now)), -months)) & F.col("scorerVersion").isin(list(versions)))
    place = F.row_number().over(Window.partitionBy("install").orderBy(F.to_timestamp("at").desc(), F.xxhash64(*contributions.columns)))
    return fresh.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
