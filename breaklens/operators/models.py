"""Classifiers, tuning and result tables on Spark ML."""

from __future__ import annotations

import random
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.operators import metrics
from breaklens.operators.extratrees import ExtraTrees

SEED = 42
TURNS = 4  # tasks a core in the steps of a search

# Search grids, in Spark parameter names (regParam is the inverse of C).
PARAM_GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"regParam": [100.0, 10.0, 1.0, 0.1, 0.01], "elasticNetParam": [1.0, 0.0]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 2, 4]},
    "gradient_boosting": {
        "maxIter": [50, 100, 200],
        "stepSize": [0.01, 0.1, 0.2],
        "maxDepth": [3, 5, 7],
        "subsamplingRate": [0.8, 0.9, 1.0],
    },
    "xgboost": {
        "maxIter": [50, 100, 200],
        "stepSize": [0.01, 0.1, 0.2],
        "maxDepth": [3, 5, 7],
        "subsamplingRate": [0.8, 0.9, 1.0],
        "featureSubsetStrategy": ["0.8", "0.9", "1.0"],
    },
    "lightgbm": {
        "maxIter": [50, 100, 200],
        "stepSize": [0.01, 0.1, 0.2],
        "maxDepth": [3, 5, 7],
        "subsamplingRate": [0.8, 0.9, 1.0],
        "featureSubsetStrategy": ["0.8", "0.9", "1.0"],
    },
    "svm_linear": {"regParam": [10.0, 1.0, 0.1, 0.01]},
    "decision_tree": {
        "maxDepth": [3, 5, 7, 10],
        "minInstancesPerNode": [1, 2, 4],
        "impurity": ["gini", "entropy"],
    },
    "extra_trees": {"numTrees": [50, 100, 200], "maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 2, 4]},
}


def estimators(n_features: int, features: str = "features", label: str = "label", size: int = 20) -> dict:
    """All classifiers by name; `size` is the number of trees or boosting rounds."""
    io = {"featuresCol": features, "labelCol": label}
    return {
        "logistic_regression": LogisticRegression(maxIter=100, **io),
        "random_forest": RandomForestClassifier(numTrees=size, maxDepth=5, seed=SEED, **io),
        "gradient_boosting": GBTClassifier(maxIter=size, maxDepth=3, stepSize=0.1, seed=SEED, **io),
        "xgboost": GBTClassifier(maxIter=size, maxDepth=4, stepSize=0.3, seed=SEED, **io),
        "lightgbm": GBTClassifier(
            maxIter=size, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED, **io
        ),
        "svm_linear": LinearSVC(maxIter=60, regParam=1.0, **io),
        "naive_bayes": NaiveBayes(modelType="gaussian", **io),
        "decision_tree": DecisionTreeClassifier(maxDepth=5, seed=SEED, **io),
        "extra_trees": ExtraTrees(trees=size, depth=8, seed=SEED, **io),
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, standardization=False, **io),
        "neural_small": MultilayerPerceptronClassifier(layers=[n_features, 16, 2], maxIter=40, seed=SEED, **io),
        "neural_large": MultilayerPerceptronClassifier(layers=[n_features, 32, 16, 2], maxIter=40, seed=SEED, **io),
    }


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


@contextmanager
def cached(df: DataFrame):
    """Keep a frame while several fits read it; it spills to disk and is rebuilt if an executor is lost."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@dataclass
class Fitted:
    """A fitted binary model that adds a score in [0, 1] and a 0/1 prediction under chosen names."""

    name: str
    model: Model

    def score(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        keep = df.columns
        out = self.model.transform(df)
        if "probability" in out.columns:
            p = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
            hit = F.col("prediction").cast("int")
        elif "rawPrediction" in out.columns:
            p = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
            hit = F.col("prediction").cast("int")
        else:
            # regression on labels -1 / +1
            p = F.least(F.greatest((F.col("prediction") + 1) / 2, F.lit(0.0)), F.lit(1.0))
            hit = (F.col("prediction") > 0).cast("int")
        return out.select(*keep, p.alias(prob), hit.alias(pred))


def fit(name: str, estimator, train: DataFrame, target: str, label: str = "label") -> Fitted:
    """Fit on 0/1 targets. Ridge and SVM penalties are per data set: Spark's loss is a mean, so they are divided by the rows.

    Every step of an SVM's or a net's search is a job over all partitions, and each task answers the driver. TURNS
    tasks a core hold the same blocks, so that these answers follow the cores, not the data.
    """
    if isinstance(estimator, (LinearRegression, LinearSVC)):
        estimator = estimator.copy({estimator.regParam: estimator.getRegParam() / max(train.count(), 1)})
    if isinstance(estimator, LinearRegression):
        ready = train.withColumn(label, F.col(target) * 2.0 - 1.0)
    else:
        ready = train.withColumn(label, F.col(target).cast("double"))
    if isinstance(estimator, (LinearSVC, MultilayerPerceptronClassifier)):
        ready = ready.coalesce(TURNS * train.sparkSession.sparkContext.defaultParallelism)
    return Fitted(name, estimator.fit(ready))


def metric_row(scored: DataFrame, target: str, prob: str = "prob", pred: str = "pred") -> dict:
    """Metrics of one scored frame, including ROC AUC."""
    with cached(scored.select(F.col(target).cast("double").alias(target), prob, pred)) as s:
        row = metrics.with_scores(metrics.confusion(s, {"m": (target, pred)})).first()
        auc = BinaryClassificationEvaluator(rawPredictionCol=prob, labelCol=target).evaluate(s)
    return {k: float(row[k]) for k in ("accuracy", "precision", "recall", "f1_score")} | {"auc": float(auc)}


METRIC_SCHEMA = (
    "task string, model string, accuracy double, precision double, recall double, f1_score double, auc double, error string"
)


def metric_frame(spark, rows: list[dict]) -> DataFrame:
    cols = ["task", "model", "accuracy", "precision", "recall", "f1_score", "auc", "error"]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], METRIC_SCHEMA)


def train_single_task(
    train: DataFrame, test: DataFrame, target: str, models: dict, task: str | None = None
) -> tuple[DataFrame, dict[str, Fitted]]:
    """Fit every model on one target; one metric row each, and a failure is a row with its error."""
    rows, fitted = [], {}
    for name, est in models.items():
        row = {"task": task or target, "model": name}
        try:
            fitted[name] = fit(name, est, train, target)
            row |= metric_row(fitted[name].score(test), target)
        except Exception as e:  # noqa: BLE001 - the table must report it
            row["error"] = f"{type(e).__name__}: {str(e)[:200]}"
        rows.append(row)
    return metric_frame(train.sparkSession, rows), fitted


def param_maps(est, grid: dict[str, list]) -> list[dict]:
    builder = ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(est.getParam(p), values)
    return builder.build()


def sample_maps(est, grid: dict[str, list], n_iter: int, seed: int = SEED) -> list[dict]:
    """Seeded sample of the grid without repetition."""
    points = list(product(*grid.values()))
    picked = random.Random(seed).sample(points, min(n_iter, len(points)))
    return [{est.getParam(p): v for p, v in zip(grid, point)} for point in picked]


def tune(est, maps: list[dict], train: DataFrame, target: str, folds: int, fold_col: str, parallelism: int = 4):
    """Cross-validated search on accuracy; returns the fitted search and a table of points."""
    ready = train.withColumn("label", F.col(target).cast("double")).withColumn(fold_col, F.col(fold_col).cast("int"))
    cv = CrossValidator(
        estimator=est,
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label"),
        numFolds=folds,
        foldCol=fold_col,
        parallelism=parallelism,
    ).fit(ready)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda t: t[0].name)), float(a), float(s))
        for m, a, s in zip(maps, cv.avgMetrics, cv.stdMetrics)
    ]
    table = train.sparkSession.createDataFrame(rows, "params string, mean_accuracy double, std_accuracy double")
    return cv, table


def cv_scores(df: DataFrame, target: str, models: dict, folds: int, fold_col: str) -> DataFrame:
    """Accuracy per model and fold."""
    rows = []
    for name, est in models.items():
        for f in range(folds):
            m = fit(name, est, df.filter(F.col(fold_col) != f), target)
            acc = metrics.confusion(m.score(df.filter(F.col(fold_col) == f)), {"m": (target, "pred")}).first()
            n = acc["tp"] + acc["fp"] + acc["fn"] + acc["tn"]
            rows.append((name, f, (acc["tp"] + acc["tn"]) / n))
    return df.sparkSession.createDataFrame(rows, "model string, fold_id int, accuracy double")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.avg("accuracy").alias("mean_cv_score"), F.stddev_pop("accuracy").alias("std_cv_score")
    )


def importances(fitted: Fitted, names: list[str]) -> list[tuple[str, float]]:
    """Feature importances (absolute coefficients for linear models), highest first."""
    m = fitted.model
    values = m.featureImportances if hasattr(m, "featureImportances") else [abs(v) for v in m.coefficients]
    return sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda t: (-t[1], t[0]))


def importance_frame(spark, parts: dict[str, list[tuple[str, float]]]) -> DataFrame:
    rows = [(task, f, v) for task, items in parts.items() for f, v in items]
    return spark.createDataFrame(rows, "task string, feature string, importance double")


def run_single_analysis(train: DataFrame, test: DataFrame, targets: list[str], models: dict, folds: int, fold_col: str):
    """Train all models for each target, compare, and cross-validate the best three."""
    out = None
    spark = train.sparkSession
    for t in targets:
        table, _ = train_single_task(train, test, t, models)
        rows = [r.asDict() for r in table.collect()]
        top = sorted((r for r in rows if r["error"] is None), key=lambda r: (-r["accuracy"], r["model"]))[:3]
        cv = cv_summary(cv_scores(train, t, {r["model"]: models[r["model"]] for r in top}, folds, fold_col))
        part = metric_frame(spark, rows).join(cv, "model", "left")
        out = part if out is None else out.unionByName(part)
    return out
