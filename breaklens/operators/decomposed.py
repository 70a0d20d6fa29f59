"""Cross-validation and grids from sums that add up over folds, without a refit.

Ridge regression needs the Gram matrix of its inputs, Gaussian naive Bayes the count, mean and variance of
every column per class. Both are sums over rows, so one scan per fold-wise sums gives those of every training
part (all folds but one) by adding, every penalty is solved from the same matrix, and one more scan scores
each row with all models of its own fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLD, LABEL, VECTOR = "fold", "label", "x"


def rows_of(df: DataFrame, cols: list[str], target: str, fold_col: str) -> DataFrame:
    """(fold, label, x) rows for the functions below."""
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(F.col(fold_col).cast("int").alias(FOLD), F.col(target).cast("int").alias(LABEL), vec.alias(VECTOR))


def gram_sums(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """fold -> Gram matrix of (1, x, 2 * label - 1), by one scan; columns should be of comparable scale."""
    side = width + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, x = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, width)
            full = np.column_stack([np.ones(len(x)), x, 2.0 * batch.column(1).to_numpy() - 1])
            for f in np.unique(fold).tolist():
                part = full[fold == f]
                total[f] = total.get(f, 0) + part.T @ part
        for f, m in total.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f] * m.size, pa.int32()), "at": pa.array(range(m.size), pa.int32()), "v": pa.array(m.ravel())})

    found = rows.mapInArrow(sums, "fold int, at int, v double").groupBy("fold", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in found.collect():  # folds x (columns + 2)**2 numbers
        out.setdefault(r["fold"], np.zeros(side * side))[r["at"]] = r["v"]
    return {f: m.reshape(side, side) for f, m in out.items()}


def solve_ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients that minimise the squared error on labels -1 / +1 plus alpha * |coefficients|**2."""
    a, b = gram[:-1, :-1].copy(), gram[:-1, -1]
    a[np.arange(1, len(a)), np.arange(1, len(a))] += alpha
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _without(parts: dict[int, np.ndarray], fold: int) -> np.ndarray:
    return sum((m for f, m in parts.items() if f != fold), np.zeros_like(next(iter(parts.values()))))


def _linear(beta: np.ndarray) -> Column:
    terms = F.array(*[F.lit(float(b)) for b in beta[1:]])
    products = F.zip_with(VECTOR, terms, lambda x, b: x * b)
    return F.aggregate(products, F.lit(float(beta[0])), lambda s, v: s + v)


def _fold_hits(rows: DataFrame, hits: dict[str, dict[int, Column]], names: list[str]) -> DataFrame:
    """(point, fold, accuracy): share of right answers of each point's model on the fold it did not see."""
    items = [
        F.struct(F.lit(point).alias(names[0]), (F.coalesce(*[F.when(F.col(FOLD) == f, hit) for f, hit in by_fold.items()]).cast("int") == F.col(LABEL)).alias("right"))
        for point, by_fold in hits.items()
    ]
    long = rows.select(FOLD, F.inline(F.array(*items)))
    return long.groupBy(names[0], FOLD).agg(F.avg(F.col("right").cast("double")).alias("accuracy"))


def ridge_grid(rows: DataFrame, width: int, alphas: list[float]) -> DataFrame:
    """(alpha, fold, accuracy) of every penalty and fold: one scan for the sums, one for the scores."""
    parts = gram_sums(rows, width)
    hits = {a: {f: _linear(solve_ridge(_without(parts, f), a)) > 0 for f in parts} for a in alphas}
    return _fold_hits(rows, hits, ["alpha"])


@dataclass
class Moments:
    """Rows, mean and sum of squared deviations of every column."""

    n: float
    mean: np.ndarray
    square: np.ndarray

    def plus(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if not n:
            return self
        step = other.mean - self.mean
        return Moments(n, self.mean + step * other.n / n, self.square + other.square + step * step * self.n * other.n / n)


def class_moments(rows: DataFrame, width: int) -> dict[int, dict[int, Moments]]:
    """fold -> label -> moments, by one grouped scan."""
    aggs = [F.count("*").alias("n")]
    for i in range(width):
        x = F.col(VECTOR)[i]
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    out: dict[int, dict[int, Moments]] = {}
    for r in rows.groupBy(FOLD, LABEL).agg(*aggs).collect():  # folds x classes rows
        mean, var = (np.array([r[f"{c}{i}"] for i in range(width)]) for c in "mv")
        out.setdefault(r[FOLD], {})[r[LABEL]] = Moments(float(r["n"]), mean, var * r["n"])
    return out


def _training(moments: dict[int, dict[int, Moments]], fold: int) -> dict[int, Moments]:
    """label -> moments of all folds but one."""
    out: dict[int, Moments] = {}
    for f, classes in sorted(moments.items()):
        if f != fold:
            for y, m in sorted(classes.items()):
                out[y] = out[y].plus(m) if y in out else m
    return out


def _score(m: Moments, smoothing: float) -> Column:
    """Log of prior and density of a class, up to a constant."""
    var = m.square / m.n + smoothing
    x = F.transform(VECTOR, lambda v, i: (v - F.get(F.lit(m.mean.tolist()), i)) * (v - F.get(F.lit(m.mean.tolist()), i)) / F.get(F.lit(var.tolist()), i))
    base = float(np.log(m.n) - 0.5 * np.log(2 * np.pi * var).sum())
    return F.aggregate(x, F.lit(base), lambda s, v: s - v * 0.5)


def naive_bayes_folds(rows: DataFrame, width: int, smoothings: list[float] | None = None) -> DataFrame:
    """(smoothing, fold, accuracy) of Gaussian naive Bayes: one scan for the moments, one for the scores.

    `smoothing` times the largest variance of any column is added to every variance. Equal scores give 0;
    a training part with one class gives that class.
    """
    moments = class_moments(rows, width)
    hits: dict[float, dict[int, Column]] = {}
    for s in smoothings or [0.0]:
        hits[s] = {}
        for f in moments:
            classes = _training(moments, f)
            whole = [m for m in classes.values()]
            if len(classes) < 2:
                hits[s][f] = F.lit(next(iter(classes), 0)) == 1
                continue
            both = whole[0].plus(whole[1])
            extra = s * float((both.square / both.n).max())
            hits[s][f] = _score(classes[1], extra) > _score(classes[0], extra)
    return _fold_hits(rows, hits, ["smoothing"])
