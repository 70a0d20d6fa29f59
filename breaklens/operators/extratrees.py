"""Extremely randomised trees, all trees grown level by level.

At every open node each drawn feature gets one cut, placed at random between the lowest and the highest value
that the node's rows have there; the cut with the best Gini gain splits the node. A level is two scans for all
trees together: one for the ranges of the drawn features, one that counts rows and positives left of every cut
(which also gives the counts of the last level's nodes). Tasks add up their batches and send sums, so what is
shuffled and gathered follows the size of the trees, not of the data. Rows find
their node by walking the trees grown so far; nothing is stored per row. Draws are hashes of (seed, tree, node,
feature): the same for any partitioning, and portable to other engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.session import pin

# A Mersenne prime and multipliers of the draws.
PRIME = 2147483647
MIX = (48271, 69621, 16807, 39373)
ROWS = 4096


def draw(seed: int, tree: int, node: int, feature: int) -> float:
    """A number in (0, 1) for a cut or a feature's turn."""
    x = (seed * MIX[0] + tree * MIX[1] + node * MIX[2] + feature * MIX[3] + 1) % PRIME
    for m in MIX:
        x = (x * m + 12345) % PRIME
    return (x + 0.5) / PRIME


@dataclass
class Tree:
    """Nodes by heap number (children of i are 2i and 2i + 1): cut, and share of positives."""

    feature: dict[int, int] = field(default_factory=dict)
    cut: dict[int, float] = field(default_factory=dict)
    rows: dict[int, float] = field(default_factory=dict)
    hits: dict[int, float] = field(default_factory=dict)


@dataclass
class Flat:
    """A tree as arrays: feature, cut, left child and heap number of every node, and its levels.

    A leaf is its own left child behind an endless cut, so that a row stays where it has arrived.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    name: np.ndarray
    share: np.ndarray
    levels: int

    @classmethod
    def of(cls, tree: Tree) -> "Flat":
        names, at = [1], 0
        feature, cut, left, share = [], [], [], []
        while at < len(names):
            i = names[at]
            known = i in tree.feature
            feature.append(tree.feature.get(i, 0))
            cut.append(tree.cut.get(i, math.inf))
            left.append(len(names) if known else at)
            share.append(tree.hits.get(i, 0.0) / (tree.rows.get(i) or 1.0))
            if known:
                names += [2 * i, 2 * i + 1]
            at += 1
        # heap numbers outgrow 64 bits in very deep trees only; positions do not
        return cls(np.array(feature), np.array(cut), np.array(left), np.array(names, dtype=np.int64), np.array(share), names[-1].bit_length() - 1)

    def leaves(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Position of the leaf that every row (or every one of `rows`) falls into."""
        values, width = np.ascontiguousarray(x).reshape(-1), x.shape[1]
        first = (np.arange(len(x)) if rows is None else rows) * width
        at = np.zeros(len(first), np.int64)
        for _ in range(self.levels):
            right = values.take(first + self.feature.take(at)) > self.cut.take(at)
            at = self.left.take(at) + right
        return at


# Shares of draws below 1, 2, 3 ... of a Poisson variable with mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


_COARSE = 16  # low bits that the table of counts leaves out


def _counts(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POISSON, (x + 0.5) / PRIME, "right").astype(float)


# counts by the upper bits of the hash, and whether they are not the same for all lower bits
_TABLE = _counts(np.arange(0, PRIME + 1, 1 << _COARSE))
_MIXED = _TABLE != _counts(np.arange(0, PRIME + 1, 1 << _COARSE) + (1 << _COARSE) - 1)


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """x %= PRIME in place for 0 <= x < 2**32, without dividing."""
    np.add(x, 1, out=spare)
    spare >>= 31
    x += spare
    x &= PRIME


def weights(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row counts in a tree, by its key (0 to PRIME - 1)."""
    x = keys + (seed * MIX[0] + tree * MIX[1]) % PRIME
    spare = np.empty_like(x)
    _fold(x, spare)
    for m in MIX:
        x *= m
        x += 12345
        np.right_shift(x, 31, out=spare)
        x &= PRIME
        x += spare
        _fold(x, spare)
        np.right_shift(x, 13, out=spare)
        x ^= spare
        _fold(x, spare)
    np.right_shift(x, _COARSE, out=spare)
    out = _TABLE.take(spare)
    unsure = np.flatnonzero(_MIXED.take(spare))
    out[unsure] = _counts(x[unsure])
    return out


def gain(rows: float, hits: float, left: float, left_hits: float) -> float:
    """Decrease of Gini impurity by a split, per row of the node; 12 digits, so that summation order does not matter."""

    def gini(n: float, p: float) -> float:
        return 2 * p / n * (1 - p / n)

    right, right_hits = rows - left, hits - left_hits
    return round(gini(rows, hits) - left / rows * gini(left, left_hits) - right / rows * gini(right, right_hits), 12)


@dataclass
class ExtraTrees:
    """Estimator over a vector column, with Spark ML's fit and transform shape."""

    trees: int = 100
    depth: int = 5
    least: int = 1  # rows of a leaf
    split: int = 2  # rows of a node that may be split
    features: int | None = None  # drawn per node; the square root of all if not given
    seed: int = 42
    featuresCol: str = "features"
    labelCol: str = "label"
    #: With a whole-number key every tree weighs the rows by its own Poisson draw (a bootstrap), a hash of key and tree.
    bootstrapKey: str | None = None

    def fit(self, df: DataFrame) -> "ExtraTreesModel":
        rows = df.select(vector_to_array(self.featuresCol).alias("x"), F.col(self.labelCol).cast("double").alias("y"))
        width = len(rows.select("x").first()["x"])
        if self.bootstrapKey is not None:
            key = F.pmod(F.col(self.bootstrapKey), F.lit(PRIME)).cast("bigint").alias("key")
            rows = pin(_weighed(df.select(*[vector_to_array(self.featuresCol).alias("x"), F.col(self.labelCol).cast("double").alias("y"), key]), self.trees, self.seed), "tree-rows")
        drawn = self.features or max(1, int(math.sqrt(width)))
        grown = [Tree() for _ in range(self.trees)]
        open_ = {(t, 1) for t in range(self.trees)}
        for level in range(self.depth + 1):
            chosen = {key: sorted(range(width), key=lambda f: draw(self.seed + 1, *key, f))[:drawn] for key in open_}
            if level == self.depth and level:
                break  # the counts left of the cuts were those of the last nodes
            ranges = _ranges(rows, width, self.trees, grown, {key: sorted(chosen[key]) for key in open_})
            for (t, node), (n, p, _, _) in ranges.items():
                grown[t].rows[node], grown[t].hits[node] = n, p
            if level == self.depth:
                break
            cuts = {}
            for (t, node), (n, p, low, high) in ranges.items():
                if n >= self.split and 0 < p < n:
                    spread = [(f, a, b) for f, a, b in zip(sorted(chosen[(t, node)]), low, high) if a < b]
                    if spread:
                        cuts[(t, node)] = [(f, float(a + draw(self.seed, t, node, f) * (b - a))) for f, a, b in spread]
            open_ = set()
            for (t, node), sides in _lefts(rows, width, self.trees, grown, cuts).items():
                n, p = grown[t].rows[node], grown[t].hits[node]
                fit = [(-gain(n, p, a, b), f, c, a, b) for (f, c), (a, b) in zip(cuts[(t, node)], sides) if min(a, n - a) >= max(self.least, 1)]
                if fit:
                    _, grown[t].feature[node], grown[t].cut[node], a, b = min(fit)
                    grown[t].rows |= {2 * node: a, 2 * node + 1: n - a}
                    grown[t].hits |= {2 * node: b, 2 * node + 1: p - b}
                    open_ |= {(t, 2 * node), (t, 2 * node + 1)}
            if not open_:
                break
        return ExtraTreesModel(grown, width, self.featuresCol)


def _weighed(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """Rows with the bytes `w` instead of the key: how often the row counts in every tree. Drawn once, read by all scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(2).to_numpy()
            table = np.empty((len(key), trees), np.uint8)
            for a in range(0, len(key), ROWS):
                for t in range(trees):
                    table[a : a + ROWS, t] = weights(key[a : a + ROWS], seed, t)
            held = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.arange(0, (len(key) + 1) * trees, trees, dtype=np.int32)), pa.py_buffer(table)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], names=["x", "y", "w"])

    return rows.mapInArrow(run, "x array<double>, y double, w binary")


def _scan(rows: DataFrame, width: int, trees: int, grown: list[Tree], wanted: dict[tuple[int, int], list], start: Callable, add: Callable, ends: Callable, schema: str) -> DataFrame:
    """Rows of per-task sums over the rows that fall into the wanted nodes (tree, node).

    start(flat, tree) makes a tree's sums, add(sums, values, first, y, weights, positions) adds a block of rows to them
    (values[first + f] is feature f) and ends(sums, flat) gives (node, ...) of every node with rows.
    """
    flats = {t: Flat.of(grown[t]) for t in sorted({t for t, _ in wanted})}
    inside = {t: np.array([(t, i) in wanted for i in flat.name.tolist()]) for t, flat in flats.items()}
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: start(flat, t) for t, flat in flats.items()}
        for batch in batches:
            x, y = batch.column(0).flatten().to_numpy().reshape(-1, width), batch.column(1).to_numpy()
            if not len(x):
                continue
            all_w = None
            if len(batch.columns) > 2:
                held = batch.column(2)
                at = np.frombuffer(held.buffers()[1], np.int32)[held.offset]
                all_w = np.frombuffer(held.buffers()[2], np.uint8, len(x) * trees, at).reshape(-1, trees).T.copy()
            for t, flat in flats.items():
                rows_at = np.arange(len(x)) if all_w is None else np.flatnonzero(all_w[t])
                at = flat.leaves(x, rows_at)
                if not inside[t].all():
                    here = np.flatnonzero(inside[t].take(at))
                    rows_at, at = rows_at.take(here), at.take(here)
                if len(rows_at):
                    w = np.ones(len(rows_at)) if all_w is None else all_w[t].take(rows_at).astype(float)
                    add(sums[t], x.reshape(-1), rows_at * width, y.take(rows_at), w, at)
        table = [(t, *row) for t, flat in flats.items() for row in ends(sums[t], flat)]
        if table:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in table]) for i in range(len(names))], names=names)

    return rows.mapInArrow(run, schema)


def _ranges(rows: DataFrame, width: int, trees: int, grown: list[Tree], open_: dict[tuple[int, int], list[int]]) -> dict:
    """(tree, node) -> (rows, positives, lows, highs) of the open nodes; lows and highs of their drawn features, in that order."""
    drawn = max((len(f) for f in open_.values()), default=0)

    def start(flat, t):
        feature = np.array([(open_.get((t, i)) or [0] * drawn) for i in flat.name.tolist()], np.int64).reshape(len(flat.name), drawn)
        size = (len(flat.name), drawn)
        return feature, np.zeros(size[0]), np.zeros(size[0]), np.full(size, np.inf), np.full(size, -np.inf)

    def add(sums, values, first, y, w, at):
        feature, n, p, low, high = sums
        order = np.argsort(at.astype(np.uint16) if len(n) < 1 << 16 else at, kind="stable")
        at, first = at.take(order), first.take(order)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        nodes = at[begin]
        n[nodes] += np.add.reduceat(w.take(order), begin)
        p[nodes] += np.add.reduceat((w * y).take(order), begin)
        for j in range(drawn):
            v = values.take(first + feature[:, j].take(at))
            low[nodes, j] = np.minimum(low[nodes, j], np.minimum.reduceat(v, begin))
            high[nodes, j] = np.maximum(high[nodes, j], np.maximum.reduceat(v, begin))

    def ends(sums, flat):
        _, n, p, low, high = sums
        return [(int(flat.name[i]), float(n[i]), float(p[i]), low[i], high[i]) for i in np.flatnonzero(n).tolist()]

    schema = "tree bigint, node bigint, n double, p double, low array<double>, high array<double>"
    parts = _scan(rows, width, trees, grown, open_, start, add, ends, schema)
    least, most = (F.array(*[f(F.col(c)[i]) for i in range(drawn)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high")))
    found = parts.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), least, most)
    return {(r["tree"], r["node"]): (r["n"], r["p"], r["low"], r["high"]) for r in found.collect()}


def _lefts(rows: DataFrame, width: int, trees: int, grown: list[Tree], cuts: dict[tuple[int, int], list[tuple[int, float]]]) -> dict:
    """(tree, node) -> (rows, positives) left of each of the node's cuts."""
    most = max((len(c) for c in cuts.values()), default=0)

    def start(flat, t):
        size = (len(flat.name), most)
        feature, cut = np.zeros(size, np.int64), np.full(size, -np.inf)
        for i, node in enumerate(flat.name.tolist()):
            for j, (f, c) in enumerate(cuts.get((t, node), ())):
                feature[i, j], cut[i, j] = f, c
        return feature, cut, np.zeros(size), np.zeros(size)

    def add(sums, values, first, y, w, at):
        feature, cut, n, p = sums
        hits = w * y
        for j in range(most):
            left = np.flatnonzero(values.take(first + feature[:, j].take(at)) <= cut[:, j].take(at))
            to = at.take(left)
            n[:, j] += np.bincount(to, weights=w.take(left), minlength=len(n))
            p[:, j] += np.bincount(to, weights=hits.take(left), minlength=len(n))

    def ends(sums, flat):
        _, _, n, p = sums
        return [(int(flat.name[i]), j, float(n[i, j]), float(p[i, j])) for i, j in np.argwhere(n).tolist()]

    out = {key: [(0.0, 0.0)] * len(c) for key, c in cuts.items()}
    if cuts:
        parts = _scan(rows, width, trees, grown, cuts, start, add, ends, "tree bigint, node bigint, j bigint, n double, p double")
        for r in parts.groupBy("tree", "node", "j").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect():
            if r["j"] < len(out[(r["tree"], r["node"])]):
                out[(r["tree"], r["node"])][r["j"]] = (r["n"], r["p"])
    return out


@dataclass
class ExtraTreesModel:
    grown: list[Tree]
    width: int
    featuresCol: str

    @property
    def featureImportances(self) -> np.ndarray:
        """Gain of a feature's splits, weighted by the rows they split, averaged over the trees."""
        total = np.zeros(self.width)
        for t in self.grown:
            own = np.zeros(self.width)
            for i, f in t.feature.items():
                own[f] += t.rows[i] * gain(t.rows[i], t.hits[i], t.rows.get(2 * i, 0.0), t.hits.get(2 * i, 0.0))
            total += own / (own.sum() or 1.0)
        return total / (total.sum() or 1.0)

    def with_spread(self, df: DataFrame, mean: str, deviation: str) -> DataFrame:
        """Add mean and (population) deviation of the trees' shares of positives, in one pass for all trees."""
        flats = [Flat.of(t) for t in self.grown]

        def shares(batch: pd.Series) -> pd.DataFrame:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            total, square = np.zeros(len(x)), np.zeros(len(x))
            for flat in flats:
                p = flat.share[flat.leaves(x)]
                total, square = total + p, square + p * p
            m = total / len(flats)
            return pd.DataFrame({"m": m, "s": np.sqrt(np.maximum(square / len(flats) - m * m, 0))})

        found = F.pandas_udf(shares, "m double, s double")(vector_to_array(self.featuresCol))
        out = df.withColumn("_spread", found)
        return out.withColumns({mean: F.col("_spread.m"), deviation: F.col("_spread.s")}).drop("_spread")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `probability` (mean share of positives of the leaves) and `prediction`."""
        out = self.with_spread(df, "_share", "_apart").drop("_apart")
        both = array_to_vector(F.array(1 - F.col("_share"), F.col("_share")))
        return out.withColumns({"probability": both, "prediction": (F.col("_share") > 0.5).cast("double")}).drop("_share")
