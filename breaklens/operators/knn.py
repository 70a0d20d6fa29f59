"""Exact k nearest neighbours over boxes split by coordinates, without comparing all pairs.

Copies are cut to their k smallest keys first: no query can use more. A bounded sample splits the space at
medians into boxes of CELL to 2 * CELL rows, up to WIDEN times as large where there are many. A query is first answered
in its own box, which bounds its k-th distance; then it visits only the other boxes that the bound reaches. A box meets
at most about VISITS queries (as many more as it is larger) in one group, so no popular box becomes one task. In a task the rows of
a box are split again into leaves with tight bounds, and only leaves within the bound are compared. Boxes are large, so a
query has few visits; vectors travel as whole bytes, and gaps are counted in short integers, where that is exact. Only the
sample and the rows and queries of each box reach the driver.

`Index` is an index by pivots and rings of distances, for metrics that know no coordinates; the search here has coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from breaklens.session import pin

CELL = 1 << 14
VISITS = 1 << 15
MANY, WIDEN = 256, 4  # boxes from which on they are larger, and how much at most
LEAF = 128  # rows of a leaf, up to twice as many
ROWS = 1 << 13  # queries compared with a box at once
TURNS = 4  # tasks of a search for each core
BLOCK = 16  # leaves whose common bounds are tried first
CLOSE = 8  # leaves that bound a query's k-th distance
SAMPLE = 16  # rows of the sample for each box
METRICS = ("euclidean", "manhattan")
WEIGHTS = ("uniform", "distance")


def gaps(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared euclidean or manhattan distances of all rows of `a` to all rows of `b`, summed column by column."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        step = a[:, d, None] - b[None, :, d]
        out += step * step if metric == "euclidean" else np.abs(step)
    return out


def lengths(gap: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt(gap) if metric == "euclidean" else gap


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    """The vectors of a column of packed rows, as `kind`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, width), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(kind).reshape(-1, width)


def _work(kind: str, width: int, metric: str) -> str:
    """The narrowest type in which the gaps of vectors of `kind` are exact; float64 where none is."""
    most = {"int8": 127, "int16": 32767}.get(kind)
    if most is None:
        return "float64"
    if metric == "euclidean":  # sizes, products and gaps are whole numbers
        return "float32" if 4 * most * most * width <= 1 << 24 else "float64"
    return next((t for t in ("int16", "int32") if 2 * most * width <= np.iinfo(t).max), "float64")


def _packed(vec: np.ndarray, kind: str) -> pa.Array:
    rows = np.ascontiguousarray(vec.astype(kind))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


class Boxes:
    """A binary tree of boxes: rows below `cut` in `dim` are left, the others right; leaves (dim -1) are numbered."""

    def __init__(self, rows: np.ndarray, least: int):
        """Split at medians while both sides keep `least` rows."""
        width = rows.shape[1]
        self.dim, self.cut, self.left, self.number = [], [], [], []
        low, high = [np.full(width, -np.inf)], [np.full(width, np.inf)]
        todo, self.count = [np.arange(len(rows))], 0
        for node, own in enumerate(todo):  # grows while it is read
            dim, cut = self._split(rows[own], least)
            self.dim.append(dim)
            self.cut.append(cut)
            self.left.append(len(todo) if dim >= 0 else -1)
            self.number.append(self.count if dim < 0 else -1)
            if dim < 0:
                self.count += 1
                continue
            below = rows[own, dim] < cut
            todo += [own[below], own[~below]]
            for side, edge in ((high, 0), (low, 1)):
                for child in (0, 1):
                    bound = side[node].copy()
                    if child == edge:
                        bound[dim] = cut
                    side.append(bound)
        self.dim, self.cut, self.left, self.number = (np.array(x) for x in (self.dim, self.cut, self.left, self.number))
        self.low, self.high = np.array(low), np.array(high)

    @staticmethod
    def _split(rows: np.ndarray, least: int) -> tuple[int, float]:
        n = len(rows)
        if n >= 2 * least:
            for dim in np.argsort(-rows.std(axis=0), kind="stable"):
                values = np.sort(rows[:, dim])
                middle = values[n // 2]
                above = values[min(n - 1, np.searchsorted(values, middle, "right"))]
                cut = min((middle, above), key=lambda c: abs(2 * np.searchsorted(values, c) - n))
                if least <= np.searchsorted(values, cut) <= n - least:
                    return int(dim), float(cut)
        return -1, 0.0

    def home(self, vec: np.ndarray) -> np.ndarray:
        """The number of the leaf of every row."""
        node = np.zeros(len(vec), np.int64)
        while (inner := np.flatnonzero(self.dim[node] >= 0)).size:
            at = node[inner]
            node[inner] = self.left[at] + (vec[inner, self.dim[at]] >= self.cut[at])
        return self.number[node]

    def reached(self, vec: np.ndarray, reach: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf number) of all leaves with a point that is no farther than `reach`, a gap as of `gaps`."""
        row, node = np.arange(len(vec)), np.zeros(len(vec), np.int64)
        found = []
        while len(row):
            leaf = self.dim[node] < 0
            found.append((row[leaf], self.number[node[leaf]]))
            row, node = np.repeat(row[~leaf], 2), (self.left[node[~leaf]][:, None] + np.array([0, 1])).reshape(-1)
            gap = np.zeros(len(row))
            for d in range(vec.shape[1]):
                gap += _outside(vec[row, d], self.low[node, d], self.high[node, d], metric)
            row, node = row[gap <= reach[row]], node[gap <= reach[row]]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (row, node)


def _outside(x: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """One column's part of the gap between rows and boxes: never above that of a row in the box, rounding included."""
    step = np.maximum(np.maximum(low - x, x - high), 0)
    return step * step if metric == "euclidean" else step


@dataclass
class Index:
    """Pivots, and for each its least and largest distance, ring width, number of rings and rows."""

    metric: str
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    width: np.ndarray
    rings: np.ndarray
    rows: np.ndarray

    def ring(self, pivot: np.ndarray, dist: np.ndarray) -> np.ndarray:
        at = np.floor((dist - self.low[pivot]) / self.width[pivot])
        return np.clip(at, 0, self.rings[pivot] - 1).astype(np.int64)

    def visits(self, vec: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, pivot, ring) of every ring that may hold a row within `reach` of a query (inf: not known yet)."""
        dist = lengths(gaps(vec, self.pivots, self.metric), self.metric)
        enough = self.rows >= k
        if enough.any():
            reach = np.minimum(reach, (dist + self.high)[:, enough].min(axis=1))
        slack = 1e-9 * (1 + dist.max(axis=1, initial=0.0))  # rounding may only add visits
        reach = reach + slack
        nearest = dist.min(axis=1)
        open_ = (dist - nearest[:, None] <= 2 * reach[:, None]) & (dist - reach[:, None] <= self.high) & (dist + reach[:, None] >= self.low)
        query, pivot = np.nonzero(open_ & (self.rows > 0))
        d, r = dist[query, pivot], reach[query]
        first = self.ring(pivot, d - r)
        last = self.ring(pivot, d + r)
        size = last - first + 1
        ends = np.cumsum(size)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        return np.repeat(query, size), np.repeat(pivot, size), np.repeat(first, size) + step

    def home(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, pivot, ring) of the ring of each query under its nearest pivot, and of the two beside it."""
        dist = lengths(gaps(vec, self.pivots, self.metric), self.metric)
        dist[:, self.rows == 0] = np.inf
        pivot = dist.argmin(axis=1)
        own = self.ring(pivot, dist[np.arange(len(vec)), pivot])
        query, ring = np.repeat(np.arange(len(vec)), 3), (own[:, None] + np.array([-1, 0, 1])).reshape(-1)
        pivot = np.repeat(pivot, 3)
        inside = (ring >= 0) & (ring < self.rings[pivot])
        return query[inside], pivot[inside], ring[inside]


def farthest(sample: np.ndarray, n: int, metric: str) -> np.ndarray:
    """At most n rows of the sample, each farthest from those before it."""
    chosen = [0]
    near = gaps(sample, sample[:1], metric)[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, gaps(sample, sample[chosen[-1:]], metric)[:, 0])
    return sample[chosen]


class Leaves:
    """Rows of a box by leaf, with tight bounds, in the type `work` of `_work`."""

    def __init__(self, rows: np.ndarray, metric: str, work: str = "float64"):
        tree = Boxes(rows.astype(float), LEAF)
        own = tree.home(rows)
        self.metric, self.work, self.order = metric, work, np.argsort(own, kind="stable")
        self.rows = rows[self.order].astype(work)
        self.starts = np.searchsorted(own[self.order], np.arange(tree.count + 1))
        self.low = np.minimum.reduceat(self.rows, self.starts[:-1], axis=0)
        self.high = np.maximum.reduceat(self.rows, self.starts[:-1], axis=0)

    def _apart(self, vec: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Gaps of all bounds to all queries."""
        apart = np.zeros((len(low), len(vec)), self.work)
        for d in range(vec.shape[1]):
            apart += _outside(vec[None, :, d], low[:, d, None], high[:, d, None], self.metric)
        return apart

    def _reached(self, vec: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, query) of the leaves within `reach`, by leaf; neighbouring leaves have neighbouring numbers."""
        first = np.arange(0, len(self.low), BLOCK)
        near = self._apart(vec, np.minimum.reduceat(self.low, first), np.maximum.reduceat(self.high, first)) <= reach
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at, some in zip(first, near):
            some = np.flatnonzero(some)
            if len(some):
                leaf, query = _places(self._apart(vec[some], self.low[at : at + BLOCK], self.high[at : at + BLOCK]) <= reach[some])
                found.append((leaf + at, some[query]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _met(self, leaf: np.ndarray) -> Iterator[tuple[slice, int, int]]:
        """(positions, first row, last row) of every leaf among ascending leaves."""
        ends = np.searchsorted(leaf, np.arange(len(self.low) + 1))
        for at in np.flatnonzero(np.diff(ends)):
            yield slice(ends[at], ends[at + 1]), self.starts[at], self.starts[at + 1]

    def nearest(self, vec: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, gap) of up to k nearest rows within `reach` (a gap; inf: not known), ties to the first row."""
        vec, unknown = vec.astype(self.work), np.flatnonzero(np.isinf(reach))
        most = np.inf if np.dtype(self.work).kind == "f" else np.iinfo(self.work).max
        reach = np.minimum(reach, most).astype(self.work)
        if len(unknown):
            apart = self._apart(vec[unknown], self.low, self.high)
            near = min(CLOSE, len(apart))
            close = np.argpartition(apart.T, near - 1, axis=1)[:, :near].reshape(-1)
            by = np.argsort(close, kind="stable")
            query, kth = np.repeat(unknown, near)[by], np.full((len(by), k), most, self.work)
            for some, first, last in self._met(close[by]):
                gap = _gaps(vec[query[some]], self.rows[first:last], self.metric)
                width = min(k, gap.shape[1])
                kth[by[some], :width] = np.partition(gap, width - 1, axis=1)[:, :width]
            reach[unknown] = np.partition(kth.reshape(len(unknown), -1), k - 1, axis=1)[:, k - 1]
        leaf, query = _places(apart <= reach) if 0 < len(vec) == len(unknown) else self._reached(vec, reach)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.work))]
        for some, first, last in self._met(leaf):
            own = query[some]
            q, p, gap = _within(vec[own], self.rows[first:last], reach[own], self.metric)
            found.append((own[q], self.order[p + first], gap))
        q, p, gap = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((p, gap, q))
        q, p, gap = q[by], p[by], gap[by]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], p[first], gap[first].astype(float)


def _places(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, which takes longer."""
    return np.divmod(np.flatnonzero(where), max(1, where.shape[1]))


def _gaps(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """`gaps` in the type of the rows."""
    out, step = np.zeros((len(a), len(b)), a.dtype), np.empty((len(a), len(b)), a.dtype)
    for x, y in zip(a.T, np.ascontiguousarray(b.T)):
        np.subtract(x[:, None], y[None, :], out=step)
        out += np.multiply(step, step, out=step) if metric == "euclidean" else np.abs(step, out=step)
    return out


def _within(a: np.ndarray, b: np.ndarray, reach: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, gap) of the pairs whose gap is at most `reach`.

    Euclidean ones come from one matrix product. For doubles, whose product is rounded, it finds the pairs that may be
    within it, rounding allowed for, and only these get their exact gap. Whole numbers in float32 are not rounded.
    """
    if metric == "manhattan":
        gap = _gaps(b, a, metric)
        p, q = _places(gap <= reach)
        return q, p, gap[p, q]
    size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    gap = (-2 * b) @ a.T
    gap += size_a
    gap += size_b[:, None]
    if a.dtype == np.float32:
        p, q = _places(gap <= reach)
        return q, p, gap[p, q]
    p, q = _places(gap <= reach + 1e-9 * (1 + reach + size_a.max() + size_b.max()))
    gap = np.zeros(len(q))
    for d in range(a.shape[1]):
        step = a[q, d] - b[p, d]
        gap += step * step
    near = gap <= reach[q]
    return q[near], p[near], gap[near]


def widened(n: int) -> float:
    """How many times larger than CELL the boxes of n rows are: 1 up to MANY boxes, WIDEN at most."""
    return min(max(1.0, n / CELL / MANY), WIDEN)


def fit_boxes(points: DataFrame, n: int, width: int, kind: str, k: int) -> Boxes:
    """Boxes of n rows (key, vec) from a sample of about SAMPLE rows for each box, drawn by hash."""
    share = min(1.0, SAMPLE * max(1, np.ceil(n / CELL / widened(n))) / max(n, 1))
    draw = F.pmod(F.xxhash64("vec", "key"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    sample = points.where(draw).select("vec").collect()
    rows = np.array([np.frombuffer(r["vec"], kind) for r in sample], float).reshape(-1, width)
    return Boxes(rows[np.lexsort(rows.T)], max(SAMPLE, k))


def _search(
    boxes: Boxes, points: DataFrame, queries: DataFrame, most: int, width: int, kind: str, k: int, metric: str, first: bool
) -> DataFrame:
    """(query, near) of queries (query, reach): up to k nearest rows (gap, key, label) of a visited box.

    The first search visits each query's own box, the second all other boxes within `reach`. A group has about `most` queries.
    """
    work = _work(kind, width, metric)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vec = _matrix(part.column("query"), width, kind)
                own = boxes.home(vec)
                q, box = np.arange(len(vec)), own
                if not first:
                    q, box = boxes.reached(vec, part.column("reach").to_numpy(), metric)
                    q, box = q[box != own[q]], box[box != own[q]]
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(q)).columns, pa.array(box.astype(np.int64))], names=[*part.schema.names, "box"])

    visits = queries.select("query", "reach", F.pmod(F.xxhash64("query"), F.lit(1 << 30)).alias("draw"))
    visits = visits.mapInArrow(visit, "query binary, reach double, draw bigint, box bigint")
    visits = visits if first else pin(visits, "knn-visits")
    groups = np.zeros(boxes.count, np.int64)
    for r in visits.groupBy("box").agg(F.ceil(F.count("*") / most).alias("n")).collect():
        groups[r["box"]] = r["n"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = batch.column("box").to_numpy()
            group = pa.array(batch.column("draw").to_numpy() % groups[box])
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("reach"), batch.column("box"), group], names=["query", "reach", "box", "group"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = boxes.home(_matrix(batch.column("vec"), width, kind))
            many = groups[box]
            row = np.repeat(np.arange(len(box)), many)
            group = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(box[row].astype(np.int64)), pa.array(group)], names=[*batch.schema.names, "box", "group"])

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending"), ("label", "ascending")], null_placement="at_start"))
            leaves = Leaves(_matrix(rows.column("vec"), width, kind), metric, work)
            vec, reach = _matrix(asked.column("query"), width, kind), asked.column("reach").to_numpy()
            for at in range(0, len(vec), ROWS):
                q, p, gap = leaves.nearest(vec[at : at + ROWS], reach[at : at + ROWS], k)
                found.append((q + at, p, gap))
        q, p, gap = (np.concatenate(x) for x in zip(*found))
        own, start = np.unique(q, return_index=True)
        near = [pa.array(gap), *(rows.column(c).take(pa.array(p)).combine_chunks() for c in ("key", "label"))]
        near = pa.StructArray.from_arrays(near, names=["gap", "key", "label"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(q)).astype(np.int32)), near)
        return pa.table({"query": asked.column("query").take(pa.array(own)), "near": lists})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    left = visits.mapInArrow(deal, "query binary, reach double, box bigint, group bigint")
    right = points.select("key", "label", "vec").mapInArrow(place, f"key {kinds['key']}, label {kinds['label']}, vec binary, box bigint, group bigint")
    tasks = max(1, min(int(groups.sum()), TURNS * points.sparkSession.sparkContext.defaultParallelism))
    left, right = (df.repartition(tasks, "box", "group") for df in (left, right))
    met = left.groupBy("box", "group").cogroup(right.groupBy("box", "group"))
    return met.applyInArrow(meet, f"query binary, near array<struct<gap:double,key:{kinds['key']},label:{kinds['label']}>>")


def _kind(frames: list[DataFrame], cols: list[str]) -> str:
    """The narrowest type that holds every value of the columns exactly."""
    values = [F.col(c).cast("double") for c in cols]
    largest = F.greatest(*[F.abs(v) for v in values], F.lit(0.0))
    broken = F.lit(False)
    for v in values:
        broken = broken | (v != F.floor(v))
    most = 0.0
    for df in frames:
        r = df.agg(F.max(largest).alias("most"), F.max(broken).alias("broken")).first()
        most = max(most, math.inf if r["broken"] or math.isnan(r["most"] or 0.0) else r["most"] or 0.0)
    return "int8" if most <= 127 else "int16" if most <= 32767 else "float64"


def _pack(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """Other columns of `df`, and `vec`: the columns as the bytes of one row. Rows without all of them are left out."""
    rest = [c for c in df.columns if c not in cols]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = np.stack([batch.column(c).to_numpy() for c in cols], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), _packed(vec, kind)], names=[*rest, "vec"])

    whole = df.na.drop(subset=cols)
    return whole.mapInArrow(pack, ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in rest), "vec binary"]))


def _doubles(cols: list[str]) -> list[Column]:
    return [(F.col(c).cast("double") + F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(cols)]


def _nearest(train: DataFrame, test: DataFrame, key: str, cols: list[str], label: str, k: int, metric: str) -> tuple[DataFrame, DataFrame]:
    """(query, place, key, label, distance), and the test rows (key, label, query); a query is a packed vector."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    width, names = len(cols), [f"_{i}" for i in range(len(cols))]
    train, test = (df.select(F.col(key).alias("key"), F.col(label).alias("label"), *_doubles(cols)) for df in (train, test))
    kind = _kind([train, test], names)
    copies = W.partitionBy("vec").orderBy("key", "label")
    points = _pack(train, names, kind).withColumn("i", F.row_number().over(copies)).where(F.col("i") <= k).drop("i")
    points = pin(points, "knn-train")
    n = points.count()
    boxes, most = fit_boxes(points, n, width, kind, k), int(VISITS * widened(n))
    rows = _pack(test, names, kind).withColumnRenamed("vec", "query")
    asked = pin(rows.select("query").distinct(), "knn-queries")
    unknown = F.lit(float("inf"))
    own = pin(_search(boxes, points, asked.withColumn("reach", unknown), most, width, kind, k, metric, first=True), "knn-own")
    found = own
    if boxes.count > 1:  # then every box holds k rows
        bounded = own.select("query", F.col("near")[k - 1]["gap"].alias("reach"))
        found = own.unionByName(_search(boxes, points, bounded, most, width, kind, k, metric, first=False))
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    found = found.groupBy("query").agg(near.alias("near")).select("query", F.posexplode("near").alias("place", "n"))
    distance = F.sqrt("n.gap") if metric == "euclidean" else F.col("n.gap")
    return found.select("query", (F.col("place") + 1).alias("place"), F.col("n.key").alias("key"), F.col("n.label").alias("label"), distance.alias("distance")), rows


def _vote(found: DataFrame, weights: str) -> DataFrame:
    """(query, share, pred) of neighbours that weigh 1 or 1 / distance; those at distance 0 outvote all others."""
    if weights not in WEIGHTS:
        raise ValueError(f"weights must be one of {WEIGHTS}")
    plain = F.avg("label")
    near = F.sum(F.when(F.col("distance") > 0, F.col("label") / F.col("distance"))) / F.sum(F.when(F.col("distance") > 0, 1 / F.col("distance")))
    same = F.avg(F.when(F.col("distance") == 0, F.col("label")))
    share = plain if weights == "uniform" else F.coalesce(same, near)
    return found.groupBy("query").agg(share.alias("share")).withColumn("pred", (F.col("share") > 0.5).cast("int"))


def neighbours(train: DataFrame, test: DataFrame, key: str, cols: list[str], label: str, k: int = 5, metric: str = "euclidean") -> DataFrame:
    """One row per test row and neighbour: `key`, place, near_key, near_label, distance; ties go to the smaller key.

    Columns must be numbers without nulls. Fewer training rows than k give all of them. Test rows that repeat
    a key have neighbours of their own.
    """
    found, rows = _nearest(train, test, key, cols, label, k, metric)
    rows = rows.select(F.col("key").alias(key), "query")
    named = found.select("query", "place", F.col("key").alias("near_key"), F.col("label").alias("near_label"), "distance")
    return rows.join(named, "query").drop("query")


def predict(
    train: DataFrame, test: DataFrame, key: str, cols: list[str], label: str, k: int = 5, metric: str = "euclidean", weights: str = "uniform"
) -> DataFrame:
    """Key, share of positive labels among the k nearest (ties by key) and majority for each test row."""
    found, rows = _nearest(train, test, key, cols, label, k, metric)
    return rows.select(F.col("key").alias(key), "query").join(_vote(found, weights), "query").drop("query")


def option_scores(
    train: DataFrame, test: DataFrame, key: str, cols: list[str], label: str, ks: list[int], metrics: tuple[str, ...] = METRICS, weights: tuple[str, ...] = WEIGHTS
) -> DataFrame:
    """metric, weights, k, rows, hits of every combination of options: one search per metric, for the largest k."""
    out = None
    for metric in metrics:
        found, rows = _nearest(train, test, key, cols, label, max(ks), metric)
        found = pin(found, "knn-found")
        truth = rows.groupBy("query", F.col("label").alias("y")).agg(F.count("*").alias("n"))
        truth = pin(truth, "knn-truth")
        for w in weights:
            for k in ks:
                hits = truth.join(_vote(found.where(F.col("place") <= k), w), "query")
                part = hits.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
                part = part.select(F.lit(metric).alias("metric"), F.lit(w).alias("weights"), F.lit(k).alias("k"), "rows", "hits")
                out = part if out is None else out.unionByName(part)
    return out
