"""Exact top-k by inner product with a KD-tree per shard.

Every shard of about vectors.SHARD rows has a tree of median splits along the widest side, with the tight box of
each node's rows. The inner product of a query with any row of a box is at most the sum over the dimensions
of the larger of q * low and q * high. A block of queries walks a tree best-first: the node with the most to
gain over the kth scores comes next, only the queries whose bound reaches their kth score go on, and leaves
are scored as one product. The kth scores of a first shard per block are passed on to all other shards.
Ties count as reaching, so nothing is lost; the rank is exact on (score, id).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from breaklens.llm import vectors as V
from breaklens.session import pin

LEAF = 256
QUERIES = 256  # queries of a block, on average
LEAST = np.iinfo(np.int64).min
FOUND = "query_row bigint, query_id bigint, id bigint, row bigint, score bigint"


def build(values: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the rows, and the tree's nodes: start and end in that order, left child (0: leaf), low, high.

    The right child follows the left one.
    """
    order = np.arange(len(values))
    start, end, left, low, high = [0], [len(values)], [0], [], []
    node = 0
    while node < len(start):
        a, b = start[node], end[node]
        rows = values[order[a:b]]
        low.append(rows.min(axis=0))
        high.append(rows.max(axis=0))
        if b - a > LEAF:
            middle = (b - a) // 2
            # differences of doubles: long ones may wrap
            wide = int(np.argmax(high[-1].astype(float) - low[-1].astype(float)))
            order[a:b] = order[a:b][np.argpartition(rows[:, wide], middle)]
            left[node] = len(start)
            start += [a, a + middle]
            end += [a + middle, b]
            left += [0, 0]
        node += 1
    return order, {"start": np.array(start), "end": np.array(end), "left": np.array(left), "low": np.array(low), "high": np.array(high)}


class Shard:
    def __init__(self, blob: bytes):
        self.__dict__.update(V.unpacked(blob))
        self.products = V.Products(self.vec)
        self.scored = 0  # leaves scored, times queries

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """nodes x queries: no row of the node's box has a larger inner product (as doubles, rounded up)."""
        dims = min(queries.shape[1], self.low.shape[1])
        q = queries[:, :dims].astype(np.float64)
        low, high = self.low[:, :dims].astype(np.float64), self.high[:, :dims].astype(np.float64)
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
        slack = 1e-12 * (np.abs(high) @ up - np.abs(low) @ down)
        return high @ up + low @ down + slack

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, score) of each query's k best rows but its own, among those with a score of `reach` or more."""
        reach = reach.copy()
        bounds = self.bounds(queries)
        kept = (np.zeros(0, np.int64),) * 3
        held, waiting = [kept], 0
        heap = [(-np.inf, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            some = np.flatnonzero(bounds[node] >= reach)
            if not len(some):
                continue
            if self.left[node]:
                for child in (int(self.left[node]), int(self.left[node]) + 1):
                    gain = bounds[child][some] - reach[some].astype(np.float64)
                    if (gain >= 0).any():
                        heapq.heappush(heap, (-float(gain.max()), child))
                continue
            a, b = int(self.start[node]), int(self.end[node])
            self.scored += len(some)
            score = self.products.of(queries[some], slice(a, b))
            q, at = np.nonzero((score >= reach[some, None]) & (self.row[None, a:b] != own[some, None]))
            held.append((some[q], at + a, score[q, at]))
            waiting += len(q)
            if waiting > 2 * k * len(queries):
                kept = self._best(held, k, reach)
                held, waiting = [kept], 0
        return self._best(held, k, reach)

    def _best(self, held: list[tuple], k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of every query; `reach` rises to their kth score."""
        q, at, score = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((self.row[at], self.id[at], ~score, q))
        q, at, score = q[order], at[order], score[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        last = place == k - 1
        reach[q[last]] = np.maximum(reach[q[last]], score[last])
        keep = place < k
        return q[keep], at[keep], score[keep]


def _shard(group: pa.Table) -> pa.Table:
    group = group.sort_by("row")
    values = V.matrix(group.column("vec"))
    order, tree = build(values)
    ids, null = V.ids_of(group.column("id"))
    blob = V.packed(vec=values[order], row=group.column("row").to_numpy()[order], id=ids[order], null=null[order], **tree)
    return pa.table({"shard": group.column("part").slice(0, 1), "data": pa.array([blob], pa.binary())})


def _visit(k: int):
    def work(data: bytes, rows: list[tuple]) -> Iterator[pa.Table]:
        shard = Shard(data)
        for _, blob, known in rows:
            block = V.unpacked(blob)
            reach = np.full(len(block["row"]), LEAST)
            if known:
                at = np.searchsorted(block["row"], [x["query_row"] for x in known])
                reach[at] = [x["score"] for x in known]
            q, at, score = shard.search(block["vec"], block["row"], k, reach)
            yield pa.table(
                {
                    "query_row": block["row"][q], "query_id": block["id"][q],
                    "id": pa.array(shard.id[at], mask=shard.null[at]), "row": shard.row[at], "score": score,
                }
            )

    return work


def top_k(rows: DataFrame, queries: DataFrame, k: int, block: int = QUERIES, shard: int = V.SHARD) -> DataFrame:
    """query_id, rank, id, score: the k rows of highest inner product of each query, without the query's own row.

    Both frames come from vectors.numbered (queries being some of the rows). Ties go to the smaller id, null
    ids last; fewer rows than k give all. Rows that repeat an id are candidates, and queries, of their own.
    Vectors of unequal length are compared with zeros for what is missing. Empty tables give no rows. A score
    beyond 64 bits raises an error.
    """
    parts, n = V.dealt(rows, shard)
    shards = pin(parts.groupBy("part").applyInArrow(_shard, "shard bigint, data binary"), "trees")
    asked, number = V.blocks(queries, block)
    home = F.pmod("block", F.lit(n))
    none = F.lit(None).cast("array<struct<query_row:bigint,score:bigint>>")
    begin = asked.select(home.alias("shard"), "block", "queries", none.alias("known"))
    first = pin(V.meet(begin, number, shards, _visit(k), FOUND), "first-shard")
    best = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    kth = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query_row", "score")
    of = parts_of(queries, number).join(kth, "query_row").groupBy("block").agg(F.collect_list(F.struct("query_row", "score")).alias("known"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda s: s != home)
    rest = asked.join(of, "block", "left").select(F.explode(others).alias("shard"), "block", "queries", "known")
    found = first.union(V.meet(rest, number, shards, _visit(k), FOUND))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def parts_of(queries: DataFrame, number: int) -> DataFrame:
    """(query_row, block): the dealing of vectors.blocks."""
    return queries.select(F.col("row").alias("query_row"), F.pmod(F.xxhash64("row"), F.lit(number)).alias("block"))


def nearest(rows: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """top_k of the rows whose id is divisible by `every`, against all rows, as query_id, rank, `id_col`, score."""
    all_rows = V.numbered(rows, scale, id_col, vec_col)
    found = top_k(all_rows, all_rows.where(F.col("id") % every == 0), k)
    return found.withColumnRenamed("id", id_col)
