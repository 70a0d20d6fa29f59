"""Hard negatives by Fagin's threshold algorithm.

Every shard of about vectors.SHARD rows keeps one list of its rows per dimension, sorted by component. For an
anchor the lists are read from their high end where its component is positive and from the low end where it
is negative, some ranks at a time (GROWTH times as many in each turn). Rows seen for the first time are scored
by random access. The threshold, the sum over the dimensions of anchor times the value read last, bounds the
score of all rows not seen yet; reading stops once it is strictly below every window's kth score, or below the
window itself. Positives come first, since their scores set the windows of the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from breaklens.llm import vectors as V
from breaklens.session import pin

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
ANCHORS = 64  # anchors of a block, on average
READ, GROWTH = 16, 4
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
KNOWN = "array<struct<anchor_row:bigint,positive_row:bigint,positive_id:bigint,positive_score:bigint>>"


class Lists:
    """Rows of a shard with their sorted list per dimension."""

    def __init__(self, blob: bytes):
        self.__dict__.update(V.unpacked(blob))
        self.products = V.Products(self.vec)
        self.seen_rows = 0

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, scores) of the k best allowed rows with low <= score <= high, for every window (low, high)."""
        n = len(self.vec)
        anchor = anchor[: self.vec.shape[1]]
        dims = np.flatnonzero(anchor)
        if not len(dims):
            dims = np.zeros(1, np.int64)  # all scores are zero: read any one list
        down = anchor[dims] > 0
        seen = np.zeros(n, bool)
        at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, size = 0, READ
        open_ = list(range(len(windows)))
        while depth < n and open_:
            stop = min(n, depth + size)
            lists = np.concatenate([self.order[dims[~down], depth:stop], self.order[dims[down], n - stop : n - depth]]).ravel()
            before = seen.copy()
            seen[lists] = True
            new = np.flatnonzero(seen & ~before & allowed)
            at = np.concatenate([at, new])
            score = np.concatenate([score, self.products.of(anchor[None, :], new)[0]])
            depth, size = stop, (stop - depth) * GROWTH
            if depth < n:
                last = self.vec[np.where(down, self.order[dims, n - depth], self.order[dims, depth - 1]), dims]
                threshold = sum(int(a) * int(b) for a, b in zip(anchor[dims], last))
                open_ = [w for w in open_ if threshold >= windows[w][0] and not self._full(score, windows[w], k, threshold)]
        self.seen_rows += int(seen.sum())
        return [self._best(at, score, w, k) for w in windows]

    @staticmethod
    def _full(score: np.ndarray, window: tuple[int, int], k: int, threshold: int) -> bool:
        """Whether k rows of the window score above the threshold."""
        return int(((score <= window[1]) & (score >= window[0]) & (score > threshold)).sum()) >= k

    def _best(self, at: np.ndarray, score: np.ndarray, window: tuple[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        inside = (score >= window[0]) & (score <= window[1])
        at, score = at[inside], score[inside]
        if len(at) > k:
            enough = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[enough], score[enough]
        order = np.lexsort((self.row[at], self.id[at], ~score))[:k]
        return at[order], score[order]


def _shard(group: pa.Table) -> pa.Table:
    group = group.sort_by("row")
    values = V.matrix(group.column("vec"))
    ids, null = V.ids_of(group.column("id"))
    order = np.argsort(values, axis=0, kind="stable").T
    blob = V.packed(vec=values, row=group.column("row").to_numpy(), id=ids, null=null, label=group.column("label").to_numpy(), order=np.ascontiguousarray(order))
    return pa.table({"shard": group.column("part").slice(0, 1), "data": pa.array([blob], pa.binary())})


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * positive <= 100 * s <= high * positive, within 64 bits."""
    return max(-(-low * positive // 100), LEAST), min(high * positive // 100, MOST)


def _positives(k: int):
    def work(data: bytes, rows: list[tuple]) -> Iterator[pa.Table]:
        shard = Lists(data)
        for _, blob in rows:
            block = V.unpacked(blob)
            for i, row in enumerate(block["row"].tolist()):
                allowed = (shard.label == block["label"][i]) & (shard.row != row)
                at, score = shard.search(block["vec"][i], allowed, [(LEAST, MOST)], k)[0]
                yield pa.table(
                    {
                        "anchor_row": np.full(len(at), row), "anchor_id": np.full(len(at), block["id"][i]),
                        "row": shard.row[at], "id": pa.array(shard.id[at], mask=shard.null[at]), "score": score,
                    }
                )

    return work


def _negatives(k: int, low: int, high: int):
    def work(data: bytes, rows: list[tuple]) -> Iterator[pa.Table]:
        shard = Lists(data)
        for _, blob, known in rows:
            block = V.unpacked(blob)
            of: dict[int, list] = {}
            for p in known:
                of.setdefault(p["anchor_row"], []).append(p)
            for i, row in enumerate(block["row"].tolist()):
                pairs = [(p, window(p["positive_score"], low, high)) for p in of.get(row, [])]
                pairs = [(p, w) for p, w in pairs if w[0] <= w[1]]
                found = shard.search(block["vec"][i], shard.label != block["label"][i], [w for _, w in pairs], k) if pairs else []
                for (p, _), (at, score) in zip(pairs, found):
                    yield pa.table(
                        {
                            "anchor_row": np.full(len(at), row), "anchor_id": np.full(len(at), block["id"][i]),
                            "positive_row": np.full(len(at), p["positive_row"]), "positive_id": pa.array([p["positive_id"]] * len(at), pa.int64()),
                            "positive_score": np.full(len(at), p["positive_score"]),
                            "row": shard.row[at], "id": pa.array(shard.id[at], mask=shard.null[at]), "score": score,
                        }
                    )

    return work


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = ANCHORS, shard: int = V.SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both frames come from vectors.numbered with labels (anchors being some of the rows). An anchor's positives
    are its first other rows of its label by (score descending, id; null ids last); each positive's negatives
    are the first rows of other labels whose score lies between `low` and `high` per cent of the positive's.
    Windows of positives with negative scores are empty. Rows that repeat an id are rows of their own. Vectors
    of unequal length are compared with zeros for what is missing. Empty tables give no rows. A score beyond
    64 bits raises an error.
    """
    parts, n = V.dealt(rows, shard)
    shards = pin(parts.groupBy("part").applyInArrow(_shard, "shard bigint, data binary"), "lists")
    asked, number = V.blocks(anchors, block)
    everywhere = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("shard")
    found = V.meet(asked.select(everywhere, "block", "queries"), number, shards, _positives(positives), "anchor_row bigint, anchor_id bigint, row bigint, id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("id"), "row"]
    chosen = found.withColumn("place", F.row_number().over(W.partitionBy("anchor_row").orderBy(*order))).where(F.col("place") <= positives)
    block_of = anchors.select(F.col("row").alias("anchor_row"), F.pmod(F.xxhash64("row"), F.lit(number)).alias("block"))
    struct = F.struct("anchor_row", F.col("row").alias("positive_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = chosen.join(block_of, "anchor_row").groupBy("block").agg(F.collect_list(struct).alias("known"))  # a block's positives
    pairs = pin(asked.join(known, "block"), "anchor-blocks").select(everywhere, "block", "queries", "known")
    schema = "anchor_row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, positive_score bigint, row bigint, id bigint, score bigint"
    hits = V.meet(pairs, number, shards, _negatives(negatives, low, high), schema)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("anchor_row", "positive_row").orderBy(*order))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(rows: DataFrame, every: int = 100, moved: int = 7, labels: int = 10, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """hard_negatives of the rows whose id is divisible by `every`; ids divisible by `moved` first take the next label."""
    all_rows = V.numbered(rows, scale, id_col, vec_col, label_col)
    next_label = F.when(F.col("id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    all_rows = all_rows.withColumn("label", next_label)
    return hard_negatives(all_rows, all_rows.where(F.col("id") % every == 0))
