"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all signature coordinates: the first scatters the shingle hashes over a circle of
2**22 places, the second is a table of values around that circle, and coordinate k reads it shifted by k
places. All coordinates of a shingle are therefore one contiguous slice of the table.

Documents with equal shingle sets are one node. Nodes that agree in one of BANDS bands share a bucket. A
pair of documents at the limit of 0.75 shares no bucket with probability (1 - 0.75**6)**48 < 0.0001, at
0.8 with 5e-7. Candidate pairs pass a 1-bit sketch (six standard deviations below the limit) and are then
confirmed on their full sets.

A bucket never emits all its pairs: each node is first compared with one centre (the member of its buckets whose
own buckets are fullest). Nodes of buckets that still hold several components are then joined by an exact
prefix filter over their full sets, which loses no pair at the limit: shingles whose holders are all of one
component come first in every set, the others from rare to frequent, and two sets of the limit share one of their
first n - ceil(0.75 n) + 1. At their first common shingle what is left of both sets must still reach the overlap
that the limit asks for, so a set with many shingles of its own only meets much smaller ones; sizes are part of the
join key. Of a shingle's holders only those outside its most frequent component meet all others. Texts that merely
stem from one origin therefore do not meet, and neither do members of one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.llm import text as T
from breaklens.llm.graph import components
from breaklens.session import held, pin

ROWS, BANDS, PLACES = 6, 48, 22
COORDINATES = ROWS * BANDS
SKETCH_LONGS = -(-COORDINATES // 64)
LIMIT = 75  # per cent
MOST_BITS_APART = 70  # of COORDINATES; 36 are expected at the limit, with a deviation of 5.6
CLASS = 1.1  # ratio of the sizes that share a class


@cache
def _slices() -> np.ndarray:
    """Row p holds the values of all coordinates of a shingle at place p (a view of one table)."""
    table = np.random.default_rng(7).permutation(1 << PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:COORDINATES]]), COORDINATES)


def signature(distinct: np.ndarray) -> np.ndarray:
    """The COORDINATES minima of a set of shingle hashes."""
    place = (T.mix64(distinct ^ np.uint64(T.MIX_1)) >> np.uint64(64 - PLACES)).astype(np.int64)
    slices = _slices()
    best = slices[place[:2048]].min(axis=0)
    for at in range(2048, len(place), 2048):
        np.minimum(best, slices[place[at : at + 2048]].min(axis=0), out=best)
    return best


def set_digest(distinct: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    one = T.mix64(distinct ^ np.uint64(T.GOLDEN)).sum(dtype=np.uint64)
    two = T.mix64(distinct * np.uint64(T.BASE) + np.uint64(1)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def _distinct_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, data, offsets in T.blocks(column, T.SMALL_BLOCK):
        hashes, at = T.shingles(data, offsets)
        yield first, [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _distinct_sets(batch.column(1)):
            rows = [i for i, s in enumerate(sets) if len(s)]
            sig = np.zeros((len(sets), COORDINATES), np.uint64)
            for i in rows:
                sig[i] = signature(sets[i])
            keys = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                keys = keys * np.uint64(T.BASE) + sig[:, r::ROWS]
            keys = T.mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(T.GOLDEN))
            bits = np.zeros((len(sets), SKETCH_LONGS * 64), np.uint8)
            bits[:, :COORDINATES] = (T.mix64(sig) & np.uint64(1)).astype(np.uint8)
            sketch = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    _lists(keys.view(np.int64)),
                    _lists(sketch),
                ],
                names=["_id", "n", "digest", "bands", "sketch"],
            )


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1), pa.int64()))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the texts whose digest is the one looked for (an id may carry other texts too)."""
    for batch in batches:
        for first, sets in _distinct_sets(batch.column(0)):
            part = batch.slice(first, len(sets))
            same = [set_digest(s) == d for s, d in zip(sets, part.column(2).to_pylist())]
            part = part.filter(pa.array(same))
            kept = [s for s, y in zip(sets, same) if y]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            values = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["node", "items"]
            )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id reachable over links), kept.

    Links join texts whose sets of 5-word shingles have a Jaccard similarity of LIMIT per cent or more. A
    null or wordless text has no shingles and no links. Rows with equal texts share a component, also with
    equal ids. A null id counts only where a component has no other: it is then null and the row is kept.
    Other columns of `docs` are not read, so their names cannot clash.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    rows = pin(
        base.mapInArrow(_describe, f"_id {kind}, n bigint, digest binary, bands array<bigint>, sketch array<bigint>"),
        "minhash-rows",
    )
    nodes = pin(
        rows.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")])
        .withColumn("node", F.monotonically_increasing_id()),
        "minhash-nodes",
    )
    links = _labels(base, nodes)
    placed = nodes.select("digest", "node", "rep").join(links, "node", "left")
    label = F.coalesce("label", "node").alias("label")
    least = placed.where("label IS NOT NULL").groupBy("label").agg(F.min("rep").alias("least"))
    found = placed.select("digest", "rep", label).join(least, "label", "left")
    ids = found.select("digest", F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("_id", "n", "digest").join(ids, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _labels(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have a link."""
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size"))
    members = pin(
        banded.join(shared.where("lo != hi").drop("lo", "hi"), "key").select("key", "node", "n", "size"), "minhash-members"
    )
    mine = members.select("node").distinct()
    wanted = nodes.join(mine, "node").select("node", "digest", "rep")
    full = pin(
        base.join(wanted, F.col("_id").eqNullSafe(F.col("rep")))
        .select("_text", "node", "digest")
        .mapInArrow(_full_sets, "node bigint, items array<bigint>"),
        "minhash-sets",
    )
    traits = nodes.select("node", "n", "sketch")
    labels = components(_verified(_centred(members), traits, full))
    items, heads = _heads(_open(members, labels), full)
    found = _verified(_pairs(heads), traits, full)
    out = components(found.union(labels.select("node", "label")))
    for step in (items, heads):
        step.unpersist()
    return out


def _heads(live: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shingles of the nodes (node, n, label), and those of every node's prefix that another component has as well."""
    items = held(full.join(live, "node").select("node", "n", "label", F.explode("items").alias("item")))
    counts = items.groupBy("item", "label").agg(F.count("*").alias("c"))
    common = counts.groupBy("item").agg(F.sum("c").alias("holders"), F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("most"))
    crossing = items.join(common.where("labels > 1").drop("labels"), "item")
    in_order = crossing.groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("holders", "item", "most"))).alias("shared"))
    own = F.col("n") - F.size("shared")  # shingles that no other component has come first
    prefix = F.col("n") - F.ceil(F.col("n") * LIMIT / 100.0) + 1
    heads = in_order.withColumn("keep", F.greatest(prefix - own, F.lit(0)).cast("int")).where("keep > 0")
    heads = heads.select("node", "n", "label", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), F.col("keep"))).alias("at", "s"))
    left = (F.col("n") - F.col("own") - F.col("at")).alias("left")
    return items, held(heads.select("node", "n", "label", left, "s.item", (F.col("s.most") != F.col("label")).alias("minor")))


def _pairs(heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of unequal labels that may reach the limit; none that reaches it is left out."""
    # o common shingles of n and m reach the limit if (100 + LIMIT) * o >= LIMIT * (n + m)
    least = F.ceil(F.col("n") * LIMIT / 100.0)
    most = F.least(F.col("n"), F.floor((100 + LIMIT) * F.col("left") / LIMIT) - F.col("n"))
    asks = heads.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("left").alias("left_b"), "item", (~F.col("minor")).alias("outsiders"), least.alias("least"), most.alias("most"))
    asks = asks.where("least <= most").withColumn("class", F.explode(F.sequence(_class("least"), _class("most"))))
    both = F.when(F.col("minor"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    meets = heads.select(F.col("node").alias("a"), "n", "label", "left", "item", F.explode(both).alias("outsiders"), _class("n").alias("class"))
    pairs = (
        asks.join(meets, ["item", "class", "outsiders"])
        .where("label != label_b AND n >= least AND n <= most AND (n < n_b OR a < b)")
        .where((100 + LIMIT) * F.least("left", "left_b") >= LIMIT * (F.col("n") + F.col("n_b")))
    )
    return pairs.select("a", "b").distinct()


def _class(c: str) -> Column:
    return F.floor(F.log(CLASS, F.col(c).cast("double")) + 1e-9).cast("int")


def _centred(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of every node b with one centre a: of its buckets' members the one with the fullest buckets.

    The text that a group's copies were made from shares more buckets with them than they do with each other.
    """
    fullness = members.groupBy("node").agg(F.sum("size").alias("fullness"))
    place = F.struct("fullness", F.negate("node").alias("minus"))
    centres = members.join(fullness, "node").groupBy("key").agg(F.max(place).alias("centre"))
    best = members.join(centres, "key").groupBy("node").agg(F.max("centre").alias("centre"))
    return best.select(F.negate("centre.minus").alias("a"), F.col("node").alias("b")).where("a != b")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, n, label) of the nodes in buckets that still hold several labels."""
    marked = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = marked.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h")
    return marked.join(several.select("key"), "key", "left_semi").select("node", "n", "label").distinct()


def _apart(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_LONGS)), F.lit(0))


def _verified(pairs: DataFrame, traits: DataFrame, full: DataFrame) -> DataFrame:
    """Edges (u, v) of the pairs (a, b) whose full sets are similar enough."""
    side = {s: traits.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "sketch")]) for s in "ab"}
    near = (
        pairs.join(side["a"], F.col("a") == F.col("node_a"))
        .join(side["b"], F.col("b") == F.col("node_b"))
        .where(100 * F.least("n_a", "n_b") >= LIMIT * F.greatest("n_a", "n_b"))
        .where(_apart("sketch_a", "sketch_b") <= MOST_BITS_APART)
        .select("a", "b")
    )
    sets = {s: full.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}")) for s in "ab"}
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    return (
        near.join(sets["a"], "a").join(sets["b"], "b").where(100 * both >= LIMIT * union).select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component: the one with the smallest id, and of rows that share it the one with the smallest set digest.

    Rows without words are kept, and so is every component that has null ids only, by one row. Columns of any
    name are passed on; what the stage adds is dropped again.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    base = pin(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("_row")), "minhash-docs")
    marked = near_duplicates(base, "_row", names[text_col])
    rows = base.select("_row", F.col(names[id_col]).alias("_name")).join(marked.withColumnRenamed("component_id", "_group"), "_row")
    best = F.struct(F.col("_name").isNull().alias("none"), "_name", "_row")
    kept = rows.groupBy("_group").agg(F.min(best).alias("best")).select(F.col("best._row").alias("_row"))
    return base.join(kept, "_row", "left_semi").select(*[F.col(n).alias(c) for c, n in names.items()])
