"""Homomorphic multiset hash of documents.

A fingerprint is the sum of wide vectors hashed from a text's paragraphs (\\n-split pieces): DENSE lanes modulo
2**64, the number of sentences modulo 2**32, and LANES lanes modulo 2**16 to which every sentence of the paragraph
adds plus or minus one. All of it adds up: the order of paragraphs does not matter, and a paragraph is inserted
or deleted by adding or subtracting its own fingerprint. Equal texts have equal fingerprints; texts whose
paragraphs are permuted do too. The sum over the signed lanes of the product of two fingerprints estimates the
number of common sentences, with a deviation of about one part in the square root of LANES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from breaklens.llm import text as T
from breaklens.scale import value_buckets

DENSE, LANES = 4, 384
BYTES = 8 * DENSE + 4 + 2 * LANES
ONCE = 8192  # sentences that are spread over the lanes at once


def _sentences(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the sentences of all lines: cut behind every full stop, without a leading space, none empty."""
    stops = np.flatnonzero(data == 46) + 1
    line = np.searchsorted(start, stops, "left") - 1
    stops = stops[(line >= 0) & (stops < end[np.maximum(line, 0)])]
    starts = np.sort(np.concatenate([start[start < end], stops]))
    ends = np.sort(np.concatenate([end[start < end], stops]))
    starts = starts + (data[starts] == 32)
    return starts[starts < ends], ends[starts < ends]


def _signs(units: np.ndarray) -> np.ndarray:
    """units x LANES matrix of plus and minus one."""
    words = [T.mix64(units + np.uint64((k + 1) * T.GOLDEN % 2**64)) for k in range(LANES // 64)]
    bits = np.unpackbits(np.stack(words, axis=1).astype("<u8").view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BYTES bytes per text: dense lanes, number of sentences, signed lanes (all little-endian)."""
    texts = len(offsets) - 1
    start, end, first = T.line_spans(data, offsets)
    hashes = T.span_hashes(data, start, end, 11)
    dense = np.zeros((texts, DENSE), np.uint64)
    for k in range(DENSE):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(T.mix64(hashes + np.uint64((k + 1) * T.GOLDEN % 2**64)), out=total[1:])
        dense[:, k] = total[first[1:]] - total[first[:-1]]
    start, end = _sentences(data, start, end)
    units = T.span_hashes(data, start, end, 12)
    own = np.searchsorted(offsets, start, "right") - 1
    lanes = np.zeros((texts, LANES), np.int32)
    for at in range(0, len(units), ONCE):
        part = own[at : at + ONCE]
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        lanes[part[heads]] += np.add.reduceat(_signs(units[at : at + ONCE]), heads, axis=0, dtype=np.int32)
    count = np.bincount(own, minlength=texts).astype("<u4")
    parts = (dense.astype("<u8").view(np.uint8), count.view(np.uint8), lanes.astype("<i2").view(np.uint8))
    return np.concatenate([p.reshape(texts, -1) for p in parts], axis=1)


_PARTS = (("<u8", DENSE), ("<u4", 1), ("<i2", LANES))


def _lanes(prints: np.ndarray) -> list[np.ndarray]:
    """Dense lanes, number of sentences and signed lanes of rows of fingerprints."""
    out, at = [], 0
    for kind, n in _PARTS:
        to = at + np.dtype(kind).itemsize * n
        out.append(np.ascontiguousarray(prints[:, at:to]).view(kind))
        at = to
    return out


def combine(one: np.ndarray, two: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of the multiset sums (sign 1) or differences (sign -1) of two sets of rows."""
    return np.concatenate([(a + b if sign > 0 else a - b).view(np.uint8) for a, b in zip(_lanes(one), _lanes(two))], axis=1)


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Estimated cosine of the sentence counts, 0 to 1; 1 for equal fingerprints.

    For texts without repeated sentences it is the common sentences over the geometric mean of both numbers.
    """
    (_, n, a), (_, m, b) = _lanes(one), _lanes(two)
    a, b = a.astype(np.float64), b.astype(np.float64)
    # lanes of a text have the square sum of its sentence counts as their mean square
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    near = np.where(size > 0, (a * b).sum(axis=1) / np.where(size > 0, size, 1), 0.0)
    same = (one == two).all(axis=1)
    return np.where(same, 1.0, np.clip(near, 0, 1))


def _of_texts(texts: list[str]) -> np.ndarray:
    made = [fingerprints(d, o) for _, d, o in T.blocks(pa.array(texts, pa.large_string()))]
    return np.concatenate(made) if made else np.zeros((0, BYTES), np.uint8)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, copy, order): every own row with the row behind it; copies only follow."""
    ahead = None  # (part, copy, id, text, fingerprint) that waits for its follower
    for batch in batches:
        for k, data, offsets in T.blocks(batch.column(3)):
            piece = batch.slice(k, len(offsets) - 1)
            parts, copies, texts = (piece.column(c).to_pylist() for c in (0, 1, 3))
            prints = fingerprints(data, offsets)
            rows = list(zip(parts, copies, range(len(parts)), [t or "" for t in texts], prints))
            out, followers, ids = [], [], []
            for row in rows:
                if ahead and not ahead[1] and ahead[0] == row[0]:
                    out.append(ahead)
                    followers.append(row)
                    ids.append(ahead[5])
                ahead = (*row, piece.column(2)[row[2]])
            if out:
                yield _result(out, followers, pa.array([i.as_py() for i in ids], batch.schema.field(2).type))


def _result(own: list, followers: list, ids: pa.Array) -> pa.RecordBatch:
    changed = [edited(a[3], b[3]) for a, b in zip(own, followers)]
    one, two, new = np.stack([a[4] for a in own]), np.stack([b[4] for b in followers]), _of_texts(changed)
    digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    columns = {
        "_id": ids,
        "n_chars": pa.array([len(a[3]) for a in own], pa.int64()),
        "edited_sha256": pa.array(digest),
        "fingerprint": pa.array([r.tobytes().hex() for r in one]),
        "edited_fingerprint": pa.array([r.tobytes().hex() for r in new]),
        "near_edited": pa.array(likeness(one, new)),
        "near_next": pa.array(likeness(one, two)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the next in descending id order, the first one after the last. Null ids come last;
    they, and equal ids, stand in the order of a hash of their texts. Null texts are empty; ids are numbers.
    The texts are shuffled once, into ranges of the order (null ids into as many ranges of their hash); each
    range also gets a copy of the next range's first row, from a table with one row per range.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType
    if not isinstance(kind, NumericType):
        raise ValueError(f"ids must be numbers, not {kind.simpleString()}")
    n = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = value_buckets(base, "_id", n, "_bucket").withColumn("_tie", F.xxhash64("_text"))
    of_null = F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * n)
    part = F.when(F.col("_id").isNull(), n + of_null).otherwise(n - F.col("_bucket")).cast("bigint")
    placed = cut.select(part.alias("part"), F.struct(F.col("_id").isNull().alias("none"), (-F.col("_id")).alias("minus"), "_tie").alias("place"), "_id", "_text")
    heads = placed.groupBy("part").agg(F.min("place").alias("head"))
    ranges = W.orderBy("part")  # one row per range
    around = F.coalesce(F.lag("part").over(ranges), F.max("part").over(ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select("part", "head", around.alias("before"))
    # at most 2 * n + 1 rows: the ranges
    firsts = placed.join(F.broadcast(heads), "part").where(F.col("place").eqNullSafe(F.col("head")))
    dealt = placed.withColumn("copy", F.lit(False)).select("part", "copy", "place", "_id", "_text")
    dealt = dealt.union(firsts.select(F.col("before"), F.lit(True), "place", "_id", "_text"))
    dealt = dealt.repartition(2 * n + 1, "part").sortWithinPartitions("part", "copy", "place", "_text")
    schema = f"_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "copy", "_id", "_text").mapInArrow(_compare, schema).withColumnRenamed("_id", id_col)
