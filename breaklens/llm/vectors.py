"""Whole-number vectors in shards: numbering, exact inner products, and the pairing of query blocks with shards."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.session import pin

SHARD = 8192  # rows of a shard, on average
TOGETHER = 8  # blocks of queries that meet a shard in one task
EXACT = 1 << 53


def numbered(rows: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(row, id, label, vec) of the rows that take part: vec holds floor(scale * x) of every component.

    Null vectors and vectors with a null or non-finite component take no part, nor do null labels if a label
    is asked for. `row` tells rows apart that repeat an id; other columns are not read.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = base.where(F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull())
    whole = F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    return pin(base.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("vec")), "vectors")


def dealt(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows with `part`, one of n parts of about `size` rows, and n."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n))), n


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which leaves every inner product as it is."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays in one blob, whole numbers in the narrowest type that holds them."""
    raw = io.BytesIO()
    small = {}
    for name, x in arrays.items():
        if x.dtype == np.int64:
            low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
            x = x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
        small[name] = x
    np.savez(raw, **small)
    return raw.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as arrays:
        return {k: arrays[k].astype(np.int64) if arrays[k].dtype.kind in "iu" else arrays[k] for k in arrays.files}


class Products:
    """Exact inner products of whole-number vectors.

    Products of doubles are exact below 2**53. Larger values are multiplied as Python integers; a result
    beyond 64 bits raises OverflowError.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.most = max((abs(int(values.min())), abs(int(values.max())))) if values.size else 0
        self.fast = values.astype(np.float64) if self.most < EXACT else None
        self.wide = None

    def of(self, queries: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """queries x rows inner products; dimensions that one side lacks are zero."""
        dims = min(queries.shape[1], self.values.shape[1])
        queries = queries[:, :dims]
        most = max(abs(int(queries.min())), abs(int(queries.max()))) if queries.size else 0
        if self.fast is not None and self.most * most * dims < EXACT:
            return (queries.astype(np.float64) @ self.fast[rows, :dims].T).astype(np.int64)
        return np.array(queries.astype(object) @ self.values[rows, :dims].astype(object).T).astype(np.int64)


def ids_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with nulls as the largest number, and where they are null."""
    null = np.asarray(column.is_null())
    return column.fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64), null


def blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(block, blob of row, id, label and vectors) of the queries, and the number of blocks."""
    parts, n = dealt(rows, size)

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        blob = packed(row=group.column("row").to_numpy(), id=ids_of(group.column("id"))[0], label=group.column("label").to_numpy(), vec=matrix(group.column("vec")))
        return pa.table({"block": group.column("part").slice(0, 1), "queries": pa.array([blob], pa.binary())})

    return pin(parts.groupBy("part").applyInArrow(block, "block bigint, queries binary"), "query-blocks"), n


def meet(pairs: DataFrame, number: int, shards: DataFrame, work: Callable[[bytes, list[tuple]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """Rows of `schema` (all bigint): work(shard blob, [block rows]) for all (shard, block ...) rows of `pairs`, TOGETHER blocks of a shard per task.

    `shards` has (shard, data). A group is one shard and about TOGETHER blocks, whatever the input.
    """
    groups = max(1, -(-number // TOGETHER))
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = pairs.withColumn("_some", F.pmod("block", F.lit(groups)))
    right = shards.withColumn("_some", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("_some", F.col("_some").cast("bigint"))
    names = [c for c in pairs.columns if c != "shard"]
    empty = pa.schema([(column.split()[0], pa.int64()) for column in schema.split(", ")])

    def run(own: pa.Table, data: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and data.num_rows:
            found = list(work(data.column("data")[0].as_py(), list(zip(*(own.column(c).to_pylist() for c in names)))))
        return pa.concat_tables(found).combine_chunks() if found else empty.empty_table()

    return (
        left.repartition(tasks, "shard", "_some").groupBy("shard", "_some")
        .cogroup(right.repartition(tasks, "shard", "_some").groupBy("shard", "_some"))
        .applyInArrow(run, schema)
    )
