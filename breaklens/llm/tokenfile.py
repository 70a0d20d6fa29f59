"""Token ids in a byte-aligned variable-length file format.

Ids are replaced by their frequency rank over the whole corpus, so that common ids take one byte. A block
holds whole documents: control bytes (four 2-bit lengths each) apart from the data bytes (1 to 4, least
significant first). Reading expands the control bytes by table lookup. Blocks are rows of a Parquet table
whose files and rows ascend by document id, with the rank table beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from breaklens.llm import bpe
from breaklens.llm import text as T
from breaklens.session import pin, scratch_path

END_ID = 0  # appended to every document
BLOCK_IDS = 1 << 18
KEPT = 1_500_000

# Lengths of the four values behind every control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    kept = np.arange(4) <= code[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers that pack wrote."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


class PieceIds:
    """Ids of distinct pieces by the tokenizers library, kept between blocks."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.places = T.Places()
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and each text's first id."""
        bounds, first = bpe.split_pieces(data, offsets)
        hashes = T.span_hashes(data, bounds[:-1], bounds[1:], 5)
        place = self.places.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            own, at = np.unique(hashes[new], return_index=True)
            if self.places.count and self.places.count + len(own) > KEPT:
                self.forget()
                return self.encode_block(data, offsets)
            raw, at = data.tobytes(), new[at]
            pieces = [raw[a:b].decode() for a, b in zip(bounds[at].tolist(), bounds[at + 1].tolist())]
            made = [e.ids for k in range(0, len(pieces), 20_000) for e in self.tokenizer.encode_batch_fast(pieces[k : k + 20_000], add_special_tokens=False)]
            size = np.array([len(i) for i in made], np.int64)
            self.places.add(own, np.arange(len(own)) + len(self.first) - 1)
            self.ids = np.concatenate([self.ids, np.array([x for i in made for x in i], np.int32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
            place[new] = self.places.find(hashes[new])
        size = self.first[place + 1] - self.first[place]
        ids = self.ids[T.ragged(self.first[place], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[first]


@cache
def _pieces(path: str) -> PieceIds:
    return PieceIds(path)


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for first, data, offsets in T.blocks(batch.column(1), bpe.BLOCK):
            ids, at = _pieces(path).encode_block(data, offsets)
            out = []
            long = max(int(ids.max(initial=0)), end) >> 16 > 0
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                out.append(press.compress(np.append(ids[a:b], np.int32(end)).astype("<u4" if long else "<u2").tobytes()))
            wide = np.full(len(out), long)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), pa.array(wide), pa.array(out, pa.binary())], names=["_id", "wide", "ids"])


def _ids_of(batch: pa.RecordBatch, wide: int, ids: int) -> Iterator[np.ndarray]:
    open_ = zstandard.ZstdDecompressor()
    for w, blob in zip(batch.column(wide).to_pylist(), batch.column(ids).to_pylist()):
        yield np.frombuffer(open_.decompress(blob), "<u4" if w else "<u2")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            own = np.bincount(np.concatenate(list(_ids_of(batch, 0, 1))))
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END_ID, files: int | None = None) -> None:
    """Write the ids of all texts (null: empty), `end` after each, in ascending id order below `path`.

    `path`/blocks has part, number, start (ids before the block in its part), doc_ids, sizes, control and
    data; `path`/ranks has the id behind every rank. Null ids come first; rows that repeat an id stand in
    the order of their ids' bytes.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def tokenise(batches):
        yield from _tokenise(batches, tokenizer, end)

    tokens = pin(base.mapInArrow(tokenise, f"_id {kind}, wide boolean, ids binary"), "token-ids")
    counts = tokens.select("wide", "ids").mapInArrow(_counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # bounded by the vocabulary, not by the data
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame([(k, i) for k, i in enumerate(ranked)], "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank_of)

    def pack_part(batches):
        part, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list = []

        def block():
            nonlocal number, start
            size = [len(x) for x in held]
            control, data = pack(shared.value[np.concatenate(held)])
            row = [part, number, start, names, size, control, data]
            number, start = number + 1, start + sum(size)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=fields)

        waiting = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, ids in zip(batch.column(0).to_pylist(), _ids_of(batch, 1, 2)):
                held.append(ids)
                names.append(name)
                waiting += len(ids)
                if waiting >= BLOCK_IDS:
                    yield block()
                    held, names, waiting = [], [], 0
        if held:
            yield block()

    fields = ["part", "number", "start", "doc_ids", "sizes", "control", "data"]
    n = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order = tokens.repartitionByRange(n, "_id").sortWithinPartitions("_id", "ids")
    schema = f"part int, number int, start bigint, doc_ids array<{kind}>, sizes array<bigint>, control binary, data binary"
    in_order.mapInArrow(pack_part, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document below `path`, decoded from the blocks."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    ids = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]  # the vocabulary's size
    shared = spark.sparkContext.broadcast(np.array(ids, "<u4"))
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    totals = blocks.groupBy("part").agg(F.sum(size).alias("n")).orderBy("part").collect()  # one row per file
    before, run = [], 0
    for r in totals:
        before.append((r["part"], run))
        run += r["n"]
    begins = spark.createDataFrame(before, "part int, before bigint")
    placed = blocks.join(F.broadcast(begins), "part").select((F.col("before") + F.col("start")).alias("start"), "doc_ids", "sizes", "control", "data")

    def unpack_blocks(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                start, names, sizes, control, data = (batch.column(c)[row].as_py() for c in range(5))
                ids = shared.value[unpack(control, data, sum(sizes))]
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e].tobytes()) for s, e in zip(sizes, ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, batch.schema.field(1).type.value_type), pa.array(start + ends - sizes), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["_id", "start", "n_tokens", "ids_crc32"],
                )

    out = placed.mapInArrow(unpack_blocks, f"_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the tokens to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, path, id_col, text_col)
    return read_tokens(docs.sparkSession, path, id_col)
