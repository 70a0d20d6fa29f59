"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A block of texts is cut into pieces by the public split pattern (class runs over code points). Every
distinct piece becomes token-position rows; a recursive query joins neighbouring tokens with the merge
table and contracts the leftmost pair of minimum rank of each piece until no pair can merge. Where no
token holding the merged one has a lower rank, all equal pairs of a piece are contracted in one step,
which gives the same result. Decoding joins the ids with their bytes and aggregates them in order.

A worker keeps the ids and bytes of up to KEPT pieces (KEPT_BYTES bytes) between blocks and tasks, in flat
arrays, so a frequent piece is encoded once. Pieces are looked up by a keyed 64-bit hash of their bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from breaklens.llm import text as T

BLOCK = 2 << 20  # bytes of text in a block, unless one text is longer
PIECES = 1 << 20  # bytes of pieces in one recursive query, unless one piece is longer
KEPT, KEPT_BYTES = 700_000, 24 << 20
ONCE = 1 << 18  # pieces of a text that are turned into ids and bytes at once
MEMORY = 128  # MB for DuckDB, and 1 MB for every KB of a piece longer than that
SHORT = 256  # bytes of a piece up to which one contraction a step of pairs of equal tokens is fast enough
LETTER, NUMBER, SPACE, OTHER = range(4)

# Rows are (g = piece << 32 | position, token); every window names that order.
STEPS = """
WITH RECURSIVE state(live, g, tok) AS (
  SELECT true, g, tok FROM start
 UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT g, w, tok, id, {turn} AS turn
     FROM (SELECT g, w, tok, {run} AS run, CASE WHEN lead(w) OVER o = w THEN lead(tok) OVER o END AS nxt
           FROM (SELECT g, g >> 32 AS w, tok{neighbours} FROM state WHERE live WINDOW o AS (ORDER BY g))
           WINDOW o AS (ORDER BY g)) a
     LEFT JOIN merges m ON a.tok = m.l AND a.nxt = m.r),
   least AS (SELECT w, min((id::BIGINT << 32) + (g & 4294967295)) AS k FROM pairs GROUP BY w)
   SELECT best IS NOT NULL, g, CASE WHEN cut THEN best ELSE tok END
   FROM (SELECT g, tok, best, cut, coalesce(lag(cut) OVER (ORDER BY g), false) AS gone
         FROM (SELECT g, tok, k >> 32 AS best,
                      coalesce(id = k >> 32 AND (turn = -1 OR turn = k & 4294967295), false) AS cut
               FROM pairs p LEFT JOIN least ON p.w = least.w))
   WHERE NOT gone))
SELECT g >> 32 AS w, tok FROM state WHERE NOT live ORDER BY g
"""
# turn: -1 contracts every such pair of the piece, a position only the pair that stands there.
ENCODE_SHORT = STEPS.format(run="0", neighbours="", turn="CASE WHEN once OR m.l = m.r THEN g & 4294967295 ELSE -1 END")
# Pairs of equal tokens overlap in a run of that token: every second one is contracted.
ENCODE_LONG = STEPS.format(
    run="i - max(CASE WHEN lag_w IS DISTINCT FROM w OR lag_tok <> tok THEN i END) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING)",
    neighbours=", row_number() OVER o AS i, lag(g >> 32) OVER o AS lag_w, lag(tok) OVER o AS lag_tok",
    turn="CASE WHEN once THEN g & 4294967295 WHEN m.l = m.r AND run % 2 = 1 THEN -2 ELSE -1 END",
)
DECODE = "SELECT seq, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN bytes_of USING (tok) GROUP BY seq ORDER BY seq"


@cache
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    code = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    whole = code.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, whole):
            out[code[m.start() : m.end()]] = kind
    return out


def piece_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the split pattern, over the code points of texts that begin at `texts`.

    A piece is a run of one class, led by one space if there is one. Of a run of white space before other
    text the last character stands apart (a space leads the next piece). An apostrophe that begins a piece
    takes s, t, re, ve, m, ll or d along.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    new_text = np.zeros(n + 1, bool)
    new_text[texts] = True
    new_text[n] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | new_text[1:n]
    space = kind == SPACE
    ends_run = np.ones(n, bool)
    ends_run[:-1] = change[1:]
    single = space & ends_run & ~new_text[1:]  # last white space before other text
    start = change.copy()
    start[single] = True
    led = np.zeros(n, bool)  # first character after a leading space
    led[1:] = (single & (points == 0x20))[:-1]
    start[led] = False
    at = np.flatnonzero(change & ~led & (points == 0x27) & ends_run)
    at = at[at + 1 < n]
    at = at[~new_text[at + 1]]
    one = points[at + 1]
    two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
    two[new_text[np.minimum(at + 2, n)]] = 0
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[at[short | long] + 1] = False
    for hit, k in ((short, 2), (long & ~short, 3)):
        after = at[hit] + k
        after = after[after < n]
        start[after[kind[after] == LETTER]] = True
    return np.flatnonzero(start)


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pieces (one entry more than pieces), and the index of each text's first piece."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    texts = np.searchsorted(lead, offsets[:-1])
    at = piece_starts(points, np.unique(texts[offsets[:-1] < offsets[1:]]))
    bounds = np.append(lead[at], len(data)) if len(at) else np.zeros(1, np.int64)
    return bounds, np.searchsorted(bounds[:-1], offsets)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Coder:
    """Ids of pieces, and bytes of ids, by DuckDB."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        names = {i: b for b, i in ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        left, right, made = (np.array(x, np.int32) for x in (left, right, made))
        length = np.zeros(max(names, default=0) + 1, np.int64)
        length[list(names)] = [len(b) for b in names.values()]
        early = np.union1d(left[(left > made) & (length[left] > 1)], right[(right > made) & (length[right] > 1)])
        self._table("merges", l=left, r=right, id=made, once=np.isin(made, early))
        self._table("bytes_of", tok=np.array(list(names), np.int32), hex=[b.hex() for b in names.values()])
        self.byte_id = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        decimals = [str(i).encode() + b" " for i in range(len(length))]
        self.digits = np.array(decimals, "S").view(np.uint8).reshape(len(decimals), -1)  # an id and a space, then zeros
        self.forget()

    def _table(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self.db.register("given", given)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def forget(self) -> None:
        self.places = T.Places(20)
        self.ids, self.id_first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.raws, self.raw_first = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _run(self, query: str, name: str, rows: pa.Table, longest: int = 0):
        self.db.execute(f"SET memory_limit = '{MEMORY + longest // 1000}MB'")
        self.db.register(name, rows)
        got = self.db.execute(query).fetchnumpy()
        self.db.unregister(name)
        return got

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has; a piece that is a token is its id."""
        known = [self.ranks.get(p, -1) for p in pieces]
        alone = np.array(known, np.int64).reshape(-1)
        length = np.array([len(p) for p in pieces], np.int64)
        count = np.where(alone >= 0, 1, 0)
        found = [(np.flatnonzero(alone >= 0), alone[alone >= 0])]  # pieces and ids
        for query, todo in ((ENCODE_SHORT, length <= SHORT), (ENCODE_LONG, length > SHORT)):
            todo = np.flatnonzero(todo & (alone < 0) & (length > 0))
            turns = np.cumsum(length[todo]) // PIECES
            for part in np.split(todo, np.flatnonzero(np.diff(turns)) + 1):
                if not len(part):
                    continue
                flat = np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)
                w = T.owner(np.concatenate([[0], np.cumsum(length[part])]))
                first = np.cumsum(length[part]) - length[part]
                rows = pa.table({"g": (w << 32) + np.arange(len(flat)) - first[w], "tok": self.byte_id[flat]})
                got = self._run(query, "start", rows, int(length[part].max()))
                own = part[got["w"]]
                found.append((own, got["tok"]))
                count += np.bincount(own, minlength=len(pieces))
        own, ids = (np.concatenate(x) for x in zip(*found))
        return ids[np.argsort(own, kind="stable")].astype(np.int32), count

    def decode_sequences(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of sequences of ids (one after another, `count` each), by an ordered aggregate over the joined token bytes."""
        size = np.zeros(len(count), np.int64)
        raws = [np.zeros(0, np.uint8)]
        ends = np.cumsum(count)
        turns = ends // PIECES
        for part in np.split(np.arange(len(count)), np.flatnonzero(np.diff(turns)) + 1):
            if len(part) and count[part].any():
                a, b = ends[part[0]] - count[part[0]], ends[part[-1]]
                seq = np.repeat(part, count[part]).astype(np.int32)
                got = self._run(DECODE, "ids", pa.table({"seq": seq, "pos": np.arange(a, b), "tok": ids[a:b]}), int(count[part].max()))
                texts = got["hex"].tolist()
                size[got["seq"]] = [len(t) // 2 for t in texts]
                raws.append(np.frombuffer(bytes.fromhex("".join(texts)), np.uint8))
        return np.concatenate(raws), size

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every piece, and each text's first piece."""
        bounds, first = split_pieces(data, offsets)
        hashes = T.span_hashes(data, bounds[:-1], bounds[1:], 5)
        place = self.places.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            own, at = np.unique(hashes[new], return_index=True)
            if self.places.count and (self.places.count + len(own) > KEPT or len(self.raws) > KEPT_BYTES):
                self.forget()
                return self.encode_block(data, offsets)
            if len(own) > KEPT:  # one very long text
                self.places = T.Places(len(own).bit_length() + 1)
            raw, at = data.tobytes(), new[at]
            pieces = [raw[a:b] for a, b in zip(bounds[at].tolist(), bounds[at + 1].tolist())]
            ids, count = self.encode_pieces(pieces)
            raws, size = self.decode_sequences(ids, count)
            if raws.tobytes() != b"".join(pieces):
                raise RuntimeError("the ids of a piece do not give its bytes")
            self.places.add(own, np.arange(len(own)) + len(self.id_first) - 1)
            self.ids = np.concatenate([self.ids, ids])
            self.id_first = np.concatenate([self.id_first, self.id_first[-1] + np.cumsum(count)])
            self.raws = np.concatenate([self.raws, raws])
            self.raw_first = np.concatenate([self.raw_first, self.raw_first[-1] + np.cumsum(size)])
            place[new] = self.places.find(hashes[new])
        return place, first

    def ids_of(self, place: np.ndarray) -> np.ndarray:
        return self.ids[T.ragged(self.id_first[place], self.id_first[place + 1] - self.id_first[place])]

    def raws_of(self, place: np.ndarray) -> np.ndarray:
        return self.raws[T.ragged(self.raw_first[place], self.raw_first[place + 1] - self.raw_first[place])]


@cache
def _coder(path: str) -> Coder:
    return Coder(read_ranks(path))


def _texts(batches: Iterator[pa.RecordBatch], path: str, text_at: int) -> Iterator[tuple[Coder, pa.RecordBatch, list[np.ndarray]]]:
    """(coder, rows, places of each row's pieces), block by block."""
    coder = _coder(path)
    for batch in batches:
        for first, data, offsets in T.blocks(batch.column(text_at), BLOCK):
            place, at = coder.encode_block(data, offsets)
            own = [place[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield coder, batch.slice(first, len(own)), own


def _digest(coder: Coder, place: np.ndarray) -> tuple[int, str, str]:
    """Number of ids, and digests of the decimal ids joined by a space and of the decoded bytes."""
    count, ids_sum, raw_sum = 0, hashlib.sha256(), hashlib.sha256()
    for a in range(0, len(place), ONCE):
        ids = coder.ids_of(place[a : a + ONCE])
        digits = coder.digits[ids]
        text = digits[digits > 0]
        ids_sum.update(text if a + ONCE < len(place) else text[:-1])
        raw_sum.update(coder.raws_of(place[a : a + ONCE]))
        count += len(ids)
    return count, ids_sum.hexdigest(), raw_sum.hexdigest()


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for every row; a null text counts as empty.

    Each text is encoded whole, its ids are decoded again, and the digests are of the decimal ids joined by
    a space and of the decoded bytes. Repeated ids are rows of their own; other columns are not read.
    """

    def run(batches):
        for coder, part, own in _texts(batches, path, 1):
            size, one, two = zip(*[_digest(coder, place) for place in own])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    out = base.mapInArrow(run, f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def _with_field(df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """`docs` with the ids of each text as array<int> in `out_col` (replaced if it exists); null texts have none."""
    base = docs.drop(out_col) if out_col != text_col else docs
    at = base.columns.index(text_col)

    def run(batches):
        for coder, part, own in _texts(batches, path, at):
            columns = [*part.columns, pa.array([coder.ids_of(place) for place in own], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, out_col])

    return base.mapInArrow(run, _with_field(base, out_col, ArrayType(IntegerType())))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`tokens` with the bytes of each id array in `out_col`, by DuckDB; null ids give empty bytes."""
    base = tokens.drop(out_col)
    at = base.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = part.column(at).cast(pa.list_(pa.int32())).fill_null([])
                count = np.asarray(pc.list_value_length(lists)).astype(np.int64)
                raws, size = _coder(path).decode_sequences(lists.flatten().to_numpy(), count)
                ends = np.cumsum(size).tolist()
                got = [raws[e - s : e].tobytes() for e, s in zip(ends, size.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*part.schema.names, out_col])

    return base.mapInArrow(run, _with_field(base, out_col, BinaryType()))
