"""Phrase collocations from Rabin-Karp fingerprints of every n-gram.

Texts become slices: lower-cased words of one language, a space between the words of a piece and a line
break after each piece, so that an n-gram is a span of bytes. Prefix polynomials at the word borders (two
bases modulo 2**31 - 1) give the fingerprint of any span by one subtraction and one product.

1. Every slice sorts and counts its fingerprints and sends them, packed by range, to the range's reducer with
   the slice as pointer to the occurrences.
2. The reducer adds up the counts of all slices and answers each slice with those of its fingerprints that
   are frequent.
3. The slice looks up its occurrences of these, compares their bytes, and only now spells the phrases out.
   Counts per spelt phrase are exact: a collision costs an extra candidate, which its own count then drops.

Memory in a task is a slice, or the fingerprints of one range (RANGE of them on average, whatever the input).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from breaklens.llm import text as T
from breaklens.session import pin

LONGEST = 3  # words in a phrase
LEAST = 10  # occurrences of a candidate
COVERED = 50  # per cent of a candidate's occurrences inside a longer one that drop it
FIRST = 2000  # rows reported per language
SLICE = 4 << 20  # bytes of a slice, unless one text is longer
RANGE = 1 << 20  # fingerprints in a range
SALTS = 16

# A Mersenne prime and two bases below it, and the bytes of the word rule.
PRIME = (1 << 31) - 1
BASES = (1327217885, 742938285)
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
CHUNK = 1 << 17  # CHUNK * 256 * PRIME stays below 2**63


def _times(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """x * y modulo PRIME, for x and y below 2**31."""
    z = x * y
    z = (z & np.uint64(PRIME)) + (z >> np.uint64(31))
    z = (z & np.uint64(PRIME)) + (z >> np.uint64(31))
    return np.where(z >= PRIME, z - np.uint64(PRIME), z)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, n a power of two."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        out[size : 2 * size] = _times(out[:size], np.uint64(pow(base, size, PRIME)))
        size *= 2
    return out


def _power(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo PRIME: one factor for the low 12 bits of the exponent, one for the rest."""
    most = int(at.max()) >> 12 if len(at) else 0
    low, high = _powers(base, 1 << 12), _powers(pow(base, 1 << 12, PRIME), 1 << max(most.bit_length(), 10))
    return _times(low[at & 0xFFF], high[at >> 12])


def prefixes(data: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """Prefix polynomials sum((data[j] + 1) * base**j for j < i) modulo PRIME, for every i in the ascending `at`."""
    out = np.empty(len(at), np.uint64)
    powers, before = _powers(base, CHUNK), 0
    cuts = np.searchsorted(at, np.arange(0, len(data) + CHUNK, CHUNK), "left")
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        part = data[k * CHUNK : (k + 1) * CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=sums[1:])
        scale = np.uint64(pow(base, k * CHUNK, PRIME))
        out[a:b] = (_times(sums[at[a:b] - k * CHUNK] % np.uint64(PRIME), scale) + np.uint64(before)) % np.uint64(PRIME)
        before = (int(_times(sums[-1:] % np.uint64(PRIME), scale)[0]) + before) % PRIME
    out[cuts[-1] :] = before
    return out


class Grams:
    """Words of a slice and the fingerprints of its n-grams."""

    def __init__(self, data: np.ndarray, lang: str):
        self.data = data
        self.ends = np.flatnonzero((data == 32) | (data == 10))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.joined = data[self.ends] == 32  # the next word follows in the same piece
        self.seed = np.uint64(int.from_bytes(lang.encode("utf-8", "surrogatepass").ljust(8, b"\0")[:8], "little") + 31 * len(lang) & (1 << 64) - 1)
        self.sums = [(prefixes(data, self.starts, b), prefixes(data, self.ends, b), _power(pow(b, -1, PRIME), self.starts)) for b in BASES]

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of all runs of k words inside a piece."""
        n = max(len(self.ends) - k + 1, 0)
        inside = np.ones(n, bool)
        for j in range(k - 1):
            inside &= self.joined[j : j + n]
        at = np.flatnonzero(inside)
        key = np.zeros(len(at), np.uint64)
        for start, end, back in self.sums:
            span = (end[at + k - 1] + np.uint64(PRIME) - start[at]) % np.uint64(PRIME)
            key = (key << np.uint64(31)) | _times(span, back[at])
        return at, T.mix64(T.mix64(key) ^ T.mix64(np.full(1, self.seed)))


_CLASS = np.zeros(256, np.uint8)
_CLASS[list(SPACES)] = 1
_CLASS[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def compact(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lower-cased words of all texts, a space after a word that another follows in its piece, else a line break."""
    data = np.insert(data, offsets[1:], np.uint8(10))
    kind = _CLASS[data]
    word = kind == 0
    begin = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
    if not len(begin):
        return np.zeros(0, np.uint8)
    end = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), begin)
    size = end - begin + 1
    stop = np.cumsum(size)
    out = np.empty(stop[-1], np.uint8)
    out[T.ragged(stop - size, size - 1)] = _LOWER[data[word]]
    out[stop - 1] = np.where(np.append(piece[1:] == piece[:-1], False), 32, 10)
    return out


def _press(array: np.ndarray) -> bytes:
    """Byte planes of the differences, compressed."""
    steps = np.diff(array, prepend=array.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, array.itemsize).T.tobytes())


def _unpress(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).reshape(-1).view(kind), dtype=kind)


def _open(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, lang, words, data) rows from (lang, text) rows."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=1)

    def row(lang: str) -> pa.RecordBatch:
        nonlocal number
        data = np.concatenate(held.pop(lang))
        sizes.pop(lang)
        words = int(((data == 32) | (data == 10)).sum())
        number += 1
        return pa.RecordBatch.from_pydict(
            {"slice": pa.array([number - 1], pa.int64()), "lang": pa.array([lang]), "words": pa.array([words], pa.int64()), "data": pa.array([press.compress(data.tobytes())], pa.binary())}
        )

    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        own = codes.indices.to_numpy()[order]
        for code, lang in enumerate(codes.dictionary.to_pylist()):
            texts = batch.column(1).slice(int(np.searchsorted(own, code)), int((own == code).sum()))
            for _, data, offsets in T.blocks(texts):
                held.setdefault(lang, []).append(compact(data, offsets))
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sizes[lang] >= SLICE:
                    yield row(lang)
        if sum(sizes.values()) >= 4 * SLICE:  # many languages
            for lang in list(held):
                yield row(lang)
    for lang in list(held):
        yield row(lang)


def _counted(batches: Iterator[pa.RecordBatch], longest: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, slice, keys, counts) rows: a slice's distinct fingerprints, ascending, cut by range."""
    for batch in batches:
        for i in range(batch.num_rows):
            grams = Grams(_open(batch.column(2)[i].as_py()), batch.column(1)[i].as_py())
            found = [np.unique(grams.of(k)[1], return_counts=True) for k in range(1, longest + 1)]
            del grams
            keys = np.concatenate([f[0] for f in found])
            counts = np.concatenate([f[1] for f in found])
            del found
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            del order
            cut = np.searchsorted(_range(keys, ranges), np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cut))
            rows = {
                "range": pa.array(some, pa.int64()),
                "slice": pa.array(np.full(len(some), batch.column(0)[i].as_py()), pa.int64()),
                "keys": pa.array([_press(keys[cut[r] : cut[r + 1]]) for r in some.tolist()], pa.binary()),
                "counts": pa.array([_press(counts[cut[r] : cut[r + 1]].astype(np.uint64)) for r in some.tolist()], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(rows)


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) * np.uint64(ranges)) >> np.uint64(31)


def _answers(group: pa.Table, least: int) -> pa.Table:
    """(slice, keys): those fingerprints of each slice that occur `least` times over all slices."""
    parts = [_unpress(b, np.uint64) for b in group.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    own = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    counts = np.concatenate([_unpress(b, np.uint64) for b in group.column("counts").to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, own, counts = keys[order], own[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    often = np.repeat(np.add.reduceat(counts, first) >= least, size)
    keys, own = keys[often], own[often]
    back = np.argsort(own, kind="stable")
    cut = np.searchsorted(own[back], np.arange(len(parts) + 1))
    slices = group.column("slice").to_pylist()
    some = np.flatnonzero(np.diff(cut)).tolist()
    return pa.table(
        {
            "slice": pa.array([slices[s] for s in some], pa.int64()),
            "keys": pa.array([_press(keys[back[cut[s] : cut[s + 1]]]) for s in some], pa.binary()),
        }
    )


def _spelt(own: pa.Table, asked: pa.Table, longest: int) -> pa.Table:
    """(lang, k, phrase, n) of the asked fingerprints of one slice."""
    out: list[pa.Table] = []
    if own.num_rows and asked.num_rows:
        keys = np.sort(np.concatenate([_unpress(b, np.uint64) for b in asked.column("keys").to_pylist()]))
        lang = own.column("lang")[0].as_py()
        grams = Grams(_open(own.column("data")[0].as_py()), lang)
        for k in range(1, longest + 1):
            at, key = grams.of(k)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            out.append(_phrases(grams, at[hit], place[hit], k, lang))
    return pa.concat_tables(out) if out else _phrases(None, np.zeros(0, int), np.zeros(0, int), 0, "")


def _phrases(grams: Grams | None, at: np.ndarray, group: np.ndarray, k: int, lang: str) -> pa.Table:
    """Phrases and counts of the occurrences that begin at words `at`; equal `group` means equal fingerprints.

    Every occurrence is compared with the first of its group; those that differ form groups of their own.
    """
    texts: list[pa.Array] = []
    counts: list[np.ndarray] = []
    while len(at):
        start, size = grams.starts[at], grams.ends[at + k - 1] - grams.starts[at]
        names, first, where = np.unique(group, return_index=True, return_inverse=True)
        lead = first[where]
        same = size == size[lead]
        for a in range(0, len(at), 1 << 17):
            b = a + np.flatnonzero(same[a : a + (1 << 17)])
            spans = grams.data[T.ragged(start[b], size[b])] != grams.data[T.ragged(start[lead[b]], size[b])]
            same[b] = T.per_text(spans, np.concatenate([[0], np.cumsum(size[b])])) == 0
        ends = np.concatenate([[0], np.cumsum(size[first])])
        values = grams.data[T.ragged(start[first], size[first])]
        texts.append(pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)).cast(pa.string()))
        counts.append(np.bincount(where[same], minlength=len(names)))
        at, group = at[~same], group[~same]
    phrase = pa.chunked_array(texts, pa.string())
    n = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.table({"lang": pa.array([lang] * len(n), pa.string()), "k": pa.array(np.full(len(n), k, np.int32)), "phrase": phrase, "n": pa.array(n)})


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases of 1 to `longest` words with n >= `least`, and (lang, words) totals.

    Words are runs of bytes other than space and tab inside pieces, which end at . , ; : ! ? and line breaks;
    A-Z are lower-cased. A null text is empty, a null language is `und`. Rows count as often as they stand in
    `docs`; other columns are not read. An empty table gives no rows.
    """
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    slices = pin(base.mapInArrow(_slices, "slice bigint, lang string, words bigint, data binary"), "phrase-slices")
    totals = slices.groupBy("lang").agg(F.sum("words").alias("words"))
    words = slices.agg(F.sum("words")).first()[0] or 0
    ranges = max(1, -(-words * longest // RANGE))

    def count(batches):
        yield from _counted(batches, longest, ranges)

    def answer(group):
        return _answers(group, least)

    def spell(own, asked):
        return _spelt(own, asked, longest)

    counted = slices.select("slice", "lang", "data").mapInArrow(count, "range bigint, slice bigint, keys binary, counts binary")
    answers = counted.groupBy("range").applyInArrow(answer, "slice bigint, keys binary")
    own = slices.select("slice", "lang", "data").groupBy("slice")
    spelt = own.cogroup(answers.groupBy("slice")).applyInArrow(spell, "lang string, k int, phrase string, n bigint")
    return spelt.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), totals



def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, covered: int = COVERED, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `first` best phrases of 2 to LONGEST words.

    A phrase's score is floor(10**6 * a * a / (l * r)) at its lowest-scoring cut (ties: the earlier cut), in
    decimals of 38 digits. Phrases with `covered` per cent of their occurrences inside one longer candidate are
    dropped. Order: score, then a, both descending, then the phrase's bytes. See frequent_phrases for nulls.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, LONGEST, least)
    phrases = pin(phrases, "phrases")
    candidates = phrases.where("k > 1").withColumnRenamed("n", "a")
    cuts = candidates.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("left"))
    sides = sides.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    # a frequent word begins or ends very many phrases
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    parts = phrases.where(f"k < {LONGEST}").select("lang", F.col("phrase").alias("part"), "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sides = sides.withColumn("salt", salt)
    for side, name in (("left", "l"), ("right", "r")):
        part = parts.select("lang", F.col("part").alias(side), F.col("n").alias(name), "salt")
        sides = sides.join(part, ["lang", side, "salt"])
    wide = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    over = (wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)")).alias("over")
    scored = sides.select("lang", "k", "phrase", "a", "cut", "l", "r", over, (wide["l"] * wide["r"]).alias("under"))
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "k", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("b"))
    best = best.select("lang", "k", "phrase", "b.a", "b.l", "b.r", "b.score")

    inner = F.transform(
        F.filter(
            F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("k") - m), lambda i: F.slice(F.split("phrase", " "), i + 1, m)))),
            lambda w: F.size(w) > 1,
        ),
        lambda w: F.array_join(w, " "),
    )
    longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * a")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = kept.withColumn("share", F.pmod(F.xxhash64("phrase", "a"), F.lit(64)))
    short = shares.withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= first)
    ranked = short.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
