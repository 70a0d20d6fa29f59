"""Line dedup by pairwise alignment.

Runs of neighbouring lines with at least MIN_WORDS words are hashed; such a hash is rare, unlike that of a
short stock line. Every document that shares one is aligned with the first document that holds it, so a
passage with m holders gives m - 1 pairs and never all of them. The pair's lines are aligned by patience
diff, and aligned common blocks of at least MIN_WORDS words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from breaklens.llm import text as T
from breaklens.session import pin

MIN_WORDS = 50


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (of the words, so that white space does not matter) and word count of every line; each text's first line."""
    starts, ends, _ = T.word_spans(data, offsets)
    l_start, l_end, l_first = T.line_spans(data, offsets)
    at = np.searchsorted(starts, l_start)
    to = np.searchsorted(starts, l_end)
    words = T.span_hashes(data, starts, ends)
    place = np.arange(len(words)) - np.repeat(at, to - at)
    total = np.zeros(len(words) + 1, np.uint64)
    top = int((to - at).max()) + 1 if len(at) else 1
    np.cumsum(words * T.place_keys(21, top)[place], out=total[1:])
    return T.mix64(total[to] - total[at] + (to - at).astype(np.uint64)), to - at, l_first


def runs_of(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shortest run of lines from every line on with `least` words, inside its text, and each text's first run."""
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + least)
    start = np.flatnonzero(end <= np.repeat(first[1:], np.diff(first)))
    end = end[start]
    out = np.zeros(len(start), np.uint64)
    live = np.arange(len(start))
    k = 0
    while len(live):
        out[live] = T.mix64(out[live] * np.uint64(T.BASE) + hashes[start[live] + k])
        k += 1
        live = live[start[live] + k < end[live]]
    return out, np.searchsorted(start, first)


def aligned_blocks(old: list[int], new: list[int], words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Line ranges of `new` to delete: blocks it has in common with `old`, of at least `least` words.

    Patience diff: lines that are unique in both are put in longest increasing order and grown in both
    directions. What it left out (moved blocks, lines that repeat) is aligned again until no block is found.
    """
    gone = [False] * len(new)
    while True:
        rest = [i for i, g in enumerate(gone) if not g and words[i]]
        found = _patience(old, new, rest, words, least) or _seeded(old, new, rest, words, least)
        if not found:
            break
        for a, b in found:
            gone[a:b] = [True] * (b - a)
    out, i = [], 0
    while i < len(new):
        if gone[i]:
            j = i
            while j < len(new) and gone[j]:
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


def _grow(old: list[int], new: list[int], at: int, here: int, free: set[int]) -> tuple[int, int]:
    """The widest common block around old[at] == new[here] over free lines of `new`."""
    a, i = at, here
    while a > 0 and i - 1 in free and old[a - 1] == new[i - 1]:
        a, i = a - 1, i - 1
    b, j = at + 1, here + 1
    while b < len(old) and j in free and old[b] == new[j]:
        b, j = b + 1, j + 1
    return i, j


def _patience(old: list[int], new: list[int], rest: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    in_old, in_new = Counter(old), Counter(new[i] for i in rest)
    where = {h: k for k, h in enumerate(old) if in_old[h] == 1}
    anchors = [(where[new[i]], i) for i in rest if in_new[new[i]] == 1 and new[i] in where]
    tails, last, back = [], [], {}
    for k, (at, _) in enumerate(anchors):
        p = bisect_left(tails, at)
        tails[p : p + 1] = [at]
        last[p : p + 1] = [k]
        back[k] = last[p - 1] if p else None
    chain, k = [], last[-1] if last else None
    while k is not None:
        chain.append(anchors[k])
        k = back[k]
    free, found, upto = set(rest), [], -1
    for at, here in reversed(chain):
        if here >= upto:
            i, j = _grow(old, new, at, here, free)
            upto = j
            if sum(words[i:j]) >= least:
                found.append((i, j))
    return found


def _seeded(old: list[int], new: list[int], rest: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """A common block that starts at any equal lines: for lines that repeat in either text."""
    where: dict[int, list[int]] = {}
    for k, h in enumerate(old):
        where.setdefault(h, []).append(k)
    free = set(rest)
    for here in rest:
        for at in where.get(new[here], ()):
            if at and here - 1 in free and old[at - 1] == new[here - 1]:
                continue  # the same block was tried from its start
            i, j = _grow(old, new, at, here, free)
            if sum(words[i:j]) >= least:
                return [(i, j)]
    return []


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: hashes and word counts of its lines that have words, and its distinct run hashes."""
    for batch in batches:
        for first, data, offsets in T.blocks(batch.column(1), T.SMALL_BLOCK):
            hashes, words, at = line_table(data, offsets)
            filled = words > 0
            hashes, words = hashes[filled], words[filled]
            at = np.concatenate([[0], np.cumsum(filled)])[at]
            runs, r_at = runs_of(hashes, words, at)
            parts = ((hashes.view(np.int64), at), (words.astype(np.int32), at), (runs.view(np.int64), r_at))
            columns = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for v, o in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), *columns], names=["_id", "lines", "words", "runs"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            [h for a, b in aligned_blocks(old, new, words) for h in range(a, b)]
            for old, new, words in zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)])
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["_id", "gone"])


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts without the numbered lines (counted over lines with words); empty lines between stay."""
    for batch in batches:
        gone = batch.column(batch.num_columns - 1)
        columns = [batch.column(i) for i in range(len(schema))]
        if gone.null_count < len(gone):
            hit = gone.is_valid()
            old, drops = columns[text_at].filter(hit).to_pylist(), gone.filter(hit).to_pylist()
            new = [_without(t, set(d)) for t, d in zip(old, drops)]
            columns[text_at] = pc.replace_with_mask(columns[text_at], hit, pa.array(new, columns[text_at].type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _without(text: str, drop: set[int]) -> str:
    out, number = [], -1
    for line in text.split("\n"):
        filled = bool(line.strip(" \t\n\x0b\x0c\r"))
        number += filled
        if not (filled and number in drop):
            out.append(line)
    return "\n".join(out)


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, gone): numbers of the lines to delete, over the document's lines that have words.

    "Earlier" is the smaller id. Rows that repeat an id are not compared with each other, and their
    deletions are those of all its rows; rows with a null id are left alone.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    table = pin(base.mapInArrow(_lines, f"_id {kind}, lines array<bigint>, words array<int>, runs array<bigint>"), "lines")
    runs = table.select("_id", F.explode("runs").alias("run"))
    shared = runs.groupBy("run").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first != last")
    pairs = runs.join(shared.select("run", "first"), "run").where("_id != first").select("first", "_id").distinct()
    later = table.select("_id", F.col("lines").alias("new"), "words")
    earlier = table.select(F.col("_id").alias("first"), F.col("lines").alias("old"))
    both = pairs.join(later, "_id").join(earlier, "first").select("_id", "old", "new", "words")
    found = both.mapInArrow(_align, f"_id {kind}, gone array<int>")
    lines = found.select("_id", F.explode("gone").alias("line")).distinct()
    return lines.groupBy("_id").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the common blocks deleted from the later documents; every row and column stays.

    A text without a deletion is returned as it is (null stays null); a text that is all copied is empty.
    """
    mark = "__gone_lines"
    gone = deletions(docs, id_col, text_col).select(F.col("_id").alias("__gone_id"), F.col("gone").alias(mark))
    schema = to_arrow_schema(docs.schema)
    at = docs.columns.index(text_col)
    marked = docs.join(gone, docs[id_col] == F.col("__gone_id"), "left").drop("__gone_id")

    def cut(batches):
        yield from _cut(batches, at, schema)

    return marked.mapInArrow(cut, docs.schema)
