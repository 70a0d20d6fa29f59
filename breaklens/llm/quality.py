"""Quality rules: base counts, and a calibrated logistic regression on hashed word and character n-grams.

The regression is fitted by Spark ML on at most FIT_ROWS labelled rows, drawn by a hash of their id; a
fifth of them is held out of the fit and calibrates the margin to a probability (Platt scaling). Scoring
covers all rows in Arrow batches against the fixed threshold MIN_PROBABILITY.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from breaklens.llm import text as T
from breaklens.session import pin

FIT_ROWS = 12_000  # bound of the labelled rows that fit the classifier
BITS = 14  # buckets of each kind of n-gram: 2**BITS
NGRAM = 4  # bytes of a character n-gram
MIN_PROBABILITY = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SIZE = 1 << BITS
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every text of a block."""
    starts, ends, first = T.word_spans(data, offsets)
    texts = len(offsets) - 1
    space = ~T._WORD_BYTE[data]
    words = T.span_hashes(data, starts, ends)
    # lines with a word, repeated within their text
    l_start, l_end, l_first = T.line_spans(data, offsets)
    filled = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_text = T.owner(l_first)[filled]
    lines = T.span_hashes(data, l_start[filled], l_end[filled])
    n_dup = np.bincount(l_text, minlength=texts) - _per_text_distinct(lines, l_text, texts)
    # words in windows that occur twice or more in their text
    valid = T.run_valid(first, WINDOW)
    at = np.flatnonzero(valid)
    runs = T.run_hashes(words, WINDOW)[valid]
    keys = _with_text(runs, T.owner(first)[at])
    by = np.argsort(keys, kind="stable")
    same = keys[by][1:] == keys[by][:-1]
    twice = np.zeros(len(keys), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + WINDOW, -1)
    return {
        "n_words": np.diff(first),
        "word_chars": T.code_points(data, offsets) - T.per_text(space, offsets),
        "n_symbols": T.per_text(_SYMBOL[data], offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": T.per_text(np.cumsum(steps[:-1]) > 0, first),
        "_words": words,
        "_first": first,
    }


def _with_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return T.mix64(hashes + text.astype(np.uint64) * np.uint64(T.GOLDEN))


def _per_text_distinct(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    by = np.lexsort((hashes, text))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (text[by][1:] != text[by][:-1])
    return np.bincount(text[by][new], minlength=texts)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def gram_buckets(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, buckets of all byte n-grams, and each text's first n-gram."""
    codes = T.byte_codes(3)[data]
    length = np.diff(offsets)
    many = np.maximum(length - NGRAM + 1, 0)
    at = np.concatenate([[0], np.cumsum(many)])
    runs = np.zeros(max(0, len(data) - NGRAM + 1), np.uint64)
    for k in range(NGRAM):
        runs = runs * np.uint64(T.BASE) + codes[k : k + len(runs)]
    grams = (runs[T.run_valid(offsets, NGRAM)] * np.uint64(T.MIX_1)) >> np.uint64(64 - BITS)
    return words >> np.uint64(64 - BITS), grams + np.uint64(SIZE), at


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Relative frequencies of the buckets of each text, as the struct of a sparse vector."""
    for batch in batches:
        for first, data, offsets in T.blocks(batch.column(1), T.SMALL_BLOCK):
            starts, ends, at = T.word_spans(data, offsets)
            words = T.span_hashes(data, starts, ends)
            w, g, g_at = gram_buckets(data, offsets, words)
            index, value = [], []
            for i in range(len(offsets) - 1):
                row_i, row_v = [], []
                for part in (w[at[i] : at[i + 1]], g[g_at[i] : g_at[i + 1]]):
                    if len(part):
                        own, count = np.unique(part, return_counts=True)
                        row_i.append(own.astype(np.int32))
                        row_v.append(count / len(part))
                index.append(np.concatenate([np.zeros(0, np.int32), *row_i]))
                value.append(np.concatenate([np.zeros(0), *row_v]))
            n = len(index)
            parts = [np.zeros(n, np.int8), np.full(n, 2 * SIZE, np.int32)]
            parts = [*map(pa.array, parts), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))]
            vector = pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(2).slice(first, n), vector], names=["label", "held", "features"])


class QualityModel:
    """Weights of the buckets, intercept and the two calibration numbers."""

    def __init__(self, weights: np.ndarray, intercept: float, scale: float, shift: float):
        self.weights, self.intercept, self.scale, self.shift = weights, intercept, scale, shift

    def probability(self, data: np.ndarray, offsets: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        w, g, g_at = gram_buckets(data, offsets, words)
        total = np.full(len(offsets) - 1, self.intercept)
        for part, at in ((w, first), (g, g_at)):
            total += T.per_text(self.weights[part], at) / np.maximum(np.diff(at), 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * total + self.shift, -50, 50)))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on labelled rows; without both classes the model accepts every text.

    Repeated labels of an id count once (the lower one); null labels and labels of absent ids are ignored.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min((F.col("quality") > 0).cast("double")).alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = 0.9 * fit_rows / n if n > fit_rows else 1.0
    picked = known.withColumn("draw", draw).where(F.col("draw") < share).withColumn("held", F.col("draw") < 0.2 * share)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # at most about fit_rows ids of 20 bytes are broadcast
    rows = texts.join(F.broadcast(picked.drop("draw")), "_id").select("label", "_text", "held")
    # read back as vectors, so that no Python runs beside the fit
    vectors = StructType([StructField("label", DoubleType()), StructField("held", BooleanType()), StructField("features", VectorUDT())])
    sparse = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    made = pin(rows.mapInArrow(_features, f"label double, held boolean, features {sparse}"), "quality-fit", vectors)
    parts = {held: made.where(F.col("held") == held) for held in (False, True)}
    counts = {(r["held"], r["label"]): r["n"] for r in made.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    if not all((False, y) in counts for y in (0.0, 1.0)):
        return QualityModel(np.zeros(2 * SIZE), 0.0, 0.0, 50.0)
    train = parts[False].persist(StorageLevel.MEMORY_AND_DISK)
    fit = LogisticRegression(maxIter=40, regParam=0.01, maxBlockSizeInMB=4.0).fit(train)
    scale, shift = 1.0, 0.0
    if all((True, y) in counts for y in (0.0, 1.0)):
        margin = fit.transform(parts[True]).select("label", vector_to_array("rawPrediction")[1].alias("m"))
        platt = LogisticRegression(maxIter=50, regParam=0.001).fit(margin.select("label", array_to_vector(F.array("m")).alias("features")))
        scale, shift = float(platt.coefficients[0]), float(platt.intercept)
    train.unpersist()
    return QualityModel(fit.coefficients.toArray(), float(fit.intercept), scale, shift)


def _judge(batches: Iterator[pa.RecordBatch], text_at: int, model: QualityModel) -> Iterator[tuple[pa.RecordBatch, dict]]:
    for batch in batches:
        for first, data, offsets in T.blocks(batch.column(text_at), T.SMALL_BLOCK):
            found = base_counts(data, offsets)
            found["base_failed"] = base_failed(found)
            found["quality"] = model.probability(data, offsets, found["_words"], found["_first"])
            found["kept"] = ~found["base_failed"] & (found["quality"] >= MIN_PROBABILITY)
            yield batch.slice(first, len(offsets) - 1), found


def quality_rules(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_failed, quality (probability) and kept for every row.

    Null and empty texts have no words: all counts are 0 and base_failed holds. Rows that repeat an id stay
    rows of their own; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    share = base.sparkSession.sparkContext.broadcast(model)  # 2 * 2**BITS weights: 256 kB

    def score(batches):
        for part, found in _judge(batches, 1, share.value):
            columns = [pa.array(found[c], pa.int64()) for c in BASE_COLUMNS]
            columns += [pa.array(found["base_failed"]), pa.array(found["quality"]), pa.array(found["kept"])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *columns], names=["_id", *BASE_COLUMNS, "base_failed", "quality", "kept"]
            )

    kind = base.schema["_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in BASE_COLUMNS)
    out = base.mapInArrow(score, f"_id {kind}, {counts}, base_failed boolean, quality double, kept boolean")
    return out.withColumnRenamed("_id", id_col)


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches):
        for part, found in _judge(batches, at, share.value):
            yield part.filter(pa.array(found["kept"]))

    return docs.mapInArrow(keep, docs.schema)
