"""Corpus pipeline: quality rules, line dedup, near-duplicates, source mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and reads it again. The
stages set the session's Arrow batches to at most 1,000 rows, since a batch of whole texts is held twice.
"""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from breaklens.llm import bpe, quality  # noqa: E402
from breaklens.llm.linededup import dedup_lines  # noqa: E402
from breaklens.llm.minhash import drop_near_duplicates  # noqa: E402
from breaklens.llm.mixing import mixed_documents  # noqa: E402
from breaklens.session import pin, small_batches  # noqa: E402
from breaklens.sources.tables import table  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, which is fitted on the labelled ones among them."""
    small_batches(spark)
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document has; n_chars stays that of the source."""
    small_batches(spark)
    return dedup_lines(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, a repeated one as often as it is used."""
    small_batches(spark)
    return mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document of the mixture."""
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", duplicate_stage),
    ("mixture", mixture_stage),
    ("tokens", token_stage),
]
#: A trained classifier and the tokenizer's split pattern (a look-ahead) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
