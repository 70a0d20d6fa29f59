"""Category dictionaries that stay distributed: distinct values, their global rank, and the join back.

A dictionary is a table with one row per category, so a column may have as many categories as rows. Ranks come from
a range-partitioned sort: position in the partition plus the rows of the partitions before it. Only the
partition sizes are ordered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from breaklens.session import pin

_ROW_BITS = 33  # bits of the row in monotonically_increasing_id


def fit_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, idx, n) of every category that is not null: index in sorted order from 0, and rows that have it."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = pin(counts.orderBy("value").withColumn("at", F.monotonically_increasing_id()), "dictionary")
    part = F.shiftright("at", _ROW_BITS).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    row = F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("part", part).join(starts, "part").select("value", (F.col("start") + row).alias("idx"), "n")


def encode(df: DataFrame, dictionaries: dict[str, DataFrame], unseen: str = "null") -> DataFrame:
    """Add `<column>_idx` for every dictionary; nulls and unseen values are null, with 'keep' one past the last index.

    Joins carry no hints: Spark broadcasts dictionaries within its size limit and splits hot categories otherwise.
    """
    out = df
    for c, table in dictionaries.items():
        out = out.join(table.select(F.col("value").alias(f"_{c}"), F.col("idx").alias(f"{c}_idx")), F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
        if unseen == "keep":
            out = out.withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", table.agg(F.count("*")).scalar()))
    return out


def categories(df: DataFrame, columns: list[str], missing: str = "MISSING") -> DataFrame:
    """One row per column and category: column_name, category, idx, n, vocab_size and the column's missing_rate.

    The columns are written once, since each is counted on its own.
    """
    df = pin(df.select(*columns), "categories")
    parts = []
    for c in columns:
        text = df.select(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("v"), F.col(c).isNull().alias("none"))
        table = fit_dictionary(text, "v")
        whole = text.agg(F.count_if("none").alias("lost"), F.count("*").alias("rows"))
        rate = whole.select(F.try_divide(F.col("lost").cast("double"), F.col("rows"))).scalar()
        size = table.agg(F.count("*")).scalar()
        parts.append(table.select(F.lit(c).alias("column_name"), F.col("value").alias("category"), "idx", "n", size.alias("vocab_size"), rate.alias("missing_rate")))
    return reduce(DataFrame.unionByName, parts)
