"""Row-wise features."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_changed(*flags: str) -> Column:
    """1 when every flag is 1."""
    return reduce(lambda a, b: a & b, [F.col(c) == 1 for c in flags]).cast("int")


def missing_indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select("*", *[F.isnull(c).cast("int").alias(f"{c}_missing") for c in cols])


def fill_missing_category(c: str, value: str = "MISSING") -> Column:
    return F.coalesce(F.col(c), F.lit(value))


def interaction_features(df: DataFrame, numeric: list[str], first: int = 6) -> DataFrame:
    """Product and quotient of every pair of the first numeric columns."""
    cols = []
    for a, b in combinations(numeric[:first], 2):
        cols.append((F.col(a) * F.col(b)).alias(f"{a}_x_{b}"))
        cols.append((F.col(a) / (F.col(b) + F.lit(1e-8))).alias(f"{a}_div_{b}"))
    return df.select("*", *cols)


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_stats(df: DataFrame, all_cols: list[str], numeric: list[str]) -> DataFrame:
    """Null count over all columns; mean and sample deviation of the numeric ones, nulls skipped."""
    n = _sum([F.isnotnull(c).cast("int") for c in numeric])
    total = _sum([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric])
    with_mean = df.select(
        "*",
        _sum([F.isnull(c).cast("int") for c in all_cols]).alias("num_missing"),
        F.try_divide(total, n).alias("num_features_mean"),
        n.alias("_n"),
    )
    gaps = _sum(
        [
            F.coalesce((F.col(c) - F.col("num_features_mean")) * (F.col(c) - F.col("num_features_mean")), F.lit(0.0))
            for c in numeric
        ]
    )
    std = F.when(F.col("_n") > 1, F.sqrt(gaps / (F.col("_n") - 1)))
    return with_mean.withColumn("num_features_std", std).drop("_n")
