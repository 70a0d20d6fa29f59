"""Selections and summaries over association results, and data checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.functions.bands import CHI2_05


def actionable_fields(singles: DataFrame, min_break_rate: float = 0.3, min_lift: float = 1.5) -> DataFrame:
    return singles.filter(
        (F.col("chi2") > CHI2_05) & (F.col("rate_changed") > min_break_rate) & (F.col("lift") > min_lift)
    )


def dangerous_pairs(pairs: DataFrame, min_cases: int = 10, min_break_rate: float = 0.3) -> DataFrame:
    return pairs.filter(
        (F.col("chi2") > CHI2_05) & (F.col("cases") >= min_cases) & (F.col("rate_both") > min_break_rate)
    )


def pattern_summary(singles: DataFrame, pairs: DataFrame, triplets: DataFrame) -> DataFrame:
    """Counts, leaders and recommendations as (section, item, value)."""

    def counts(df: DataFrame, section: str) -> DataFrame:
        both = df.agg(
            F.count_if(F.col("chi2") > CHI2_05).cast("double").alias("significant"),
            F.count("*").cast("double").alias("tested"),
        )
        return both.unpivot([], ["significant", "tested"], "item", "value").select(
            F.lit(section).alias("section"), "item", "value"
        )

    def leaders(df: DataFrame, section: str, label: str, name: str, value: str, n: int) -> DataFrame:
        top = df.orderBy(F.desc_nulls_last("chi2"), name).limit(n)
        return top.select(
            F.lit(section).alias("section"),
            F.concat(F.lit(f"{label}: "), F.col(name)).alias("item"),
            F.col(value).alias("value"),
        )

    parts = [
        counts(singles, "individual"),
        leaders(singles, "individual", "top", "field", "rate_changed", 1),
        leaders(singles, "individual", "top lift", "field", "lift", 1),
        counts(pairs, "pairwise"),
        leaders(pairs, "pairwise", "top", "pair_name", "rate_both", 1),
        leaders(pairs, "pairwise", "top interaction lift", "pair_name", "interaction_lift", 1),
        leaders(triplets, "triplet", "top", "triplet_name", "rate_changed", 1),
        leaders(singles.filter("lift > 2"), "recommendation", "monitor", "field", "lift", 3),
        leaders(pairs.filter("interaction_lift > 1.5"), "recommendation", "watch", "pair_name", "interaction_lift", 2),
    ]
    return reduce(DataFrame.unionByName, parts)


def consistency_check(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that fail each named check, in one scan."""
    wide = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    return wide.unpivot([], list(checks), "check_name", "n_rows")


def ratio_guard(df: DataFrame, name: str, num: str, den: str) -> DataFrame:
    """Zero denominators of a ratio, and its mean over the other rows."""
    return df.agg(
        F.lit(name).alias("ratio"),
        F.count_if(F.col(den) == 0).alias("zero_denominators"),
        F.avg(F.try_divide(F.col(num), F.col(den))).alias("mean_ratio"),
    )
