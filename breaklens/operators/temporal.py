"""Features of ordered events per entity, without future leakage.

Inputs are blocks made by `lookback_blocks`: every entity is cut into even runs of rows, so an
entity with a third of all events is many tasks, not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.scale import block_window, prefix_aggregate

_META = ("_rank", "_block", "_copy")


def _own(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~F.col("_copy")).drop(*_META)


def sequence_windows(blocks: DataFrame, entity: str, value: str, length: int, out: str = "sequence") -> DataFrame:
    """The last `length` values up to each row; rows with a shorter past are left out."""
    w = block_window(entity).rowsBetween(-(length - 1), 0)
    seq = blocks.withColumn(out, F.collect_list(value).over(w))
    return _own(seq.filter(F.size(out) == length))


def lag_features(blocks: DataFrame, entity: str, col: str, periods: int = 3) -> DataFrame:
    w = block_window(entity)
    return _own(blocks.select("*", *[F.lag(col, i).over(w).alias(f"{col}_lag{i}") for i in range(1, periods + 1)]))


def rolling_stats(blocks: DataFrame, entity: str, col: str, width: int) -> DataFrame:
    """Mean and sample deviation of the `width` rows before each row."""
    w = block_window(entity).rowsBetween(-width, -1)
    return _own(
        blocks.select("*", F.avg(col).over(w).alias(f"{col}_roll_mean"), F.stddev(col).over(w).alias(f"{col}_roll_std"))
    )


def change_velocity(blocks: DataFrame, entity: str, col: str, us: str) -> DataFrame:
    """Change of a value per second since the previous row."""
    w = block_window(entity)
    gap = (F.col(us) - F.lag(us).over(w)) / 1e6
    return _own(blocks.withColumn("velocity", F.try_divide(F.col(col) - F.lag(col).over(w), gap)))


def change_history(blocks: DataFrame, entity: str, flag: str, us: str) -> DataFrame:
    """Share of earlier rows with the change, and seconds since the last change, from past rows only."""
    past = prefix_aggregate(
        blocks.filter(~F.col("_copy")),
        [entity],
        [F.col("_rank")],
        "_block",
        {
            "_changes": ("sum", F.col(flag).cast("bigint")),
            "_last_us": ("max", F.when(F.col(flag) == 1, F.col(us))),
        },
        inclusive=False,
    )
    return past.select(
        *[c for c in blocks.columns if c not in _META],
        F.when(F.col("_rank") > 1, F.col("_changes") / (F.col("_rank") - 1)).alias("hist_change_freq"),
        ((F.col(us) - F.col("_last_us")) / 1e6).alias("seconds_since_change"),
    )


def mode_stability(df: DataFrame, entity: str, col: str) -> DataFrame:
    """Most frequent category of each entity (smallest among equals) and how often rows differ from it."""
    counts = df.groupBy(entity, col).agg(F.count("*").alias("n"))
    best = counts.groupBy(entity).agg(
        F.min(F.struct((-F.col("n")).alias("k"), F.col(col).alias("mode"))).alias("b"), F.sum("n").alias("n_rows")
    )
    return best.select(
        entity, F.col("b.mode").alias("mode"), "n_rows", (1 + F.col("b.k") / F.col("n_rows")).alias("share_off_mode")
    )


def seasonal_profile(df: DataFrame, ts: str, flag: str) -> DataFrame:
    """Change rate per hour of day, day of week (1 = Sunday) and month."""
    units = F.array(
        *[
            F.struct(F.lit(u).alias("unit"), f(ts).alias("value"))
            for u, f in (("hour", F.hour), ("weekday", F.dayofweek), ("month", F.month))
        ]
    )
    long = df.select(flag, F.inline(units))
    return long.groupBy("unit", "value").agg(F.count("*").alias("n"), F.avg(flag).alias("change_rate"))
