"""Reproducible splits, folds and samples by a hash of the row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.scale import HASH_PRIME, bucket_count, global_rank, hash_bucket, key_hash


def holdout(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Random split by hash: no shuffle, and a row keeps its side when the data grows."""
    return df.withColumn("is_train", (key_hash(key, seed) < int(train_share * HASH_PRIME)).cast("int"))


def hash_rank(
    df: DataFrame, by: list[str], key: str, seed: int = 42, out: str = "_rank", size: str | None = None
) -> DataFrame:
    """Exact rank of each row in the hash order of its group."""
    tagged = df.withColumn("_hash", key_hash(key, seed))
    tagged = tagged.withColumn("_bucket", hash_bucket("_hash", bucket_count(df.sparkSession)))
    return global_rank(tagged, by, [F.col("_hash"), F.col(key)], "_bucket", out, size).drop("_hash", "_bucket")


def stratified(df: DataFrame, key: str, label: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Split of exact size within each class."""
    ranked = hash_rank(df, [label], key, seed, size="_n_class")
    rank = F.when(F.col("_n_class") > 1, (F.col("_rank") - 1) / (F.col("_n_class") - 1)).otherwise(0.0)
    return ranked.withColumn("is_train", (rank <= train_share).cast("int")).drop("_rank", "_n_class")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1; folds of a class differ by at most one row."""
    return hash_rank(df, [label], key, seed).withColumn("fold_id", (F.col("_rank") - 1) % k).drop("_rank")


def balanced(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """All rows of the smaller class and an equal number of the other."""
    size = df.groupBy(label).count().agg(F.min("count")).scalar()
    return hash_rank(df, [label], key, seed).filter(F.col("_rank") <= size).drop("_rank")


def walk_forward(df: DataFrame, us: str, start_us: int, width_us: int) -> DataFrame:
    """Window number of each row. Fold f tests on window f and trains on the windows before it."""
    return df.withColumn("window_id", F.floor((F.col(us) - start_us) / width_us))


def walk_forward_fold(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train and test frames of one walk-forward fold."""
    return df.filter(F.col("window_id") < fold), df.filter(F.col("window_id") == fold)


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n_class"))
    totals = counts.agg(F.struct(F.sum("_n_class").alias("n"), F.count("*").alias("k"))).scalar()
    counts = counts.withColumn("_t", totals)
    weights = counts.select(
        F.col(label).alias("_label"), (F.col("_t.n") / (F.col("_t.k") * F.col("_n_class"))).alias("weight")
    )
    return df.join(weights, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def oversample(df: DataFrame, label: str, times: Column | None = None) -> DataFrame:
    """Repeat the rows of the rarer class 1 until the classes are about even; copy_no starts at 1."""
    if times is None:
        times = df.agg(
            F.greatest(
                F.floor(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)) + 0.5), F.lit(1)
            ).cast("int")
        ).scalar()
    counted = df.withColumn("_times", F.when(F.col(label) == 1, times).otherwise(1))
    return counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")
