"""Monitoring streams on Structured Streaming, and batch drift measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breaklens.scale import exact_quantiles
from breaklens.session import scratch_path


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """Events as a file stream. Timestamps without zone cannot carry a watermark, hence the cast.

    All files that are present form one batch; with maxFilesPerTrigger the files must arrive in time
    order up to the watermark delay.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def break_counts(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Rows and breaks per tumbling window, for update mode: open windows are there as well."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum("is_break").alias("breaks")).select(F.col("w.start").alias("window_start"), "n", "breaks")


def break_rate(counts: DataFrame) -> DataFrame:
    return counts.select("window_start", "n", "breaks", (F.col("breaks") / F.col("n")).alias("break_rate"))


def matched_outcomes(predictions: DataFrame, outcomes: DataFrame, delay: str) -> DataFrame:
    """Predictions joined to outcomes of the same key and time, as both have arrived within `delay`."""
    p = predictions.withWatermark("ts", delay)
    o = outcomes.withWatermark("outcome_ts", delay)
    return p.join(o, (F.col("key") == F.col("outcome_key")) & (F.col("ts") == F.col("outcome_ts")))


def outcome_sums(matched: DataFrame, width: str) -> DataFrame:
    """Additive sums per window of a batch of matched rows."""
    return matched.groupBy(F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("predicted") == F.col("outcome")).alias("hits"),
        F.sum("predicted").alias("alarms"),
        F.sum(F.col("predicted") * F.col("outcome")).alias("true_alarms"),
    ).select(F.col("w.start").alias("window_start"), "n", "hits", "alarms", "true_alarms")


def prediction_quality(sums: DataFrame) -> DataFrame:
    return sums.select("window_start", "n", (F.col("hits") / F.col("n")).alias("accuracy"), "alarms", "true_alarms")


def _run(stream: DataFrame, label: str, mode: str, reduce_batch: Callable[[DataFrame], DataFrame]) -> str:
    """Process what is there; every batch overwrites its own folder, so a repeated batch changes nothing."""
    path = scratch_path(stream.sparkSession, label)

    def keep(batch: DataFrame, number: int) -> None:
        reduce_batch(batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{path}/out"


def latest_windows(stream: DataFrame, label: str, key: str = "window_start") -> DataFrame:
    """Every window's last state from a stream in update mode, also of windows the watermark has not closed."""
    path = _run(stream, label, "update", lambda batch: batch)
    schema = stream.schema.add("batch", "long")
    seen = stream.sparkSession.read.schema(schema).parquet(path)
    values = F.struct(*[c for c in stream.columns if c != key])
    return seen.groupBy(key).agg(F.max_by(values, "batch").alias("_v")).select(key, "_v.*")


def summed_windows(stream: DataFrame, label: str, sums: Callable[[DataFrame], DataFrame], key: str = "window_start") -> DataFrame:
    """Additive sums of every batch of an append stream, added up per window: no window waits for the watermark."""
    path = _run(stream, label, "append", sums)
    parts = stream.sparkSession.read.parquet(path)
    names = [c for c in parts.columns if c not in (key, "batch")]
    return parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in names])


def accuracy_by_period(df: DataFrame, period: str, y: str, yhat: str) -> DataFrame:
    """Model drift: accuracy per period."""
    return df.groupBy(period).agg(F.count("*").alias("n"), F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def psi(df: DataFrame, period: str, reference, features: list[str], n_bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Feature drift: population stability index of each period against the reference period.

    Bins are exact quantiles of the reference. Rows are reduced to (period, feature, bin) counts
    before anything is joined.
    """
    ref = df.filter(F.col(period) == reference)
    q = exact_quantiles(ref, features, [i / n_bins for i in range(1, n_bins)])
    cuts = {f: sorted(set(v)) for f, v in q.items()}
    items = [
        F.struct(
            F.lit(f).alias("feature"),
            sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias("bin"),
        )
        for f in features
    ]
    counts = df.select(period, F.inline(F.array(*items))).groupBy(period, "feature", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(period, "feature").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, [period, "feature"]).select(period, "feature", "bin", (F.col("n") / F.col("total")).alias("share"))
    base = shares.filter(F.col(period) == reference).select("feature", "bin", F.col("share").alias("q"))
    # every period is compared on every reference bin, also those it has no rows in
    grid = totals.select(period, "feature").join(base, "feature")
    full = grid.join(shares, [period, "feature", "bin"], "left")
    p = F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(floor))
    q_ = F.greatest("q", F.lit(floor))
    return full.groupBy(period, "feature").agg(F.sum((p - q_) * F.log(p / q_)).alias("psi"))
