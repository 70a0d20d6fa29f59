"""Sources, splits and samples."""

from pyspark.sql import functions as F

from breaklens.operators import splits
from breaklens.plans.registry import EVENTS, TXN, register
from breaklens.scale import HASH_PRIME, key_hash_sql
from breaklens.sources.tables import TXN_COLUMNS, raw_events, txn

H = key_hash_sql("txn_key")
DAY_US = 86_400_000_000
START_US = 1_704_067_200_000_000  # 2024-01-01


_TXN_OUT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c in ("ts", "o_orderdate") else c for c in TXN_COLUMNS)


@register("src_txn", f"WITH {TXN} SELECT {_TXN_OUT} FROM txn")
def src_txn(spark, sf):
    t = txn(spark, sf)
    return t.withColumns({c: F.col(c).cast("string") for c in ("ts", "o_orderdate")})


@register(
    "split_holdout",
    f"WITH {TXN} SELECT txn_key, CAST({H} < {int(0.8 * HASH_PRIME)} AS INT) AS is_train FROM txn",
)
def split_holdout(spark, sf):
    return splits.holdout(txn(spark, sf, ["txn_key"]), "txn_key")


@register(
    "split_stratified",
    f"""WITH {TXN}
    SELECT txn_key, was_exception,
           CAST(percent_rank() OVER (PARTITION BY was_exception ORDER BY {H}, txn_key) <= 0.8 AS INT) AS is_train
    FROM txn""",
)
def split_stratified(spark, sf):
    return splits.stratified(txn(spark, sf, ["txn_key", "was_exception"]), "txn_key", "was_exception")


@register(
    "split_kfold",
    f"""WITH {TXN}
    SELECT txn_key, was_exception,
           (row_number() OVER (PARTITION BY was_exception ORDER BY {H}, txn_key) - 1) % 5 AS fold_id
    FROM txn""",
)
def split_kfold(spark, sf):
    return splits.stratified_folds(txn(spark, sf, ["txn_key", "was_exception"]), "txn_key", "was_exception", 5)


@register(
    "sample_balanced",
    f"""WITH {TXN}, r AS (
      SELECT txn_key, was_exception,
             row_number() OVER (PARTITION BY was_exception ORDER BY {H}, txn_key) AS rn FROM txn)
    SELECT txn_key, was_exception FROM r
    WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM txn GROUP BY was_exception))""",
)
def sample_balanced(spark, sf):
    return splits.balanced(txn(spark, sf, ["txn_key", "was_exception"]), "txn_key", "was_exception")


@register(
    "split_walk_forward",
    f"""WITH {EVENTS}
    SELECT event_id, CAST(floor((us - {START_US}) / (5.0 * {DAY_US})) AS BIGINT) AS window_id FROM txn_events""",
)
def split_walk_forward(spark, sf):
    return splits.walk_forward(raw_events(spark, sf), "us", START_US, 5 * DAY_US).select("event_id", "window_id")


@register(
    "oversample_minority",
    f"""WITH {TXN}, m AS (
      SELECT CAST(greatest(floor(count_if(was_exception=0) * 1.0 / count_if(was_exception=1) + 0.5), 1) AS INT) AS k FROM txn)
    SELECT txn_key, was_exception,
           unnest(generate_series(1, CASE WHEN was_exception=1 THEN (SELECT k FROM m) ELSE 1 END))::INT AS copy_no
    FROM txn""",
)
def oversample_minority(spark, sf):
    return splits.oversample(txn(spark, sf, ["txn_key", "was_exception"]), "was_exception")


@register(
    "class_weight",
    f"""WITH {TXN}, c AS (SELECT was_exception, count(*) AS n FROM txn GROUP BY 1)
    SELECT txn_key, was_exception, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n * 1.0::DOUBLE), 6) AS weight
    FROM txn JOIN c USING (was_exception)""",
)
def class_weight(spark, sf):
    w = splits.class_weight(txn(spark, sf, ["txn_key", "was_exception"]), "was_exception")
    return w.withColumn("weight", F.round("weight", 6))
