"""Ranks, running totals, quantiles and blocks are exact, also with hot groups and heavy ties."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from breaklens import scale
from breaklens.operators import metrics, splits, temporal
from breaklens.scale import block_window, exact_quantiles, global_rank, lookback_blocks, value_buckets


def linear_quantile(values, p):
    v = sorted(values)
    pos = p * (len(v) - 1)
    lo, hi = v[int(pos)], v[min(int(pos) + 1, len(v) - 1)]
    return lo + (pos - int(pos)) * (hi - lo)


@pytest.mark.parametrize("kind", ["uniform", "one value", "half one value", "two values", "steps", "wide", "ends"])
def test_exact_quantiles_with_narrowing(spark, monkeypatch, kind):
    monkeypatch.setattr(scale, "HISTOGRAM", 40)
    rnd = random.Random(1)
    values = {
        "uniform": [rnd.random() for _ in range(3000)],
        "one value": [5.0] * 500,
        "half one value": [1.0] * 1500 + [rnd.random() * 10 for _ in range(1500)],
        "two values": [0.0] * 999 + [1.0] * 1001,
        "steps": [float(i // 7) for i in range(2500)],
        "wide": [s * 10.0**e for e in range(-300, 309, 50) for s in (-1.7, -1.0, 1.0)] + [5e-324, 0.0, -0.0],
        "ends": [math.inf, -math.inf, 1.0, 2.0, math.nan],
    }[kind]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "x double, empty double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x", "empty"], probs)
    assert got["empty"] == [None] * len(probs)
    for p, g in zip(probs, got["x"]):
        want = linear_quantile([v for v in values if v == v], p)
        assert g == want or math.isclose(g, want, abs_tol=1e-12) or (g != g and want != want), (kind, p)


def test_buckets_are_even(spark):
    df = spark.range(20_000).select((F.col("id") * F.col("id") * F.col("id")).alias("v"))
    sizes = [r["count"] for r in value_buckets(df, "v", 20).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 19 and max(sizes) <= 2100
    assert value_buckets(df.limit(0), "v", 20).count() == 0


def test_rank_of_a_hot_group(spark):
    df = spark.range(4000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 997).alias("v")
    )
    tagged = value_buckets(df, "v", 16)
    got = global_rank(tagged, ["g"], [F.col("v"), F.col("k")], "_bucket")
    want = df.withColumn("want", F.row_number().over(W.partitionBy("g").orderBy("v", "k")))
    assert got.join(want.select("k", "want"), "k").filter("_rank <> want").count() == 0
    # no bucket holds a whole hot group
    assert tagged.groupBy("g", "_bucket").count().agg(F.max("count")).first()[0] < 1000


def test_blocks_look_back_across_borders(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7).alias("e"), (F.col("id") % 13).alias("x"))
    tagged = value_buckets(df, "id", 8)
    blocks = lookback_blocks(tagged, "e", [F.col("id")], "_bucket", depth=9, block_rows=50)
    assert blocks.groupBy("e", "_block").count().agg(F.max("count")).first()[0] <= 59
    got = temporal.sequence_windows(blocks, "e", "x", 10).select("id", F.array_join("sequence", ",").alias("s"))
    w = W.partitionBy("e").orderBy("id").rowsBetween(-9, 0)
    want = df.withColumn("l", F.collect_list("x").over(w)).filter(F.size("l") == 10).select("id", F.array_join("l", ",").alias("t"))
    both = got.join(want, "id", "full")
    assert both.filter("NOT (s <=> t)").count() == 0
    lagged = blocks.withColumn("p", F.lag("x").over(block_window("e"))).filter("NOT _copy")
    assert lagged.filter("p IS NULL").count() == df.select("e").distinct().count()


def test_auc_symmetry_and_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    auc = metrics.auc(df, "y", "p").first()["auc"]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(auc, brute, abs_tol=1e-12)
    flipped = metrics.auc(df.withColumn("p", 1 - F.col("p")), "y", "p").first()["auc"]
    assert math.isclose(auc + flipped, 1.0, abs_tol=1e-12)


def test_folds_are_disjoint_complete_and_even(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    f = splits.stratified_folds(df, "k", "y", 5)
    assert f.count() == 1003 and f.select("k").distinct().count() == 1003
    sizes = f.groupBy("y", "fold_id").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in sizes)


def test_walk_forward_never_trains_on_the_future(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") * 10).alias("us"))
    w = splits.walk_forward(df, "us", 0, 100)
    train, test = splits.walk_forward_fold(w, 4)
    assert train.agg(F.max("us")).first()[0] < test.agg(F.min("us")).first()[0]
