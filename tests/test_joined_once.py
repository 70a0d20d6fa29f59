"""Queries of many passes read the joined rows from where they were written; the tables are joined once."""

import datetime

import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__ as entry
from breaklens.operators import extratrees, models
from breaklens.plans import modeling, rulesets


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few hundred line items with their look-up tables."""
    folder, day = str(tmp_path_factory.mktemp("small")), datetime.datetime(2024, 1, 1)
    tables = {
        "nation": ([(i, f"NATION {i}", 0) for i in range(5)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "supplier": ([(i, f"S{i}", i % 5, 37.5 * i - 100) for i in range(20)], "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double"),
        "part": ([(i, f"P{i}", f"Brand#{i % 7}", f"TYPE {i % 9}", i % 50 + 1, 900.0 + i) for i in range(60)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(i, i % 11, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"][i % 4], 1000.0 + 17 * i, day) for i in range(200)], "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double, o_orderdate timestamp"),
        "lineitem": (
            [(i % 200, i * 7 % 60, i * 3 % 20, i // 200, float(i * 13 % 50 + 1), 100.0 * (i * 31 % 97), i * 17 % 11 / 100, i * 5 % 9 / 100, "ANR"[i % 3], "OF"[i % 2], day) for i in range(800)],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize(
    "name",
    [
        "break_signatures", "encode_reconstruct", "prepare_inputs", "preprocess_stages", "feature_stats_categorical", "extra_tree_levels",
        "rule_model_hybrid", "anchor_rules", "root_causes", "unified_explain", "ops_risk_report", "hierarchical_explain",
    ],
)
def test_results_do_not_join_the_tables_again(spark, small, name):
    out = entry.queries()[name](spark, small)
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    assert out.columns


def test_joined_rows_are_given_up_for_the_features(spark, small):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    with modeling.model_data(spark, small) as (train, test, names):
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before + 1
        assert train.count() + test.count() == 800
    with rulesets.chained(spark, small) as (s, _):
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before + 1
        assert s.count() == 800


def test_rows_that_cannot_be_assembled_are_reported(spark, small, tmp_path):
    for name in ("nation", "supplier", "part", "orders"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    lines.withColumn("l_tax", F.when(F.col("l_linenumber") < 3, F.col("l_tax"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    row = entry.queries()["clf_svm_linear"](spark, str(tmp_path)).first()
    assert row["error"] and row["accuracy"] is None


def test_searches_answer_from_few_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(LinearSVC, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()))
    rows = spark.createDataFrame([(Vectors.dense([float(i)]), i % 2) for i in range(400)], ["features", "y"]).repartition(200)
    models.fit("svm_linear", models.estimators(1)["svm_linear"], rows, "y")
    assert seen[0] <= models.TURNS * spark.sparkContext.defaultParallelism < 200


def test_trees_scan_twice_a_level_and_draw_weights_once(spark, monkeypatch):
    scans, drawn, real, weighed = [], [], extratrees._scan, extratrees._weighed
    monkeypatch.setattr(extratrees, "_scan", lambda *a: scans.append(1) or real(*a))
    monkeypatch.setattr(extratrees, "_weighed", lambda *a: drawn.append(1) or weighed(*a))
    rows = spark.createDataFrame([(i, Vectors.dense([float(i % 37), float(i * 7 % 11)]), float(i % 37 > 15)) for i in range(400)], ["key", "features", "label"])
    tree = extratrees.ExtraTrees(trees=3, depth=2, features=2, bootstrapKey="key").fit(rows)
    assert len(scans) <= 4 and len(drawn) == 1
    for grown in tree.grown:
        for i in grown.feature:
            assert grown.rows[i] == grown.rows[2 * i] + grown.rows[2 * i + 1]
            assert grown.hits[i] == grown.hits[2 * i] + grown.hits[2 * i + 1]
