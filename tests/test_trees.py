"""Trees grown together are Spark ML's own, whatever folds and labels they are asked for, and read the rows once a level."""

import datetime

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from breaklens.operators import extract, models, multitask, rules, trees
from breaklens.plans import modeling


@pytest.fixture(scope="module")
def rows(spark):
    """Continuous inputs with few and many values, with zeros and without, a category, and labels of which one never holds."""
    made = [
        (i, i * 7919 % 1009 / 7.0 - 40, float(i * 31 % 5), float(i * 17 % 83), "abcdef"[i * 13 % 6], int(i * 7919 % 1009 > 700 or i % 11 == 0), int(i * 17 % 83 < 30 + 20 * (i * 13 % 6 == 2)), 0, i % 3)
        for i in range(3000)
    ]
    df = spark.createDataFrame(made, "id long, a double, b double, c double, kind string, y int, z int, never int, fold int")
    df = StringIndexer(inputCol="kind", outputCol="kind_idx", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "kind_idx", "c"], outputCol="features").transform(df).repartition(5).cache()


def nodes(spark, model):
    return [tuple(r) for r in rules.node_table(model, spark).orderBy("id").collect()]


def tree(depth=4, leaf=1):
    return DecisionTreeClassifier(labelCol="label", maxDepth=depth, minInstancesPerNode=leaf, seed=42)


def coded(rows, ests, folds=3):
    return trees.Rows.of(rows, vector_to_array("features"), trees.categories(rows, "features"), {y: F.col(y) for y in ("y", "z", "never")}, ests, F.col("fold"), folds)


def test_grown_trees_are_those_of_spark(spark, rows):
    asks = [trees.Ask(est, y, (0, 1, 2, 3), f) for est in (tree(), tree(3, 200)) for y in ("y", "z", "never") for f in (None, 2)]
    held = coded(rows, [a.est for a in asks])
    for ask, got in zip(asks, held.grow(asks)):
        own = models.fit("tree", ask.est, rows if ask.without is None else rows.where(F.col("fold") != ask.without), ask.target)
        mine = held.model(ask, got)
        assert nodes(spark, mine) == nodes(spark, own.model)
        assert mine.numFeatures == 4 and mine.numClasses == own.model.numClasses
        assert list(mine.featureImportances) == list(own.model.featureImportances)


@pytest.mark.parametrize("chained,oof", [(True, True), (False, True)])
def test_chains_equal_those_fitted_one_by_one(spark, rows, monkeypatch, chained, oof):
    args = (rows, ["z", "never"], "y", tree(), tree(5), 3, "fold", chained, oof)
    mine = multitask._fit_staged(*args)
    monkeypatch.setattr(trees.Rows, "of", lambda *a: None)
    own = multitask._fit_staged(*args)
    assert mine.inputs == own.inputs and mine.final_inputs == own.final_inputs
    for a, b in zip([*mine.stages, mine.final], [*own.stages, own.final]):
        assert nodes(spark, a.model) == nodes(spark, b.model)
    a, b = ({r["id"]: (r["prob"], r["pred"]) for r in c.score(rows).collect()} for c in (mine, own))
    assert a == b


def test_trees_grow_in_the_same_scans(spark, rows, monkeypatch):
    scans, real = [], trees.Rows._scan
    monkeypatch.setattr(trees.Rows, "_scan", lambda *a: scans.append(1) or real(*a))
    monkeypatch.setattr(DecisionTreeClassifier, "_fit", lambda *a: pytest.fail("fitted on its own"))
    out = multitask.train_shared(rows, ["y", "z", "never"], {"decision_tree": [tree(2), tree(4)]})
    assert len(scans) <= 4 and set(out["decision_tree"]) == {"y", "z", "never"}
    scans.clear()
    assert multitask.importance_matrix(rows, ["y", "z"], tree(), ["a", "b", "kind", "c"]).count() == 8
    assert len(scans) <= 4
    scans.clear()
    multitask.fit_chain(rows, ["y", "z"], "y", tree(), tree(5), 3, "fold")
    assert len(scans) <= 4 + 4 + 5


def test_surrogates_grow_and_answer_together(spark, rows, monkeypatch):
    scored = rows.withColumns({"p": F.col("a") / 100, "q": F.col("c") / 83, "low": F.lit(0.1)})
    scored = VectorAssembler(inputCols=["p", "q"], outputCol="both").transform(scored)
    names = ["a", "b", "kind", "c"]
    asked = [extract.Mimic("p", names, 4, 50, 0.7), extract.Mimic("low", names, 4, 50, 0.7), extract.Mimic("q", ["p", "q"], 3, 1, 0.5, "both")]
    want = []
    for m in asked:
        found, own = extract.surrogate(scored, m.prob, m.names, m.depth, m.leaf, m.min_confidence, m.min_samples, m.features, m.method)
        want.append((found, extract.fidelity(scored, m.prob, own)))
    scans, real = [], trees.Rows._scan
    monkeypatch.setattr(trees.Rows, "_scan", lambda *a: scans.append(1) or real(*a))
    assert extract.surrogates(scored, asked) == want
    assert len(scans) <= 4 + 1


def test_other_rows_are_left_to_spark(rows):
    assert coded(rows, [tree()], folds=2) is None  # a fold of its own
    assert coded(rows.withColumn("z", F.col("z") * 2), [tree()]) is None
    assert coded(rows.withColumn("y", F.when(F.col("id") > 5, F.col("y"))), [tree()]) is None
    assert coded(rows, [DecisionTreeClassifier(impurity="entropy")]) is None


def test_samples_are_those_of_spark(spark):
    """Candidate splits of many rows come from a sample by training set, the same as Spark ML draws."""
    df = spark.range(0, 40000, 1, 4).selectExpr("id", "hash(id) / 1e6 AS a", "cast(hash(id) % 7 + id % 3 > 0 AS int) AS y", "cast(id % 50 = 0 AS int) AS fold")
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    asks = [trees.Ask(tree(3), "y", (0,), f) for f in (None, 0, 1)]
    held = trees.Rows.of(df, vector_to_array("features"), {}, {"y": F.col("y")}, [tree(3)], F.col("fold"), 2)
    assert held.size == {None: 40000, 0: 800, 1: 39200} and (held.owner == 0).sum() == 800 and 8000 < (held.owner == 1).sum() < 12000
    for ask, got in zip(asks, held.grow(asks)):
        own = models.fit("tree", ask.est, df if ask.without is None else df.where(F.col("fold") != ask.without), "y")
        assert nodes(spark, held.model(ask, got)) == nodes(spark, own.model)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder, day = str(tmp_path_factory.mktemp("few")), datetime.datetime(2024, 1, 1)
    tables = {
        "orders": ([(i, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"][i % 4], 1000.0 + 17 * i, day) for i in range(200)], "o_orderkey bigint, o_orderpriority string, o_totalprice double, o_orderdate timestamp"),
        "lineitem": (
            [(i % 200, i * 7 % 60, i * 3 % 20, i // 200, float(i * 13 % 50 + 1), 100.0 * (i * 31 % 97), i * 17 % 11 / 100, i * 5 % 9 / 100, "ANR"[i % 3], "OF"[i % 2], day) for i in range(800)],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
    }
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_the_stack_takes_five_folds(spark, small, monkeypatch):
    seen, real = [], multitask.fit_stack
    monkeypatch.setattr(multitask, "fit_stack", lambda t, *a: seen.append(a[-2:]) or real(t, *a))
    assert modeling.stack_oof(spark, small).count() == 1
    assert seen == [(5, "fold")]


def test_architectures_are_boosted_in_full(spark, small, monkeypatch):
    """As many rounds and as deep as the original, classifiers and regressors alike."""
    seen = []

    def fit(self, df):
        seen.append((self.getMaxIter(), self.getMaxDepth(), self.getStepSize()))
        return real[type(self)](self.copy({self.maxIter: 1, self.maxDepth: 1}), df)

    real = {k: k._fit for k in (GBTClassifier, GBTRegressor)}
    for k in real:
        monkeypatch.setattr(k, "_fit", fit)
    assert modeling.compare_architectures(spark, small).count() == 2
    assert seen == [(100, 6, 0.1)] * 7


def test_field_models_read_written_rows(spark, small, monkeypatch):
    files, real = [], GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, df: files.append(df.inputFiles()) or real(self, df))
    assert modeling.break_then_fields(spark, small).count() == 3
    assert len(files) == 3 and all(f and all("fields-" in x for x in f) for f in files)
