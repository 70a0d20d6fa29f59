"""Hand cases and properties of the operators."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breaklens.functions import text
from breaklens.operators import assoc, graph, knn, metrics, network, prep, rules, stats, txn_graph
from breaklens.operators.rules import Rule
from breaklens.plans import catalogue
from breaklens.sources.tables import nan_to_null, txn
from breaklens.spec import FLAGS, LABELS, TARGET, FeatureSpec


def sig(spark, rows, flags):
    return stats.signature_counts(spark.createDataFrame(rows, [*flags, "y"]), flags, "y")


def test_clean_text_hand_cases(spark):
    texts = ["c-tx per abc", "x C-TX y", " c-Tx", "has abc", "dd only", "nothing here ", "", None]
    want = ["C-TX", "C-TX", "C-TX", "abc", "dd", "nothing here", "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", text.clean_text_field(F.col("t"), ["C-TX", "abc", "dd", "df"]).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in out] == want


def test_multi_hot_whole_items_only(spark):
    df = spark.createDataFrame([("a b, c-d ,,x",), ("a b c",), (None,)], "t string")
    out = text.multi_hot(df, "t", ["a b", "c-d", "zz"])
    assert out.columns == ["t", "t_a_b", "t_c_d", "t_zz"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 1, 0), (0, 0, 0), (0, 0, 0)]


def test_two_by_two(spark):
    rows = [(0, 0)] * 30 + [(0, 1)] * 10 + [(1, 0)] * 8 + [(1, 1)] * 22
    s = sig(spark, rows, ["f"])
    r = stats.chi2_individual(s, ["f"], "y").withColumn("p", stats.chi2_p_value(F.col("chi2"))).first()
    assert math.isclose(r["chi2"], 14.248732, abs_tol=1e-6) and math.isclose(r["p"], 1.6017e-4, rel_tol=1e-4)
    assert math.isclose(r["rate_changed"], 22 / 30) and r["rate_not_changed"] == 0.25
    assert math.isclose(r["lift"], 2.93333333, abs_tol=1e-6) and math.isclose(r["odds_ratio"], 8.25)
    plain = stats.chi2_individual(s, ["f"], "y", correction=False).first()
    assert math.isclose(plain["chi2"], 16.137610, abs_tol=1e-6)


def test_p_value_keeps_relative_precision(spark):
    xs = [0.0, 1e-6, 0.3, 2.7, 3.84, 7.9, 8.1, 20.0, 80.0, 850.0, 1400.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.chi2_p_value(F.col("x")).alias("p"))
    for r in df.collect():
        assert math.isclose(r["p"], math.erfc(math.sqrt(r["x"] / 2)), rel_tol=1e-9), r


def test_constant_flag_keeps_its_row(spark):
    r = stats.chi2_individual(sig(spark, [(0, 0), (0, 1)], ["f"]), ["f"], "y").first()
    assert r["field"] == "f" and r["chi2"] is None and r["significance"] is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=4, max_size=40))
def test_chi2_is_symmetric(spark, rows):
    a = stats.chi2_individual(sig(spark, rows, ["f"]), ["f"], "y").first()["chi2"]
    b = stats.chi2_individual(sig(spark, [(y, f) for f, y in rows], ["f"]), ["f"], "y").first()["chi2"]
    assert (a is None and b is None) or math.isclose(a, b, abs_tol=1e-9)


def test_planted_pair_ranks_first(spark, sf):
    s = stats.signature_counts(txn(spark, sf, [*FLAGS, TARGET]), FLAGS, TARGET)
    top = stats.chi2_pairwise(s, FLAGS, TARGET).orderBy(F.desc("chi2")).first()
    assert {top["field_1"], top["field_2"]} == {"chg_factor", "chg_principal"}


def test_five_baskets(spark):
    b = [["a", "b", "Y"]] * 2 + [["a", "Y"], ["b", "N"], ["a", "b", "N"]]
    df = spark.createDataFrame([(x,) for x in b], "items array<string>")
    sets = assoc.frequent_itemsets(df, 0.2)
    assert sets.count() == 11
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])) for r in assoc.association_rules(sets, 0.6, 0.0).collect()}
    want = set()
    support = lambda items: sum(set(items) <= set(x) for x in b)
    for r in sets.collect():
        items = r["itemset"]
        for m in range(1, 2 ** len(items) - 1):
            ante = tuple(x for i, x in enumerate(items) if m >> i & 1)
            cons = tuple(x for i, x in enumerate(items) if not m >> i & 1)
            if support(items) / support(ante) >= 0.6 - 1e-12:
                want.add((ante, cons))
    assert got == want


def test_fold_mining_equals_mining_each_part(spark):
    rnd = random.Random(5)
    rows = [([x for x in "abcd" if rnd.random() < 0.5] + [rnd.choice([assoc.BREAK, assoc.NO_BREAK])], i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "items array<string>, fold long")
    got = {(r["fold"], tuple(r["itemset"]), r["n"]) for r in assoc.fold_itemsets(df, "fold", 3, 0.15).collect()}
    want = set()
    for f in range(3):
        for r in assoc.frequent_itemsets(df.filter(F.col("fold") != f).select("items"), 0.15).collect():
            want.add((f, tuple(r["itemset"]), r["n"]))
    assert got == want


def test_path_graph_measures(spark):
    edges = spark.createDataFrame([("break", "a", "b", 0.5), ("break", "b", "c", 0.5)], "network_type string, src string, dst string, weight double")
    nodes = graph.vertices(edges, ["a", "b", "c", "d"]).filter("network_type = 'break'")
    s = graph.graph_summary(edges, nodes).first()
    assert s["num_components"] == 2 and math.isclose(s["density"], 1 / 3) and s["avg_clustering"] == 0
    deg = {r["node"]: r["degree_centrality"] for r in graph.degree_centrality(edges, nodes).collect()}
    assert math.isclose(deg["b"], 2 / 3) and deg["d"] == 0
    paths = graph.shortest_paths(edges, nodes)
    btw = {r["node"]: r["betweenness"] for r in graph.betweenness_centrality(paths, nodes).collect()}
    assert math.isclose(btw["b"], 1 / 3) and btw["a"] == 0


def test_communities_find_two_cliques(spark):
    e = [("break", a, b, 1.0) for g in ("abc", "xyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("break", "c", "x", 0.1)]
    edges = spark.createDataFrame(e, "network_type string, src string, dst string, weight double")
    nodes = graph.vertices(edges, list("abcxyz")).filter("network_type = 'break'")
    c = {r["node"]: r["community"] for r in graph.communities(edges, nodes).collect()}
    assert c["a"] == c["b"] == c["c"] != c["x"] == c["y"] == c["z"]


def test_empty_labels_give_zero_jaccard(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "a int, b int, c int, d int")
    assert metrics.multilabel(df, [("a", "b"), ("c", "d")]).first()["jaccard_score"] == 0


def test_every_row_has_one_rule(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "x double")
    two = [Rule((("x", "<=", 1.0),), 1, 1.0, 0, name="rule_0"), Rule((), 0, 1.0, 0, name="rule_1")]
    out = rules.predict_rule_list(df, two).collect()
    assert [r["rule_prediction"] for r in out] == [1, 1, 0, 0]
    assert out[0]["explanation"] == "Rule 0: IF x <= 1.000 THEN 1" and out[3]["explanation"] == "Default rule: predict 0"


def test_rule_list_covers_all_rows_once(spark, sf):
    t = txn(spark, sf, ["l_quantity", "l_discount", TARGET])
    found = rules.greedy_rule_list(t, ["l_quantity", "l_discount"], TARGET, 5)
    assert sum(r.support for r in found) == t.count() and not found[-1].conditions


def test_dedup_keeps_the_better_rule():
    a = Rule((("x", "<=", 1.0), ("y", ">", 2.0)), 1, 0.9, 10, name="a")
    b = Rule((("y", ">", 2.0), ("x", "<=", 1.0)), 1, 0.8, 10, name="b")
    c = Rule((("z", ">", 0.0),), 1, 0.7, 10, name="c")
    assert [r.name for r in rules.dedup([a, b, c])] == ["a", "c"]


@pytest.mark.parametrize("shape", ["cloud", "copies", "outlier"])
def test_knn_equals_brute_force(spark, shape):
    rnd = random.Random(9)
    train = [(i, float(rnd.randint(0, 12)), float(rnd.randint(0, 12)), rnd.random(), rnd.randint(0, 1)) for i in range(150)]
    if shape == "copies":
        train = [(i, 3.0, 3.0, 0.5, i % 2) if i % 3 else t for i, t in enumerate(train)]
    test = [(1000 + i, float(rnd.randint(0, 12)), float(rnd.randint(0, 12)), rnd.random(), 0) for i in range(25)]
    if shape == "outlier":
        test += [(2000, 500.0, -300.0, 0.0, 0)]
    schema = "k long, a double, b double, c double, y int"
    out = knn.predict(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), "k", ["a", "b", "c"], "y", 5)
    got = {r["k"]: r["share"] for r in out.collect()}
    for q in test:
        near = sorted(train, key=lambda t: (sum((t[j] - q[j]) ** 2 for j in (1, 2, 3)), t[0]))[:5]
        assert math.isclose(got[q[0]], sum(t[4] for t in near) / 5), q
    assert len(got) == len(test)


def test_similarity_degrees_equal_listed_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["T1", "T2", None]), rnd.choice(["EUR", "USD", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t string, c string")
    pairs = txn_graph.similar_pairs(df, "k", "t", "c").collect()
    want = {i: [0, 0] for i, _, _ in rows}
    for p in pairs:
        assert p["weight"] == (0.3 if p["relation"] == "same_currency" else 0.5)
        for k in (p["src"], p["dst"]):
            want[k][p["relation"] == "same_currency"] += 1
    for r in txn_graph.similarity_degrees(df, "k", "t", "c").collect():
        assert [r["similar_type"], r["same_currency"]] == want[r["k"]]
        assert math.isclose(r["weighted_degree"], 0.5 * want[r["k"]][0] + 0.3 * want[r["k"]][1])


def test_jaccard_networks_cut_strictly(spark):
    rows = [(1, 1, 1)] * 1 + [(1, 0, 1)] * 9 + [(0, 0, 0)] * 5
    e = network.networks(sig(spark, rows, ["f", "g"]), ["f", "g"], "y", threshold=0.1).filter("network_type = 'break'")
    assert e.count() == 0  # exactly 0.1 is not an edge


def test_scaler_of_a_constant_and_median_fill(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (4.0, 2.0)], "a double, b double")
    out = prep.fit_standard(df, ["b"]).transform(prep.fit_median(df, ["a"]).transform(df)).collect()
    assert [r["a"] for r in out] == [1.0, 2.5, 4.0] and all(r["b_scaled"] == 0 for r in out)


def test_unseen_category_raises(spark):
    a = spark.createDataFrame([("x",)], "c string")
    m = prep.fit_label_encoder(a, ["c"])
    with pytest.raises(Exception, match="(?i)unseen"):
        m.transform(spark.createDataFrame([("y",)], "c string")).collect()


def test_nan_becomes_null_and_spec_is_inferred(spark, sf):
    df = nan_to_null(spark.createDataFrame([(float("nan"), "s"), (1.0, "t")], "x double, c string"))
    assert df.filter("x IS NULL").count() == 1
    spec = FeatureSpec.infer(txn(spark, sf), "txn_key", TARGET, FLAGS, LABELS, "ts", ["n1", "n2", "n3", "n4", "bucket", "fold"])
    assert "l_quantity" in spec.numeric and "currency" in spec.categorical and "chg_date" not in spec.numeric


def test_pruned_joins_lose_no_rows(spark, sf):
    full = txn(spark, sf).select("txn_key", "was_exception")
    assert full.exceptAll(txn(spark, sf, ["txn_key", "was_exception"])).count() == 0
    assert full.count() == txn(spark, sf, ["txn_key"]).count()


def test_model_queries_beat_the_base_rate(spark, sf):
    t = catalogue.QUERIES["clf_tree"](spark, sf).first()
    base = txn(spark, sf, [TARGET]).agg(F.avg(TARGET)).first()[0]
    assert t["error"] is None and t["auc"] > 0.6 and t["accuracy"] > max(base, 1 - base) - 0.02


def test_stack_and_chain_run(spark, sf):
    assert catalogue.QUERIES["stack_oof"](spark, sf).first()["auc"] > 0.6
    trace = catalogue.QUERIES["chain_trace"](spark, sf)
    assert trace.count() == txn(spark, sf, ["txn_key"]).count()
