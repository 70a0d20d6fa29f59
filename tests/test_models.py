"""Nearest neighbours, randomised trees, decomposed validation, rule sets and streams against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breaklens.operators import decomposed, extratrees, knn, models, multitask, rules, ruleset
from breaklens.operators.rules import Rule
from breaklens.plans import catalogue

SCHEMA = "id long, a double, b double, c double, y int"


def brute_share(train, query, k, metric, weights):
    def gap(t):
        steps = [abs(t[j] - query[j]) for j in (1, 2, 3)]
        return math.sqrt(sum(s * s for s in steps)) if metric == "euclidean" else sum(steps)

    near = sorted((gap(t), t[0], t[4]) for t in train)[:k]
    if weights == "uniform":
        return sum(y for _, _, y in near) / len(near)
    if near[0][0] == 0:
        same = [y for g, _, y in near if g == 0]
        return sum(same) / len(same)
    return sum(y / g for g, _, y in near) / sum(1 / g for g, _, _ in near)


def points(n, first, rnd, kind):
    out = []
    for i in range(n):
        centre = rnd.choice([0, 0, 0, 40, 1000]) if kind == "clusters" else 0
        row = (first + i, *[float(centre + rnd.randint(0, 9)) for _ in range(3)], rnd.randint(0, 1))
        out.append((row[0], 3.0, 3.0, 3.0, row[4]) if kind == "copies" and i % 3 else row)
    return out


@pytest.mark.parametrize("kind,metric,weights", [("clusters", "euclidean", "distance"), ("copies", "manhattan", "distance"), ("clusters", "manhattan", "uniform")])
def test_neighbours_over_small_cells(spark, monkeypatch, kind, metric, weights):
    monkeypatch.setattr(knn, "CELL", 8)
    monkeypatch.setattr(knn, "VISITS", 16)
    rnd = random.Random(4)
    train, test = points(300, 0, rnd, kind), points(60, 1000, rnd, kind) + [(5000, -900.0, 4.0, 2.5, 0)]
    out = knn.predict(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA), "id", ["a", "b", "c"], "y", 5, metric, weights)
    got = {r["id"]: r["share"] for r in out.collect()}
    assert len(got) == len(test)
    for q in test:
        assert math.isclose(got[q[0]], brute_share(train, q, 5, metric, weights), abs_tol=1e-12), q


def test_options_and_few_rows(spark):
    rnd = random.Random(5)
    train, test = points(40, 0, rnd, "clusters"), points(12, 100, rnd, "clusters")
    df = [spark.createDataFrame(x, SCHEMA) for x in (train, test)]
    scores = knn.option_scores(*df, "id", ["a", "b", "c"], "y", [1, 3])
    got = {(r["metric"], r["weights"], r["k"]): r["hits"] for r in scores.collect()}
    assert len(got) == 8
    for (metric, weights, k), hits in got.items():
        assert hits == sum((brute_share(train, q, k, metric, weights) > 0.5) == q[4] for q in test)
    few = knn.neighbours(df[0].limit(2), df[1], "id", ["a", "b", "c"], "y", 5)
    assert few.count() == 2 * len(test)


def test_candidates_follow_the_queries(monkeypatch):
    """Rows compared per query hardly grow when rows and queries grow eightfold."""
    monkeypatch.setattr(knn, "CELL", 32)
    per_query = []
    for n in (4000, 32000):
        draw = np.random.default_rng(1)
        rows, asked = draw.random((n, 2)), draw.random((200, 2))
        pivots = knn.farthest(rows[: 16 * int(np.sqrt(n) / 4)], int(np.sqrt(n) / 4), "euclidean")
        dist = np.sqrt(knn.gaps(rows, pivots, "euclidean"))
        own, near = dist.argmin(axis=1), dist.min(axis=1)
        low, high, size = (np.array([f(near[own == p]) for p in range(len(pivots))]) for f in (np.min, np.max, len))
        rings = np.maximum(1, np.ceil(size / 32)).astype(int)
        index = knn.Index("euclidean", pivots, low, high, np.where(high > low, (high - low) / rings, 1.0), rings, size.astype(float))
        cell = index.ring(own, near)
        counts = {(p, r): int(((own == p) & (cell == r)).sum()) for p in range(len(pivots)) for r in range(rings[p])}
        gap = np.sqrt(knn.gaps(asked, rows, "euclidean"))
        kth = np.sort(gap, axis=1)[:, 4]
        q, p, r = index.visits(asked, kth, 5)
        seen = set(zip(q.tolist(), p.tolist(), r.tolist()))
        for i in range(len(asked)):  # no row within reach is missed
            assert all((i, int(own[j]), int(cell[j])) in seen for j in np.flatnonzero(gap[i] <= kth[i]))
        per_query.append(sum(counts[(b, c)] for _, b, c in seen) / len(asked))
    assert per_query[1] < 2 * per_query[0]


def fold_rows(n=400, width=3):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(n, width))
    y = ((x[:, 0] - x[:, 1] + draw.normal(size=n)) > 0.3).astype(int)
    return x, y, np.arange(n) % 4


def test_ridge_and_naive_bayes_folds_equal_refits(spark):
    x, y, fold = fold_rows()
    rows = spark.createDataFrame([(int(f), int(t), [float(v) for v in r]) for f, t, r in zip(fold, y, x)], "fold int, label int, x array<double>")
    ridge = {(r["alpha"], r["fold"]): r["accuracy"] for r in decomposed.ridge_grid(rows, 3, [0.5, 50.0]).collect()}
    bayes = {r["fold"]: r["accuracy"] for r in decomposed.naive_bayes_folds(rows, 3).collect()}
    assert len(ridge) == 8 and len(bayes) == 4
    for f in range(4):
        a, b, out, truth = x[fold != f], y[fold != f], x[fold == f], y[fold == f]
        for alpha in (0.5, 50.0):
            centre, z = a.mean(axis=0), 2.0 * b - 1
            w = np.linalg.solve((a - centre).T @ (a - centre) + alpha * np.eye(3), (a - centre).T @ (z - z.mean()))
            pred = (out - centre) @ w + z.mean() > 0
            assert math.isclose(ridge[(alpha, f)], (pred == truth).mean())
        logs = []
        for c in (0, 1):
            part = a[b == c]
            logs.append(np.log(len(part)) - 0.5 * (np.log(2 * np.pi * part.var(axis=0)) + (out - part.mean(axis=0)) ** 2 / part.var(axis=0)).sum(axis=1))
        assert math.isclose(bayes[f], ((logs[1] > logs[0]) == truth).mean())


def labelled(spark, n=1500):
    draw = np.random.default_rng(8)
    x = draw.random((n, 4))
    y = (x[:, 0] + 0.5 * (x[:, 1] > 0.5) + 0.1 * draw.normal(size=n) > 0.8).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y int")
    return models.assemble(df, ["a", "b", "c", "d"]), max(y.mean(), 1 - y.mean())


def test_extra_trees_do_not_depend_on_the_partitioning(spark):
    df, base = labelled(spark)
    train, test = df.where("id % 4 != 0"), df.where("id % 4 = 0")
    est = extratrees.ExtraTrees(trees=12, depth=5)
    one, two = (models.fit("extra_trees", est, train.repartition(n), "y") for n in (2, 7))
    for a, b in zip(one.model.grown, two.model.grown):
        assert a.feature == b.feature and a.cut == b.cut and a.rows == b.rows
    assert len({tuple(sorted(t.feature.items())) for t in one.model.grown}) > 6
    assert models.metric_row(one.score(test), "y")["accuracy"] > base + 0.15
    shares = one.model.featureImportances
    assert math.isclose(shares.sum(), 1) and shares.argmax() == 0
    for t in one.model.grown:  # children hold their parent's rows
        assert all(t.rows[i] == t.rows[2 * i] + t.rows[2 * i + 1] for i in t.feature)


def test_uncertainty_does_not_depend_on_the_partitioning(spark):
    df, _ = labelled(spark, 600)
    got = []
    for n in (1, 5):
        out = multitask.bootstrap_uncertainty(df.where("id % 3 > 0").repartition(n), df.where("id % 3 = 0"), "id", "y", 15, 4)
        got.append({r["id"]: (round(r["mean_prob"], 9), round(r["std_prob"], 9)) for r in out.collect()})
    assert got[0] == got[1] and max(s for _, s in got[0].values()) > 0.05
    counts = np.concatenate([extratrees.weights(np.arange(2000), 42, t) for t in range(5)])
    assert abs(counts.mean() - 1) < 0.05 and abs((counts == 0).mean() - math.exp(-1)) < 0.02


@pytest.mark.parametrize("limit", [0.3, 0.5, 0.8])
def test_rule_choice_equals_the_greedy_list(spark, limit):
    rnd = random.Random(6)
    ranked = []
    for i in range(120):
        conditions = tuple(sorted((f, "<=", float(rnd.randint(0, 1))) for f in rnd.sample("abcdefgh", rnd.randint(0, 7))))
        ranked.append(Rule(conditions, 1, round(rnd.random(), 3), 10, 1.0, "m", f"r{i:03d}"))
    table = rules.rules_frame(spark, ranked).withColumn("score", F.col("confidence"))
    kept = {r["name"] for r in ruleset.deduplicate(table, limit).collect()}
    best_first = sorted(ranked, key=lambda r: (-r.confidence, r.name))
    assert kept == {r.name for r in rules.dedup(best_first, limit)}


def test_conjunctions_are_measured_on_all_rows(spark):
    rows = [(i % 2, i % 3 // 2, int(i % 5 == 0), 3) for i in range(60)]
    sig = spark.createDataFrame(rows, "f int, g int, y int, n long")
    got = {r["name"]: (r["support"], round(r["confidence"], 9)) for r in ruleset.conjunction_rules(sig, ["f", "g"], "y", 1).collect()}
    for name, (support, confidence) in got.items():
        want = [r for r in rows if all(r["fg".index(c[0])] == int(c[-1]) for c in name.split(" AND "))]
        assert support == 3 * len(want) and math.isclose(confidence, sum(r[2] for r in want) / len(want), abs_tol=1e-9)
    assert len(got) == 8


@pytest.mark.parametrize("name", ["stream_break_rate", "stream_monitor_predictions"])
def test_streams_hold_every_event(spark, sf, name):
    n = catalogue.QUERIES[name](spark, sf).agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("metric,scale", [("euclidean", 1), ("manhattan", 1), ("euclidean", 0.37)])
def test_queries_visit_few_boxes(spark, monkeypatch, metric, scale):
    """The boxes are large: visits that are shuffled stay a small multiple of the queries, and the result is exact."""
    monkeypatch.setattr(knn, "CELL", 400)
    monkeypatch.setattr(knn, "VISITS", 300)
    monkeypatch.setattr(knn, "LEAF", 16)
    draw = np.random.default_rng(7)
    x = draw.integers(0, 50, (6600, 8)) * scale
    x[:, 0] = x[:, 0] // 5 * 5
    schema = f"id long, {', '.join(f'c{i} double' for i in range(8))}, y int"
    df = spark.createDataFrame([(i, *map(float, r), i % 2) for i, r in enumerate(x)], schema)
    train, test = df.where("id < 6000"), df.where("id >= 6000")
    steps = {}
    pin = knn.pin

    def counted(frame, name):
        out = pin(frame, name)
        steps[name] = steps.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(knn, "pin", counted)
    out = knn.neighbours(train, test, "id", [f"c{i}" for i in range(8)], "y", 5, metric)
    got = {}
    for r in out.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["near_key"])
    gap = knn.gaps(x[6000:], x[:6000], metric)
    assert got == {6000 + i: np.lexsort((np.arange(6000), g))[:5].tolist() for i, g in enumerate(gap)}
    assert steps["knn-visits"] < 12 * 600


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind,most,work", [("int8", 127, ("float32", "int16")), ("int16", 32767, ("float64", "int32")), ("float64", 99, ("float64", "float64"))])
def test_whole_numbers_are_compared_in_short_types(monkeypatch, metric, kind, most, work):
    """Gaps of bytes are counted in short integers, up to the largest gap there is, and are those of doubles."""
    monkeypatch.setattr(knn, "LEAF", 16)
    draw = np.random.default_rng(5)
    rows, asked = (np.vstack([draw.integers(-most, most + 1, (n, 8)), np.full((1, 8), e)]).astype(kind) for n, e in ((400, -most), (50, most)))
    rows[:40] = rows[40:80] // 2
    assert knn._work(kind, 8, metric) == work[metric == "manhattan"]
    leaves = knn.Leaves(rows, metric, knn._work(kind, 8, metric))
    gap = knn.gaps(asked.astype(float), rows.astype(float), metric)
    want = [np.lexsort((np.arange(len(rows)), g))[:5] for g in gap]
    for reach in (np.full(len(asked), np.inf), np.sort(gap, axis=1)[:, 4], np.sort(gap, axis=1)[:, 0]):
        q, p, found = leaves.nearest(asked, reach, 5)
        for i, near in enumerate(want):
            near = near[gap[i, near] <= reach[i]]
            assert p[q == i].tolist() == near.tolist() and found[q == i].tolist() == gap[i, near].tolist()
    far = knn.Leaves(rows[-1:], metric, knn._work(kind, 8, metric))
    assert far.nearest(asked[-1:], np.full(1, np.inf), 5)[2].tolist() == [gap[-1, -1]]


def test_types_hold_the_largest_gap():
    assert knn._work("int8", 129, "manhattan") == "int16" and knn._work("int8", 130, "manhattan") == "int32"
    assert knn._work("int8", 260, "euclidean") == "float32" and knn._work("int8", 261, "euclidean") == "float64"
    assert knn._work("int16", 32769, "manhattan") == "int32" and knn._work("int16", 32770, "manhattan") == "float64"


def test_many_rows_make_larger_boxes(spark, monkeypatch):
    """Boxes grow with the rows up to a bound, so that a query visits fewer of them; the result is exact."""
    monkeypatch.setattr(knn, "CELL", 32)
    monkeypatch.setattr(knn, "VISITS", 64)
    monkeypatch.setattr(knn, "LEAF", 8)
    monkeypatch.setattr(knn, "MANY", 40)
    assert [knn.widened(n) for n in (0, 1280, 2560, 10**9)] == [1, 1, 2, 4]
    x = np.random.default_rng(8).integers(0, 50, (4200, 4))
    df = spark.createDataFrame([(i, *map(float, r), i % 2) for i, r in enumerate(x)], "id long, a double, b double, c double, d double, y int")
    counts, fit = [], knn.fit_boxes
    monkeypatch.setattr(knn, "fit_boxes", lambda *args: counts.append(fit(*args)) or counts[-1])
    out = knn.neighbours(df.where("id < 4000"), df.where("id >= 4000"), "id", ["a", "b", "c", "d"], "y", 5, "manhattan")
    got = {}
    for r in out.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["near_key"])
    gap = knn.gaps(x[4000:], x[:4000], "manhattan")
    assert got == {4000 + i: np.lexsort((np.arange(4000), g))[:5].tolist() for i, g in enumerate(gap)}
    assert counts[0].count <= 4000 / 32 / 3
