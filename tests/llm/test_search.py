"""Hard negatives and exact top-k against brute force."""

import math

import numpy as np
import pytest

from breaklens.llm import negatives, queries, topk
from breaklens.llm import vectors as V
from tests.oracle import compare, connect

SCHEMA = "vec_id bigint, embedding array<float>, label int"
CLASH = {"row": "1", "id": "2", "vec": "3", "part": "4", "shard": "5", "block": "6", "score": "7", "rank": "8", "known": "9"}


def rows_with_ties(n=400, dims=5, seed=3):
    """Repeated vectors and ids, null and non-finite components, null ids, labels and vectors, unequal lengths."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        vec = [float(x) for x in draw.integers(-6, 7, dims) / 8]
        out.append((i if i % 37 else i // 2, vec, int(draw.integers(0, 4))))
    out += [(n, out[0][1], 0), (20, out[5][1], 1), (None, out[3][1], 2), (None, out[3][1], 2), (n + 1, None, 1), (100, [0.5, 0.25], 1), (200, [], 2)]
    out += [(300, [0.5, None, 0.0, 0.0, 0.0], 1), (400, [math.nan] * dims, 1), (500, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (700, [0.0] * dims, 3), (800, [0.5] * dims, None)]
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in CLASH.items():
        df = df.selectExpr("*", f"{value} AS `{name}`")
    return df


def whole(rows, scale):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in ok]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def best_first(scored):
    return sorted(scored, key=lambda x: (-x[1], x[0] is None, x[0] or 0))


def brute_top(rows, every, k, scale):
    rows, out = whole(rows, scale), []
    for n, (i, v, _) in enumerate(rows):
        if i is not None and i % every == 0:
            found = best_first([(j, dot(v, w)) for m, (j, w, _) in enumerate(rows) if m != n])[:k]
            out += [(i, rank, j, s) for rank, (j, s) in enumerate(found, 1)]
    return sorted(out, key=repr)


def brute_negatives(rows, every, k, most, scale):
    rows = [r for r in rows if r[2] is not None]
    rows = [(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in whole(rows, scale)]
    out = []
    for n, (i, v, y) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(j, dot(v, w), z) for m, (j, w, z) in enumerate(rows) if m != n]
        for p, ps, _ in best_first([s for s in scored if s[2] == y])[:k]:
            fit = [s for s in scored if s[2] != y and 30 * ps <= 100 * s[1] <= 90 * ps]
            out += [(i, p, rank, j, ps, s) for rank, (j, s, _) in enumerate(best_first(fit)[:most], 1)]
    return sorted(out, key=repr)


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_exact_topk"])
def test_matches_sql(spark, sf, name):
    assert compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLE[name]) is None


def test_top_k_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 4)
    rows = rows_with_ties()
    df = V.numbered(frame(spark, rows), 64, "vec_id", "embedding")
    for shard, block in ((7, 3), (1000, 1000)):
        got = collected(topk.top_k(df, df.where("id % 20 = 0"), 6, block, shard))
        assert got == brute_top(rows, 20, 6, 64)


def test_negatives_of_odd_rows(spark):
    rows = rows_with_ties()
    want = brute_negatives(rows, 100, 5, 10, 256)
    assert len(want) > 50
    got = negatives.mined(frame(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert collected(got) == want


def test_negatives_of_small_shards(spark):
    rows = [(i, v, y) for i, v, y in rows_with_ties(seed=5) if y is not None]
    df = V.numbered(frame(spark, rows), 256, "vec_id", "embedding", "label")
    found = [collected(negatives.hard_negatives(df, df.where("id % 50 = 0"), block=b, shard=s)) for b, s in ((2, 9), (500, 500))]
    assert found[0] == found[1] and len(found[0]) > 50


def test_fewer_rows_than_asked_and_no_rows(spark):
    few = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [0.5, 0.5], 2)]
    assert collected(topk.nearest(frame(spark, few))) == brute_top(few, 20, 20, 64)
    assert collected(negatives.mined(frame(spark, few))) == brute_negatives(few, 100, 5, 10, 256)
    for rows in ([], [(1, None, None)], [(3, [0.5], 1)]):
        assert topk.nearest(frame(spark, rows)).collect() == [] == negatives.mined(frame(spark, rows)).collect()


def test_tree_leaves_are_pruned_and_exact():
    draw = np.random.default_rng(1)
    centres = draw.integers(-1000, 1000, (30, 3))
    values = np.repeat(centres, 200, axis=0) + draw.integers(-5, 6, (6000, 3))
    order, tree = topk.build(values)
    assert sorted(order.tolist()) == list(range(6000))
    shard = topk.Shard(V.packed(vec=values[order], row=order, id=order, null=np.zeros(6000, bool), **tree))
    asked = np.arange(0, 6000, 300)
    q, at, score = shard.search(values[asked], asked, 10, np.full(len(asked), topk.LEAST))
    leaves = int((tree["left"] == 0).sum())
    assert shard.scored < 0.4 * leaves * len(asked)
    for n, row in enumerate(asked.tolist()):
        products = values @ values[row]
        want = sorted((-int(s), i) for i, s in enumerate(products.tolist()) if i != row)[:10]
        assert [(-int(s), int(shard.row[a])) for a, s in zip(at[q == n], score[q == n])] == want


def test_equal_vectors_split_into_leaves():
    values = np.ones((5000, 4), np.int64)
    _, tree = topk.build(values)
    assert (tree["end"] - tree["start"])[tree["left"] == 0].max() <= topk.LEAF


def test_threshold_stops_early():
    draw = np.random.default_rng(2)
    values = draw.integers(-1000, 1000, (4000, 3))
    arrays = dict(vec=values, row=np.arange(4000), id=np.arange(4000), null=np.zeros(4000, bool), label=np.zeros(4000, int))
    lists = negatives.Lists(V.packed(**arrays, order=np.argsort(values, axis=0, kind="stable").T.copy()))
    anchor = np.array([5, 0, -7])
    at, score = lists.search(anchor, np.ones(4000, bool), [(negatives.LEAST, negatives.MOST)], 10)[0]
    want = np.sort(values @ anchor)[::-1][:10]
    assert score.tolist() == want.tolist() and (values[at] @ anchor).tolist() == want.tolist()
    assert lists.seen_rows < 2000


def test_products_of_large_numbers_are_exact():
    values = np.array([[2**40, 3], [-(2**40), 5]])
    query = np.array([[2**20, 7]])
    assert V.Products(values).of(query).tolist() == [[2**60 + 21, -(2**60) + 35]]
    with pytest.raises(OverflowError):
        V.Products(values).of(np.array([[2**30, 0]]))
