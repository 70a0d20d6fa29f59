"""Classifiers, tuning and multi-task models."""

from contextlib import contextmanager
from itertools import product

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from breaklens.operators import decomposed, extratrees, knn, metrics, models, multitask, prep, rules
from breaklens.operators.rules import Rule
from breaklens.plans.parts import rounded
from breaklens.plans.registry import TXN, register
from breaklens.session import pin
from breaklens.sources.tables import txn
from breaklens.spec import FLAGS, LABELS, TARGET

NUMERIC = ["l_quantity", "l_discount", "l_tax", "price_null"]
CATEGORY = ["security_type", "currency"]
TREE_SIZE = 5
ROUNDS = 100  # boosting rounds of an architecture


@contextmanager
def model_data(spark, sf):
    """(train, test, feature names): inputs fitted on the hold-out's training side only.

    The assembled features are kept while the query fits its models; the joined rows only until these stand, so
    that both do not share the memory.
    """
    t = txn(spark, sf, ["txn_key", "bucket", "fold", *NUMERIC, *CATEGORY, *FLAGS, TARGET, *LABELS], heavy=True)
    with models.cached(t):
        inputs = prep.fit_inputs(t.filter("bucket < 80"), NUMERIC, CATEGORY, FLAGS)
        ready = inputs.transform(t).select("txn_key", "bucket", "fold", "features", TARGET, *LABELS).persist()
        try:
            ready.count()
        except Exception:  # noqa: BLE001 - rows that cannot be assembled fail in the fits, whose tables report it
            pass
    try:
        yield ready.filter("bucket < 80"), ready.filter("bucket >= 80"), inputs.names()
    finally:
        ready.unpersist()


def _zoo(names, size=TREE_SIZE):
    return models.estimators(len(names), size=size)


def _one(name):
    def run(spark, sf):
        with model_data(spark, sf) as (train, test, names):
            table, _ = models.train_single_task(train, test, TARGET, {name: _zoo(names)[name]})
            return table

    return run


for _id, _name in {
    "clf_logistic": "logistic_regression",
    "clf_random_forest": "random_forest",
    "clf_svm_linear": "svm_linear",
    "clf_tree": "decision_tree",
    "clf_extra_trees": "extra_trees",
    "clf_ridge": "ridge",
}.items():
    register(_id)(_one(_name))


@register("clf_gbt")
def clf_gbt(spark, sf):
    """The three boosting presets."""
    with model_data(spark, sf) as (train, test, names):
        zoo = {n: _zoo(names)[n] for n in ("gradient_boosting", "xgboost", "lightgbm")}
        return models.train_single_task(train, test, TARGET, zoo)[0]


@register("clf_mlp")
def clf_mlp(spark, sf):
    with model_data(spark, sf) as (train, test, names):
        zoo = {n: _zoo(names)[n] for n in ("neural_small", "neural_large")}
        return models.train_single_task(train, test, TARGET, zoo)[0]


_NB = ["l_quantity", "l_discount", "l_tax"]


@register(
    "clf_naive_bayes",
    f"""WITH {TXN}, s AS (SELECT was_exception AS y, count(*) AS n, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) AS v_{c}' for c in _NB)}
          FROM txn WHERE bucket < 80 GROUP BY 1),
        l AS (SELECT txn_key, y, ln(n) - 0.5*({' + '.join(f'ln(2*pi()*v_{c}) + power({c}-m_{c}, 2)/v_{c}' for c in _NB)}) AS score
              FROM txn, s WHERE bucket >= 80)
        SELECT txn_key, CAST(arg_max(y, score) AS INT) AS pred FROM l GROUP BY 1""",
)
def clf_naive_bayes(spark, sf):
    t = txn(spark, sf, ["txn_key", "bucket", *_NB, TARGET])
    ready = models.assemble(t, _NB)
    nb = models.fit("naive_bayes", _zoo(_NB)["naive_bayes"], ready.filter("bucket < 80"), TARGET)
    return nb.score(ready.filter("bucket >= 80")).select("txn_key", "pred")


# Whole numbers on comparable scales, so that distances are exact.
_POINT = {
    "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice / 2000", "l_discount": "l_discount * 500", "l_tax": "l_tax * 600",
    "o_totalprice": "o_totalprice / 10000", "p_retailprice": "p_retailprice / 40", "p_size": "p_size", "s_acctbal": "s_acctbal / 200",
}
_P = list(_POINT)
_POINTS = f"""{TXN}, p AS (SELECT txn_key, bucket, {', '.join(f'round({e}) AS {c}' for c, e in _POINT.items())}, was_exception FROM txn),
        tr AS (SELECT * FROM p WHERE bucket < 80),
        qs AS (SELECT DISTINCT {', '.join(_P)} FROM p WHERE bucket >= 80)"""


def _near_sql(k: int, gap: str) -> str:
    """(q columns, near): the k nearest training rows of every distinct test row, as a list of (gap, key, y)."""
    return f"""SELECT {', '.join(f'qs.{c}' for c in _P)}, min({{'gap': {gap}, 'key': txn_key, 'y': was_exception}}, {k}) AS near FROM qs, tr GROUP BY ALL"""


def knn_points(spark, sf):
    """Points of all rows, joined once: the search and its result read them again."""
    t = txn(spark, sf, ["txn_key", "bucket", *_P, TARGET])
    return pin(t.withColumns({c: F.round(F.expr(e)) for c, e in _POINT.items()}), "knn-rows")


@register(
    "clf_knn",
    f"""WITH {_POINTS}, n AS ({_near_sql(5, ' + '.join(f'power(qs.{c} - tr.{c}, 2)' for c in _P))}),
        s AS (SELECT {', '.join(_P)}, list_avg(list_transform(near, lambda m: m.y)) AS share FROM n)
        SELECT txn_key, round(share, 6) AS share, CAST(share > 0.5 AS INT) AS pred FROM p JOIN s USING ({', '.join(_P)}) WHERE bucket >= 80""",
)
def clf_knn(spark, sf):
    p = knn_points(spark, sf)
    out = knn.predict(p.filter("bucket < 80"), p.filter("bucket >= 80"), "txn_key", _P, TARGET, 5)
    return rounded(out)


@register(
    "clf_knn_weighted",
    f"""WITH {_POINTS}, n AS ({_near_sql(5, ' + '.join(f'abs(qs.{c} - tr.{c})' for c in _P))}),
        s AS (SELECT {', '.join(_P)}, CASE WHEN near[1].gap = 0 THEN list_avg(list_transform(list_filter(near, lambda m: m.gap = 0), lambda m: m.y))
                ELSE list_sum(list_transform(near, lambda m: m.y / m.gap)) / list_sum(list_transform(near, lambda m: 1 / m.gap)) END AS share FROM n)
        SELECT txn_key, round(share, 6) AS share, CAST(share > 0.5 AS INT) AS pred FROM p JOIN s USING ({', '.join(_P)}) WHERE bucket >= 80""",
)
def clf_knn_weighted(spark, sf):
    """Manhattan distances, nearer rows weigh more."""
    p = knn_points(spark, sf)
    return rounded(knn.predict(p.filter("bucket < 80"), p.filter("bucket >= 80"), "txn_key", _P, TARGET, 5, "manhattan", "distance"))


_GRID_ROWS = ", ".join(
    f"('{m}', {len(list(product(*g.values())))}, '{', '.join(g)}')" for m, g in models.PARAM_GRIDS.items()
)


@register(
    "param_grids",
    f"""WITH {TXN} SELECT model, CAST(points AS INT) AS points, params, (SELECT count(*) FROM txn WHERE bucket < 80) AS train_rows
        FROM (VALUES {_GRID_ROWS}) v(model, points, params)""",
)
def param_grids(spark, sf):
    """Points per grid with the rows each would be trained on."""
    sizes = [(m, len(list(product(*g.values()))), ", ".join(g)) for m, g in models.PARAM_GRIDS.items()]
    n = txn(spark, sf, ["bucket"]).filter("bucket < 80").agg(F.count("*")).scalar()
    return spark.createDataFrame(sizes, "model string, points int, params string").withColumn("train_rows", n)


# Inputs on comparable scales, as the same expression in both engines.
_SCALED = {
    "l_quantity": "l_quantity / 50.0D", "l_extendedprice": "l_extendedprice / 100000.0D", "l_discount": "l_discount * 10.0D",
    "l_tax": "l_tax * 10.0D", "o_totalprice": "o_totalprice / 500000.0D", "p_retailprice": "p_retailprice / 2000.0D",
    "p_size": "p_size / 50.0D", "s_acctbal": "s_acctbal / 10000.0D",
}
_INPUTS = [*_SCALED, *FLAGS]
_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
_SMOOTHINGS = [1e-9, 1e-3, 1e-2, 1e-1]
_N = len(_INPUTS) + 1
_X = ", ".join([*[e.replace("D", "::DOUBLE") for e in _SCALED.values()], *FLAGS])


def _sums(y: str) -> str:
    cells = [["1.0", *[f"x[{i}]" for i in range(1, _N)]], ["1.0", *[f"x[{i}]" for i in range(1, _N)], y]]
    return ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in cells[1]) + "]" for a in cells[0])


_FOLDED = f"""{TXN}, d AS (SELECT fold, was_exception AS y, 2.0::DOUBLE * was_exception - 1 AS z, [{_X}]::DOUBLE[] AS x FROM txn WHERE bucket < 80),
        folds AS (SELECT DISTINCT fold FROM d)"""
_RIDGE = f"""grams AS (SELECT f.fold, [{_sums("z")}] AS m FROM d JOIN folds f ON d.fold <> f.fold GROUP BY f.fold),
        gj(fold, alpha, k, m) AS (
          SELECT fold, alpha, 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = j AND i > 1 THEN v + alpha ELSE v END))
          FROM grams, (SELECT unnest({_ALPHAS}::DOUBLE[]) AS alpha)
          UNION ALL
          SELECT fold, alpha, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k THEN v / m[k][k] ELSE v - r[k] / m[k][k] * m[k][j] END))
          FROM gj WHERE k <= {_N}),
        beta AS (SELECT fold, alpha, list_transform(m, lambda r: r[{_N + 1}]) AS b FROM gj WHERE k = {_N + 1}),
        ridge AS (SELECT alpha, d.fold, avg(CAST(CAST(b[1] + list_inner_product(b[2:], x) > 0 AS INT) = y AS INT)) AS accuracy FROM d JOIN beta USING (fold) GROUP BY ALL)"""
_BAYES = f"""u AS (SELECT fold, y, unnest(x) AS v, unnest(range(1, {_N})) AS i FROM d),
        mo AS (SELECT f.fold, y, i, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM u JOIN folds f ON u.fold <> f.fold GROUP BY ALL),
        most AS (SELECT fold, max(s) AS most FROM (SELECT f.fold, i, var_pop(v) AS s FROM u JOIN folds f ON u.fold <> f.fold GROUP BY ALL) GROUP BY fold),
        pa AS (SELECT fold, smoothing, y, list(m ORDER BY i) AS m, list(s + smoothing * most ORDER BY i) AS s, any_value(n) AS n
               FROM mo JOIN most USING (fold), (SELECT unnest({_SMOOTHINGS}::DOUBLE[]) AS smoothing) GROUP BY ALL),
        lo AS (SELECT d.fold, smoothing, d.y AS truth, p.y, x, ln(n) - 0.5::DOUBLE * list_sum(list_transform(x, lambda v, j: ln(2 * pi() * s[j]) + power(v - m[j], 2) / s[j])) AS score, rid
               FROM (SELECT *, row_number() OVER () AS rid FROM d) d JOIN pa p USING (fold)),
        bayes AS (SELECT smoothing, fold, avg(CAST(pred = truth AS INT)) AS accuracy
                  FROM (SELECT smoothing, fold, rid, truth, CAST(max(score) FILTER (y = 1) > max(score) FILTER (y = 0) AS INT) AS pred FROM lo GROUP BY ALL) GROUP BY ALL)"""


def _level_sql(k: int, nodes: list[int], drawn: int) -> str:
    """One level of a randomised tree over d{k}(txn_key, bucket, y, x, node): ranges, cuts, counts, best cuts, next nodes."""
    width = len(_INPUTS)
    turns = {i: sorted(range(width), key=lambda f: extratrees.draw(models.SEED + 1, 0, i, f))[:drawn] for i in nodes}
    draws = ", ".join(f"({i}, {f + 1}, {extratrees.draw(models.SEED, 0, i, f)!r}::DOUBLE)" for i in nodes for f in turns[i])
    ends = [f"[{', '.join(f'{g}(x[{f}])' for f in range(1, width + 1))}]" for g in ("min", "max")]
    gini = "2 * ({1}) / ({0}) * (1 - ({1}) / ({0}))".format
    gain = f"{gini('n', 'p')} - nl / n * ({gini('nl', 'pl')}) - (n - nl) / n * ({gini('n - nl', 'p - pl')})"
    return f"""r{k} AS (SELECT node, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p, {ends[0]} AS lo, {ends[1]} AS hi FROM d{k} WHERE bucket < 80 GROUP BY node),
        u{k}(node, f, u) AS (VALUES {draws}),
        c{k} AS (SELECT node, f, n, p, lo[f] + u * (hi[f] - lo[f]) AS cut FROM r{k} JOIN u{k} USING (node) WHERE lo[f] < hi[f] AND p > 0 AND p < n),
        l{k} AS (SELECT node, f, cut, n, p, count(*)::DOUBLE AS nl, sum(y)::DOUBLE AS pl FROM d{k} JOIN c{k} USING (node) WHERE bucket < 80 AND x[f] <= cut GROUP BY ALL),
        b{k} AS (SELECT node, f, cut FROM l{k} WHERE nl >= 1 AND n - nl >= 1 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round({gain}, 12) DESC, f, cut) = 1),
        d{k + 1} AS (SELECT txn_key, bucket, y, x, CASE WHEN f IS NULL THEN node ELSE 2 * node + CAST(x[f] > cut AS INT) END AS node FROM d{k} LEFT JOIN b{k} USING (node))"""


@register(
    "extra_tree_levels",
    f"""WITH {TXN}, d0 AS (SELECT txn_key, bucket, was_exception AS y, [{_X}]::DOUBLE[] AS x, 1 AS node FROM txn),
        {_level_sql(0, [1], 3)}, {_level_sql(1, [2, 3], 3)},
        s AS (SELECT node, avg(y) AS share FROM d2 WHERE bucket < 80 GROUP BY node)
        SELECT txn_key, round(share, 6) AS share, CAST(share > 0.5 AS INT) AS pred FROM d2 JOIN s USING (node) WHERE bucket >= 80""",
)
def extra_tree_levels(spark, sf):
    """One extremely randomised tree of two levels, with its shares on the hold-out."""
    # joined once; every level scans the rows twice
    t = pin(txn(spark, sf, ["txn_key", "bucket", *_SCALED, *FLAGS, TARGET]), "tree-input")
    ready = models.assemble(t.withColumns({c: F.expr(e) for c, e in _SCALED.items()}), _INPUTS)
    est = extratrees.ExtraTrees(trees=1, depth=2, features=3, seed=models.SEED)
    tree = models.fit("extra_trees", est, ready.filter("bucket < 80"), TARGET)
    return rounded(tree.score(ready.filter("bucket >= 80"), "share").select("txn_key", "share", "pred"))


def folded_inputs(spark, sf):
    t = txn(spark, sf, ["bucket", "fold", *_SCALED, *FLAGS, TARGET]).where("bucket < 80")
    return decomposed.rows_of(t.withColumns({c: F.expr(e) for c, e in _SCALED.items()}), _INPUTS, TARGET, "fold")


@register(
    "tune_grid",
    f"""WITH RECURSIVE {_FOLDED}, {_RIDGE}, {_BAYES}
        SELECT 'ridge' AS model, alpha AS value, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy FROM ridge GROUP BY alpha
        UNION ALL SELECT 'naive_bayes', smoothing, round(avg(accuracy), 6), round(stddev_pop(accuracy), 6) FROM bayes GROUP BY smoothing""",
)
def tune_grid(spark, sf):
    """Every ridge penalty and naive Bayes smoothing over five folds, from fold-wise sums."""
    rows, width = folded_inputs(spark, sf), len(_INPUTS)
    with models.cached(rows):
        points = decomposed.ridge_grid(rows, width, _ALPHAS).select(F.lit("ridge").alias("model"), F.col("alpha").alias("value"), "accuracy")
        bayes = decomposed.naive_bayes_folds(rows, width, _SMOOTHINGS).select(F.lit("naive_bayes"), "smoothing", "accuracy")
        found = points.union(bayes).groupBy("model", "value").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))
        return found.select("model", "value", F.round("mean", 6).alias("mean_accuracy"), F.round("std", 6).alias("std_accuracy"))


@register("tune_random")
def tune_random(spark, sf):
    with model_data(spark, sf) as (train, _, _):
        est = DecisionTreeClassifier(labelCol="label", seed=models.SEED)
        maps = models.sample_maps(est, models.PARAM_GRIDS["decision_tree"], 2)
        t = train.withColumn("fold_id", F.col("fold") % 3)
        return models.tune(est, maps, t, TARGET, 3, "fold_id")[1]


@register(
    "cv_scores",
    f"""WITH RECURSIVE {_FOLDED}, {_RIDGE}, {_BAYES}, a AS (SELECT 'ridge' AS model, accuracy FROM ridge WHERE alpha = 1 UNION ALL SELECT 'naive_bayes', accuracy FROM bayes WHERE smoothing = 1e-9::DOUBLE)
        SELECT model, round(avg(accuracy), 6) AS mean_cv_score, round(stddev_pop(accuracy), 6) AS std_cv_score FROM a GROUP BY model""",
)
def cv_scores(spark, sf):
    """Five-fold scores of ridge and naive Bayes at their usual parameters."""
    rows, width = folded_inputs(spark, sf), len(_INPUTS)
    with models.cached(rows):
        ridge = decomposed.ridge_grid(rows, width, [1.0]).select(F.lit("ridge").alias("model"), "accuracy")
        bayes = decomposed.naive_bayes_folds(rows, width, [1e-9]).select(F.lit("naive_bayes").alias("model"), "accuracy")
        return rounded(models.cv_summary(ridge.union(bayes)))


@register("train_single_task")
def train_single_task(spark, sf):
    with model_data(spark, sf) as (train, test, names):
        zoo = {n: _zoo(names)[n] for n in ("logistic_regression", "random_forest", "naive_bayes", "decision_tree")}
        return models.train_single_task(train, test, TARGET, zoo)[0]


@register("run_single_analysis")
def run_single_analysis(spark, sf):
    with model_data(spark, sf) as (train, test, names):
        zoo = {n: _zoo(names)[n] for n in ("decision_tree", "naive_bayes")}
        folded = train.withColumn("fold2", F.col("fold") % 2)
        return models.run_single_analysis(folded, test, [TARGET, "fld_coupon"], zoo, 2, "fold2")


def _tree(depth=4):
    return DecisionTreeClassifier(labelCol="label", maxDepth=depth, seed=models.SEED)


@register("train_independent")
def train_independent(spark, sf):
    with model_data(spark, sf) as (train, test, _):
        fitted = multitask.train_independent(train, LABELS, {"decision_tree": _tree()})
        return multitask.field_results(test, fitted, "independent")


@register("train_multilabel")
def train_multilabel(spark, sf):
    with model_data(spark, sf) as (train, test, _):
        fitted = multitask.train_shared(train, LABELS, {"decision_tree": [_tree(2), _tree(4)]})
        return multitask.field_results(test, fitted, "multilabel")


@register("run_multilabel_analysis")
def run_multilabel_analysis(spark, sf):
    with model_data(spark, sf) as (train, test, _):
        a = multitask.field_results(test, multitask.train_independent(train, LABELS, {"decision_tree": _tree()}), "independent")
        b = multitask.field_results(test, multitask.train_shared(train, LABELS, {"logistic_regression": [LogisticRegression(labelCol="label", maxIter=20)]}), "multilabel")
        return metrics.recommend(a.unionByName(b))


@register("importance_matrix")
def importance_matrix(spark, sf):
    with model_data(spark, sf) as (train, _, names):
        return multitask.importance_matrix(train, [TARGET, *LABELS], _tree(), names)


@register("feature_importance")
def feature_importance(spark, sf):
    """Top features of the break model, and means over the field models."""
    m = importance_matrix(spark, sf)
    top = m.filter(F.col("task") == TARGET).orderBy(F.desc("importance"), "feature").limit(15)
    mean = m.filter(F.col("task") != TARGET).groupBy("feature").agg(F.avg("importance").alias("importance"))
    return top.unionByName(mean.select(F.lit("mean over fields").alias("task"), "feature", "importance"))


def oof_fold(train):
    """Two folds for the chains, which the original fits in-sample; the functions take any number."""
    return train.withColumn("oof", F.col("fold") % 2)


@register("stack_oof")
def stack_oof(spark, sf):
    with model_data(spark, sf) as (train, test, names):
        stack = multitask.fit_stack(train, LABELS, TARGET, _tree(), _tree(5), 5, "fold")
        return models.metric_frame(spark, [{"task": TARGET, "model": "stack"} | models.metric_row(stack.score(test), TARGET)])


@register("chain_models")
def chain_models(spark, sf):
    with model_data(spark, sf) as (train, test, names):
        t = oof_fold(train)
        chain = multitask.fit_chain(t, LABELS, TARGET, _tree(), _tree(5), 2, "oof")
        return models.metric_frame(spark, [{"task": TARGET, "model": "chain"} | models.metric_row(chain.score(test), TARGET)])


@register("chain_contributions")
def chain_contributions(spark, sf):
    with model_data(spark, sf) as (train, _, names):
        t = oof_fold(train)
        chain = multitask.fit_chain(t, LABELS, TARGET, _tree(), _tree(5), 2, "oof")
        return multitask.chain_contributions(spark, chain, names)


@register("chain_with_rules")
def chain_with_rules(spark, sf):
    """Chain whose stages also yield their rules, tagged by stage."""
    with model_data(spark, sf) as (train, _, names):
        t = oof_fold(train)
        chain = multitask.fit_chain(t, LABELS, TARGET, _tree(), _tree(5), 2, "oof")
        found = multitask.chain_rules(spark, chain, names, min_samples=50, min_confidence=0.5)
        return rules.rules_frame(spark, found).withColumn("conditions", F.size("conditions"))


@register("hierarchy_models")
def hierarchy_models(spark, sf):
    with model_data(spark, sf) as (train, test, _):
        groups = {"payment_changes": ["fld_factor", "fld_coupon"], "security_changes": ["fld_date"]}
        h = multitask.fit_hierarchy(train, groups, TARGET, _tree(), _tree(2), _tree(5))
        return models.metric_frame(spark, [{"task": TARGET, "model": "hierarchy"} | models.metric_row(h.score(test), TARGET)])


@register("break_then_fields")
def break_then_fields(spark, sf):
    with model_data(spark, sf) as (train, test, _):
        m = multitask.fit_break_then_fields(train, LABELS, TARGET, GBTClassifier(labelCol="label", maxIter=3, maxDepth=3, seed=models.SEED), 3)
        return multitask.field_table(m.score(test), LABELS, "break_then_fields")


@register("hierarchical_levels")
def hierarchical_levels(spark, sf):
    with model_data(spark, sf) as (train, test, _):
        m = multitask.fit_levels(train, LABELS, TARGET, components=3)
        return multitask.field_table(m.score(test), LABELS, "hierarchical")


@register("compare_architectures")
def compare_architectures(spark, sf):
    """Boosting with the break as input against hierarchical levels, on the same split."""
    with model_data(spark, sf) as (train, test, _):
        parts = {
            "gradient_boosting": multitask.fit_break_then_fields(train, LABELS, TARGET, GBTClassifier(labelCol="label", maxIter=ROUNDS, maxDepth=6, stepSize=0.1, seed=models.SEED), ROUNDS),
            "hierarchical": multitask.fit_levels(train, LABELS, TARGET, components=3),
        }
        return multitask.architecture_table(test, parts, LABELS, TARGET)


@register("uncertainty")
def uncertainty(spark, sf):
    with model_data(spark, sf) as (train, test, _):
        return multitask.bootstrap_uncertainty(train, test, "txn_key", TARGET)


@register("rule_model_hybrid")
def rule_model_hybrid(spark, sf):
    """Known patterns by rule, the rest by model."""
    # joined once, for the passes of the fit and for the scores
    t = pin(txn(spark, sf, ["txn_key", "bucket", *FLAGS, TARGET]), "hybrid-input")
    ready = models.assemble(t, FLAGS)
    m = models.fit("decision_tree", _tree(), ready.filter("bucket < 80"), TARGET)
    known = [Rule((("chg_factor", ">", 0.5), ("chg_principal", ">", 0.5)), 1, 0.8, 0, name="factor_and_principal")]
    return multitask.rule_hybrid(m.score(ready.filter("bucket >= 80")), known).select("txn_key", "pred", "rule_name", "hybrid_pred")
