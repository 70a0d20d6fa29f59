"""Rule extraction from models and from the data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.operators import assoc, metrics, models, prep, profile, trees
from breaklens.operators.models import Fitted, fit
from breaklens.operators.rules import Rule, matches, measure, split_points, tree_rules
from breaklens.scale import exact_quantiles


def small_tree(depth: int, leaf: int = 1, features: str = "features") -> DecisionTreeClassifier:
    return DecisionTreeClassifier(
        featuresCol=features, labelCol="label", maxDepth=depth, minInstancesPerNode=leaf, seed=models.SEED
    )


def surrogate(
    scored: DataFrame,
    prob: str,
    names: list[str],
    depth: int = 5,
    leaf: int = 50,
    min_confidence: float = 0.8,
    min_samples: int = 50,
    features: str = "features",
    method: str = "surrogate",
) -> tuple[list[Rule], Fitted]:
    """A tree that mimics P > .5 of a model, and its rules."""
    ready = scored.withColumn("_mimic", (F.col(prob) > 0.5).cast("int"))
    tree = fit(method, small_tree(depth, leaf, features), ready, "_mimic")
    return tree_rules(tree.model, names, scored.sparkSession, min_samples, min_confidence, method), tree


@dataclass(frozen=True)
class Mimic:
    """A surrogate to fit: of which probability, on which vector column (of these names), and which of its rules to keep."""

    prob: str
    names: list[str]
    depth: int
    leaf: int
    min_confidence: float
    features: str = "features"
    method: str = "surrogate"
    min_samples: int = 50


def surrogates(scored: DataFrame, asked: list[Mimic]) -> list[tuple[list[Rule], float]]:
    """Rules and fidelity of several surrogates, whose trees grow in the same scans and answer in one."""
    spark, cols, at, first = scored.sparkSession, [], 0, {}
    arity: dict[int, int] = {}
    for m in asked:
        if m.features not in first:
            first[m.features] = at
            arity |= {at + i: n for i, n in trees.categories(scored, m.features).items()}
            cols.append(vector_to_array(m.features))
            at += len(m.names)
    targets = {m.prob: (F.col(m.prob) > 0.5).cast("int") for m in asked}
    ests = [small_tree(m.depth, m.leaf, m.features) for m in asked]
    rows = trees.Rows.of(scored, F.concat(*cols), arity, targets, ests)
    if rows is None:
        out = []
        for m in asked:
            found, tree = surrogate(scored, m.prob, m.names, m.depth, m.leaf, m.min_confidence, m.min_samples, m.features, m.method)
            out.append((found, fidelity(scored, m.prob, tree)))
        return out
    asks = [trees.Ask(e, m.prob, tuple(range(first[m.features], first[m.features] + len(m.names)))) for e, m in zip(ests, asked)]
    grown = rows.grow(asks)
    found = [tree_rules(rows.model(a, g), m.names, spark, m.min_samples, m.min_confidence, m.method) for m, a, g in zip(asked, asks, grown)]
    return list(zip(found, rows.agreement(asks, grown)))


def fidelity(scored: DataFrame, prob: str, tree: Fitted) -> float:
    """Share of rows where the surrogate agrees with the model."""
    both = tree.score(scored.withColumn("_mimic", (F.col(prob) > 0.5).cast("int")), "_tp", "_th")
    return metrics.fidelity(both, "_mimic", "_th").first()["fidelity"]


def change_rules(df: DataFrame, names: list[str], flags: list[str], label: str, min_rate: float, min_samples: int = 10, min_confidence: float = 0.8) -> list[Rule]:
    """For flags with a high break rate: rules of a depth-2 tree inside the changed rows.

    The flag counts as a condition of its own, so simplicity is scored on all conditions.
    """
    wide = df.agg(
        F.avg(label).alias("base"), *[F.avg(F.when(F.col(c) == 1, F.col(label))).alias(c) for c in flags]
    ).first()
    out = []
    for c in flags:
        if (wide[c] or 0.0) > min_rate:
            tree = fit(c, small_tree(2), df.filter(F.col(c) == 1), label)
            for r in tree_rules(tree.model, names, df.sparkSession, min_samples, min_confidence, "change_rules"):
                out.append(
                    replace(r, conditions=((c, "=", 1.0), *r.conditions), lift=wide[c] / (wide["base"] + 1e-10), name=f"{c}_{r.name}")
                )
    return out


def threshold_rules(
    df: DataFrame, fitted: Fitted, names: list[str], target: str, top: int = 5, first: int = 3, min_support: int = 20, min_confidence: float = 0.6
) -> list[Rule]:
    """'x <= t' rules at the first split values of the most important features, measured in one scan."""
    imp = models.importances(fitted, names)[:top]
    cuts = split_points(fitted.model, names, df.sparkSession)
    cand = [
        Rule(((f, "<=", t),), 1, 0.0, 0, None, "threshold", f"{f}_{i}", {"importance": v})
        for f, v in imp
        for i, t in enumerate(cuts.get(f, [])[:first])
    ]
    found = [r for r in measure(df, cand, target) if r.support > min_support and r.confidence > min_confidence]
    return sorted(found, key=lambda r: (-r.confidence * r.extra["importance"], r.name))


def augmented_rules(
    df: DataFrame, fitted: Fitted, names: list[str], target: str, min_support: int = 10, min_lift: float = 2.0
) -> list[Rule]:
    """'predicted change > t' rules of the final model with a clear lift over the rows without."""
    cuts = split_points(fitted.model, names, df.sparkSession)
    cand = [
        Rule(((f, ">", t),), 1, 0.0, 0, None, "augmented", f"{f}_{i}")
        for f in names
        if f.startswith("predicted_")
        for i, t in enumerate(cuts.get(f, []))
    ]
    if not cand:
        return []
    aggs = [F.count("*").alias("n"), F.sum(target).alias("p")]
    for i, r in enumerate(cand):
        aggs += [F.count_if(matches(r)).alias(f"n{i}"), F.sum(F.when(matches(r), F.col(target)).otherwise(0)).alias(f"p{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, r in enumerate(cand):
        n1, p1 = row[f"n{i}"], row[f"p{i}"]
        n0, p0 = row["n"] - n1, row["p"] - p1
        if n1 > min_support and n0:
            lift = (p1 / n1) / (p0 / n0 + 1e-10)
            if lift > min_lift:
                out.append(replace(r, confidence=p1 / n1, support=n1, lift=lift))
    return sorted(out, key=lambda r: (-r.lift * r.confidence, r.name))


def important_ranges(df: DataFrame, fitted: Fitted, names: list[str], target: str, top_k: int = 10) -> DataFrame:
    """Top features by importance with their typical range on the positives."""
    top = models.importances(fitted, names)[:top_k]
    ranges = profile.percentile_range(df, target, [f for f, _ in top])
    return ranges.join(df.sparkSession.createDataFrame(top, "feature string, importance double"), "feature")


def anchor_rules(
    scored: DataFrame,
    key: str,
    numeric: list[str],
    flags: list[str],
    pred: str,
    features: str = "features",
    clusters: int = 20,
    max_size: int = 5,
    min_precision: float = 0.9,
    min_support: float = 0.01,
) -> DataFrame:
    """Anchors for diverse rows: conjunctions of binned conditions under which the model keeps its answer.

    All candidate conjunctions are mined once, with the model's answer as an item; each cluster's
    representative (the row nearest its centre) then gets the widest precise one that covers it.
    """
    fitted = prep.fit_qcut(scored, numeric, 3)
    answer = F.concat(F.lit("model="), F.col(pred).cast("string"))
    items = prep.qcut_items(scored, fitted, flags, "_conds").withColumn("items", F.concat("_conds", F.array(answer)))
    sets = assoc.frequent_itemsets(items.select("items"), min_support).filter(F.size("itemset") <= max_size + 1)
    with_answer = sets.select(
        F.filter("itemset", lambda x: ~F.startswith(x, F.lit("model="))).alias("conds"),
        F.get(F.filter("itemset", lambda x: F.startswith(x, F.lit("model="))), F.lit(0)).alias("answer"),
        "n",
    )
    joint = with_answer.filter("answer IS NOT NULL AND size(conds) > 0")
    plain = with_answer.filter("answer IS NULL").select("conds", F.col("n").alias("n_conds"))
    anchors = joint.join(plain, "conds").select(
        "conds", "answer", (F.col("n") / F.col("n_conds")).alias("precision"), F.col("n_conds").alias("coverage")
    )
    anchors = anchors.filter(F.col("precision") >= min_precision)

    km = KMeans(k=clusters, seed=models.SEED, featuresCol=features, predictionCol="cluster").fit(scored)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in km.clusterCenters()])
    placed = km.transform(items).withColumn("_x", vector_to_array(features))
    gap = F.aggregate(
        F.zip_with("_x", F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b
    )
    reps = placed.groupBy("cluster").agg(
        F.count("*").alias("cluster_size"),
        F.min(F.struct(gap.alias("gap"), F.col(key), F.col("_conds").alias("conds"), answer.alias("answer"))).alias("r"),
    )
    reps = reps.select("cluster", "cluster_size", F.col(f"r.{key}").alias(key), F.col("r.conds").alias("row_conds"), F.col("r.answer").alias("answer"))
    # equi-join on one condition of the conjunction, then check the rest
    by_item = reps.withColumn("_item", F.explode("row_conds"))
    keyed = anchors.withColumn("_item", F.get("conds", F.lit(0))).withColumnRenamed("answer", "a_answer")
    covering = by_item.join(keyed, "_item").filter(
        (F.col("answer") == F.col("a_answer")) & (F.size(F.array_except("conds", "row_conds")) == 0)
    )
    best = covering.groupBy("cluster").agg(
        F.max(F.struct("coverage", "precision", (-F.size("conds")).alias("simple"), F.array_join("conds", " AND ").alias("rule"))).alias("b")
    )
    return reps.join(best, "cluster", "left").select(
        "cluster", "cluster_size", key, "answer", F.col("b.rule").alias("rule"), F.col("b.precision").alias("precision"), F.col("b.coverage").alias("coverage")
    )


def shared_features(importances: DataFrame, min_share: float = 0.1, min_tasks: int = 2) -> DataFrame:
    """Features with more than `min_share` of the importance in several tasks, widest use first."""
    totals = importances.groupBy("task").agg(F.sum("importance").alias("total"))
    share = importances.join(totals, "task").withColumn("share", F.col("importance") / (F.col("total") + 1e-10))
    out = share.groupBy("feature").agg(
        F.count_if(F.col("share") > min_share).alias("n_tasks"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("share") > min_share, F.col("task")))), ",").alias("tasks"),
        F.avg("share").alias("avg_importance"),
    )
    return out.filter(F.col("n_tasks") >= min_tasks).orderBy(F.desc(F.col("n_tasks") * F.col("avg_importance")), "feature")


def shared_rules(
    df: DataFrame,
    features: dict[str, list[str]],
    percentiles: tuple[float, ...] = (0.25, 0.5, 0.75),
    min_rows: int = 20,
    min_confidence: float = 0.6,
) -> DataFrame:
    """Cuts at which all tasks of a feature agree on the riskier side; features maps name -> tasks.

    One scan counts both sides of every cut for every task.
    """
    q = exact_quantiles(df, list(features), list(percentiles))
    cand = [(f, p, t, ts) for f, ts in features.items() for p, t in zip(percentiles, q[f])]
    aggs, items = [F.count("*").alias("n")], []
    for i, (f, _, t, ts) in enumerate(cand):
        below = F.col(f) <= t
        aggs.append(F.count_if(below).alias(f"n{i}"))
        for y in ts:
            aggs.append(F.sum(F.when(below, F.col(y)).otherwise(0)).alias(f"b{i}_{y}"))
    tasks = sorted({y for ts in features.values() for y in ts})
    aggs += [F.sum(y).alias(f"t_{y}") for y in tasks]
    for i, (f, p, t, ts) in enumerate(cand):
        for y in ts:
            items.append(
                F.struct(
                    F.lit(f).alias("feature"),
                    F.lit(float(p)).alias("percentile"),
                    F.lit(float(t)).alias("threshold"),
                    F.lit(y).alias("task"),
                    F.col(f"n{i}").alias("n_below"),
                    (F.col("n") - F.col(f"n{i}")).alias("n_above"),
                    F.col(f"b{i}_{y}").alias("p_below"),
                    (F.col(f"t_{y}") - F.col(f"b{i}_{y}")).alias("p_above"),
                    (F.col(f"t_{y}") / F.col("n")).alias("base"),
                )
            )
    long = df.agg(*aggs).select(F.inline(F.array(*items)))
    long = long.filter((F.col("n_below") >= min_rows) & (F.col("n_above") >= min_rows))
    low, high = F.col("p_below") / F.col("n_below"), F.col("p_above") / F.col("n_above")
    sided = long.select(
        "feature",
        "percentile",
        "threshold",
        "task",
        "base",
        F.when(low > high, F.lit("<=")).otherwise(F.lit(">")).alias("direction"),
        F.greatest(low, high).alias("confidence"),
    )
    out = sided.groupBy("feature", "percentile", "threshold").agg(
        F.countDistinct("direction").alias("_sides"),
        F.min("direction").alias("direction"),
        F.array_join(F.sort_array(F.collect_list("task")), ",").alias("affects_tasks"),
        F.avg("confidence").alias("avg_confidence"),
        F.max(F.when(F.col("task") == "was_exception", F.col("confidence"))).alias("break_confidence"),
    )
    out = out.filter((F.col("_sides") == 1) & (F.col("avg_confidence") > min_confidence)).drop("_sides")
    return out.withColumn("interpretation", shared_rule_text())


def shared_rule_text():
    """Sentence of a shared rule; rules that include the break are key indicators."""
    tasks = F.split("affects_tasks", ",")
    others = F.array_join(F.filter(tasks, lambda x: x != "was_exception"), ", ")
    head = F.format_string("When %s %s %.2f: ", F.col("feature"), F.col("direction"), F.col("threshold"))
    key = F.concat(
        head,
        F.lit("Predicts changes in: "),
        others,
        F.format_string("; Cash break confidence: %.1f%%", F.col("break_confidence") * 100),
        F.lit("; This is a KEY INDICATOR affecting multiple risk factors"),
    )
    plain = F.concat(head, F.lit("Affects: "), F.array_join(tasks, ", "), F.format_string("; Average confidence: %.1f%%", F.col("avg_confidence") * 100))
    return F.when(F.col("break_confidence").isNotNull() & (F.size(tasks) > 1), key).otherwise(plain)


def interaction_rules(
    scored: DataFrame, probs: list[str], target: str, depth: int = 3, leaf: int = 30, min_support: int = 10, min_synergy: float = 0.1
) -> list[Rule]:
    """Conjunctions of predicted changes whose joint break rate beats every single condition."""
    ready = models.assemble(scored, probs, "_p")
    tree = fit("interaction", small_tree(depth, leaf, "_p"), ready, target)
    found = [r for r in tree_rules(tree.model, probs, scored.sparkSession, 1, 0.0, "interaction") if len(r.conditions) >= 2]
    singles = sorted({c for r in found for c in r.conditions})
    joint = measure(scored, found, target)
    alone = {r.conditions[0]: r.confidence for r in measure(scored, [Rule((c,), 1, 0.0, 0) for c in singles], target)}
    out = []
    for r in joint:
        synergy = r.confidence - max(alone[c] for c in r.conditions)
        if r.support > min_support and synergy > min_synergy:
            out.append(replace(r, extra={"synergy": synergy}))
    return sorted(out, key=lambda r: (-r.extra["synergy"] * r.confidence, r.name))
