"""Rules: one schema for all methods, matching as expressions, ranking and extraction from data.

A rule list is a model: it is bounded by its tree depth or top-k, lives on the driver like any other
fitted model, and is applied to the rows as a column expression, with no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breaklens.functions.text import condition_text
from breaklens.scale import exact_quantiles
from breaklens.session import cut_lineage, scratch_path

RULE_SCHEMA = (
    "name string, conditions array<struct<feature:string, op:string, threshold:double>>, "
    "prediction int, confidence double, support bigint, lift double, method string"
)
Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    prediction: int
    confidence: float
    support: int
    lift: float | None = None
    method: str = ""
    name: str = ""
    extra: dict = field(default_factory=dict, compare=False)

    def text(self, digits: int = 3) -> str:
        return " AND ".join(f"{f} {op} {v:.{digits}f}" for f, op, v in self.conditions)


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (r.name, list(r.conditions), int(r.prediction), float(r.confidence), int(r.support), r.lift, r.method)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def condition(c: Condition) -> Column:
    f, op, v = c
    x = F.col(f)
    return {"<=": x <= v, ">": x > v, "<": x < v, ">=": x >= v, "=": x == v}[op]


def matches(rule: Rule) -> Column:
    """True where all conditions hold (an ELSE rule has none)."""
    return reduce(lambda a, b: a & b, [condition(c) for c in rule.conditions], F.lit(True))


def first_match(rules: list[Rule], value) -> Column:
    """value(rule) of the first rule that holds, NULL when none does."""
    return F.coalesce(*[F.when(matches(r), value(r)) for r in rules], F.lit(None))


def all_matches(rules: list[Rule], value) -> Column:
    """Array of value(rule) over all rules that hold."""
    return F.array_compact(F.array(*[F.when(matches(r), value(r)) for r in rules]))


def measure(df: DataFrame, rules: list[Rule], label: str) -> list[Rule]:
    """Support, confidence and lift of every rule on the data, all in one scan."""
    if not rules:
        return []
    aggs = [F.count("*").alias("n"), F.sum(label).alias("pos")]
    for i, r in enumerate(rules):
        aggs += [F.count_if(matches(r)).alias(f"n{i}"), F.sum(F.when(matches(r), F.col(label))).alias(f"p{i}")]
    row = df.agg(*aggs).first()
    base = (row["pos"] or 0) / row["n"] if row["n"] else 0.0
    out = []
    for i, r in enumerate(rules):
        n, p = row[f"n{i}"], row[f"p{i}"] or 0
        conf = p / n if n else 0.0
        out.append(replace(r, confidence=conf, support=n, lift=conf / base if base else None))
    return out


def rule_score(confidence: Column, support: Column, lift: Column, n_conditions: Column) -> Column:
    """Blend of confidence, support, lift and simplicity."""
    return (
        confidence * 0.4
        + F.least(support / 1000.0, F.lit(1.0)) * 0.3
        + F.least(F.coalesce(lift, F.lit(1.0)) / 3.0, F.lit(1.0)) * 0.2
        + 0.1 / (1 + n_conditions)
    )


def rank_and_combine(parts: list[DataFrame]) -> DataFrame:
    """Union of rule tables with a common score, best first."""
    both = reduce(DataFrame.unionByName, parts)
    scored = both.withColumn("score", rule_score(F.col("confidence"), F.col("support"), F.col("lift"), F.size("conditions")))
    return scored.orderBy(F.desc(F.round("score", 12)), "name", condition_text(F.col("conditions")))


def similarity(a: Rule, b: Rule) -> float:
    """Jaccard of the condition sets, thresholds to three digits."""
    x, y = ({(f, op, round(v, 3)) for f, op, v in r.conditions} for r in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def dedup(ranked: list[Rule], limit: float = 0.8) -> list[Rule]:
    """Drop a rule that is too similar to a better one already kept."""
    kept: list[Rule] = []
    for r in ranked:
        if all(similarity(r, k) <= limit for k in kept):
            kept.append(r)
    return kept


def to_rules(df: DataFrame) -> list[Rule]:
    """Rule list of a (bounded) rule table, order kept."""
    return [
        Rule(
            tuple((c["feature"], c["op"], c["threshold"]) for c in r["conditions"]),
            r["prediction"],
            r["confidence"],
            r["support"],
            r["lift"],
            r["method"],
            r["name"],
        )
        for r in df.collect()
    ]


def ops_report(df: DataFrame, top_k: int = 10) -> DataFrame:
    """Top rules of a scored rule table as text, one row each."""
    top = df.orderBy(F.desc(F.round("score", 12)), "name").limit(top_k)
    return top.select(
        "name",
        F.concat(
            F.format_string("(Confidence: %.1f%%) WHEN: ", F.col("confidence") * 100),
            F.when(F.size("conditions") > 0, condition_text(F.col("conditions"))).otherwise("DEFAULT RULE"),
            F.lit(" THEN: Cash Break Likely"),
            F.format_string(" Support: %d historical cases", F.col("support")),
            F.when(
                F.col("lift").isNotNull(), F.format_string(" Lift: %.2fx more likely than baseline", F.col("lift"))
            ).otherwise(""),
            F.concat(F.lit(" Detection Method: "), F.coalesce("method", F.lit("unknown"))),
        ).alias("report"),
    )


# ---- rules from tree models -------------------------------------------------------------------


def node_table(model, spark: SparkSession) -> DataFrame:
    """Nodes of a fitted tree or tree ensemble, read from its saved form."""
    path = scratch_path(spark, "model")
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        return nodes.select("treeID", "nodeData.*")
    return nodes.select(F.lit(0).alias("treeID"), "*")


@dataclass(frozen=True)
class Leaf:
    tree: int
    index: int
    conditions: tuple[Condition, ...]
    stats: tuple[float, ...]
    count: int


def leaves(model, names: list[str], spark: SparkSession) -> list[Leaf]:
    """Leaves of each tree, left to right, with the path from the root and the class weights."""
    rows = node_table(model, spark).collect()
    by_tree: dict[int, dict[int, object]] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    out: list[Leaf] = []
    for tree, nodes in sorted(by_tree.items()):
        stack, index = [(0, ())], 0
        while stack:
            node_id, path = stack.pop()
            node = nodes[node_id]
            if node["leftChild"] < 0:
                out.append(Leaf(tree, index, path, tuple(node["impurityStats"]), node["rawCount"]))
                index += 1
                continue
            name, t = names[node["split"]["featureIndex"]], node["split"]["leftCategoriesOrThreshold"][0]
            stack.append((node["rightChild"], (*path, (name, ">", t))))
            stack.append((node["leftChild"], (*path, (name, "<=", t))))
    return out


def tree_rules(
    model,
    names: list[str],
    spark: SparkSession,
    min_samples: int = 50,
    min_confidence: float = 0.8,
    method: str = "tree",
    classes: tuple[int, ...] = (1,),
) -> list[Rule]:
    """Root-to-leaf paths that are large and pure enough; class counts come from the fitted tree."""
    out = []
    for leaf in leaves(model, names, spark):
        total = sum(leaf.stats)
        if not total or leaf.count < min_samples:
            continue
        for c in classes:
            # a tree fitted on one class only has no counts for the other
            conf = leaf.stats[c] / total if c < len(leaf.stats) else 0.0
            if conf >= min_confidence:
                out.append(Rule(leaf.conditions, c, conf, leaf.count, None, method, f"{method}_{leaf.index}"))
    return sorted(out, key=lambda r: (-r.confidence * r.support, r.name))


def split_points(model, names: list[str], spark: SparkSession) -> dict[str, list[float]]:
    """Distinct thresholds per feature in the order of the trees."""
    nodes = node_table(model, spark).filter("leftChild >= 0").orderBy("treeID", "id")
    out: dict[str, list[float]] = {}
    for r in nodes.select("split").collect():
        name, t = names[r["split"]["featureIndex"]], r["split"]["leftCategoriesOrThreshold"][0]
        if t not in out.setdefault(name, []):
            out[name].append(t)
    return out


def path_ranges(leaf_list: list[Leaf], leaf_col: str, names: list[str]) -> Column:
    """Per feature, the range that all trees' paths of the row agree on, as array of (feature, low, high).

    Each tree contributes a look-up of its leaf's bounds, so the merge is row-wise: no join to the
    paths and no grouping by row.
    """
    trees: dict[int, list[Leaf]] = {}
    for leaf in leaf_list:
        trees.setdefault(leaf.tree, []).append(leaf)
    used = [n for n in names if any(c[0] == n for leaf in leaf_list for c in leaf.conditions)]
    items = []
    for name in used:
        lows, highs = [], []
        for t, group in sorted(trees.items()):
            lo = [max((v for f, op, v in x.conditions if f == name and op == ">"), default=None) for x in group]
            hi = [min((v for f, op, v in x.conditions if f == name and op == "<="), default=None) for x in group]
            at = F.get(F.col(leaf_col), F.lit(t)).cast("int")
            if any(v is not None for v in lo):
                lows.append(F.get(F.array(*[F.lit(v).cast("double") for v in lo]), at))
            if any(v is not None for v in hi):
                highs.append(F.get(F.array(*[F.lit(v).cast("double") for v in hi]), at))
        low = _extreme(F.greatest, lows)
        high = _extreme(F.least, highs)
        items.append(
            F.when(
                low.isNotNull() | high.isNotNull(),
                F.struct(F.lit(name).alias("feature"), low.alias("low"), high.alias("high")),
            )
        )
    return F.array_compact(F.array(*items))


def _extreme(fn, cols: list[Column]) -> Column:
    if not cols:
        return F.lit(None).cast("double")
    return fn(*cols) if len(cols) > 1 else cols[0]


# ---- greedy rule list -------------------------------------------------------------------------


def cut_points(df: DataFrame, features: list[str], n_bins: int = 10) -> dict[str, list[float]]:
    """Candidate cuts per feature: exact inner quantiles, duplicates dropped, the maximum left out."""
    q = exact_quantiles(df, features, [i / n_bins for i in range(1, n_bins)] + [1.0])
    return {f: sorted({v for v in vs[:-1] if v is not None and v < vs[-1]}) for f, vs in q.items()}


def binned_counts(df: DataFrame, cuts: dict[str, list[float]], label: str) -> DataFrame:
    """Rows per combination of bins and label. Bin b means: above b of the feature's cuts."""
    bins = [
        reduce(lambda a, b: a + b, [(F.col(f) > c).cast("int") for c in cs], F.lit(0)).alias(f)
        for f, cs in cuts.items()
    ]
    return df.select(*bins, F.col(label).alias("_y")).groupBy(*cuts, "_y").agg(F.count("*").alias("_n"))


def greedy_rule_list(
    df: DataFrame,
    features: list[str],
    label: str,
    max_rules: int = 10,
    min_support: float = 0.01,
    min_leaf: float = 0.05,
    n_bins: int = 10,
) -> list[Rule]:
    """Ordered list of one-condition rules, the best Gini split of the rows left at each step.

    The data are scanned twice (cuts, bin counts); every round then works on the bin counts.
    """
    cuts = cut_points(df, features, n_bins)
    counts = cut_lineage(binned_counts(df, cuts, label))
    n_all = counts.agg(F.sum("_n")).first()[0] or 0
    rules: list[Rule] = []
    left = counts
    while True:
        per_bin = left.select(
            F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin"), F.col("_n"), F.col("_y")) for f in cuts]))
        )
        rows = per_bin.groupBy("f", "bin").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_y")).alias("p")).collect()
        bins: dict[str, dict[int, tuple[int, int]]] = {}
        for r in rows:
            bins.setdefault(r["f"], {})[r["bin"]] = (r["n"], r["p"])
        n, p = (sum(v[i] for v in next(iter(bins.values()), {}).values()) for i in (0, 1))
        best = None
        if len(rules) < max_rules and n >= n_all * min_support and 0 < p < n:
            leaf = max(int(n * min_leaf), 1)
            for f, cs in cuts.items():
                nl = pl = 0
                for i, c in enumerate(cs):
                    here = bins[f].get(i, (0, 0))
                    nl, pl = nl + here[0], pl + here[1]
                    nr, pr = n - nl, p - pl
                    if nl < leaf or nr < leaf:
                        continue
                    gain = _gini(p, n) - nl / n * _gini(pl, nl) - nr / n * _gini(pr, nr)
                    rank = (-round(gain, 12), f, c)
                    if best is None or rank < best[0]:
                        best = (rank, f, i, c, nl, pl, nr, pr)
        if best is None:
            break
        _, f, i, c, nl, pl, nr, pr = best
        low_side = pl / nl > pr / nr
        conf, support = (pl / nl, nl) if low_side else (pr / nr, nr)
        rules.append(
            Rule(((f, "<=" if low_side else ">", c),), int(conf > 0.5), conf, support, None, "rule_list", f"rule_{len(rules)}")
        )
        left = left.filter(F.col(f) > i if low_side else F.col(f) <= i)
    if n:
        rate = p / n
        pred = int(rate > 0.5)
        rules.append(Rule((), pred, rate if pred else 1 - rate, n, None, "rule_list", f"rule_{len(rules)}"))
    return rules


def _gini(p: int, n: int) -> float:
    return 2 * (p / n) * (1 - p / n)


def predict_rule_list(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Prediction and explanation of the first rule that holds."""

    def text(r: Rule) -> str:
        if not r.conditions:
            return f"Default rule: predict {r.prediction}"
        return f"Rule {r.name.rsplit('_', 1)[-1]}: IF {r.text()} THEN {r.prediction}"

    return df.select(
        "*",
        first_match(rules, lambda r: F.lit(r.prediction)).alias("rule_prediction"),
        first_match(rules, lambda r: F.lit(text(r))).alias("explanation"),
    )


def coverage(df: DataFrame, rule: Rule, label: str) -> DataFrame:
    """Rows and positive rate on both sides of a rule."""
    side = F.when(F.coalesce(matches(rule), F.lit(False)), "covered").otherwise("not_covered")
    return df.groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
