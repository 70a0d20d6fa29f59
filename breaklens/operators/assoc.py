"""Baskets of changes, frequent itemsets and association rules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.functions.text import rule_label, strip_item_suffix
from breaklens.session import pin

BREAK, NO_BREAK = "BREAK_OCCURRED", "NO_BREAK"


def transactions(df: DataFrame, flags: list[str], target: str | None) -> DataFrame:
    """Add `items`: '<flag>_changed' for each set flag, and the outcome when a target is given."""
    parts = [F.when(F.col(c) == 1, F.lit(f"{c}_changed")) for c in flags]
    if target:
        parts.append(F.when(F.col(target) == 1, F.lit(BREAK)).otherwise(F.lit(NO_BREAK)))
    return df.withColumn("items", F.array_compact(F.array(*parts)))


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.01, items: str = "items") -> DataFrame:
    """Sorted itemsets with count and support share, of every length, level by level.

    The baskets are scanned once, into distinct baskets with their counts. Each level extends the frequent
    itemsets inside every distinct basket by one later frequent item, adds up the counts and keeps those that
    reach the support, so work follows the distinct baskets and their frequent subsets, not the rows.
    """
    distinct = baskets.groupBy(F.sort_array(F.array_distinct(items)).alias("rest")).agg(F.count("*").alias("n"))
    weighted = pin(distinct.withColumn("basket", F.monotonically_increasing_id()), "baskets")
    total = weighted.agg(F.sum("n")).first()[0] or 0
    least = F.lit(math.ceil(min_support * total - 1e-9))
    single = weighted.select("basket", "n", F.explode("rest").alias("item"))
    often = single.groupBy("item").agg(F.sum("n").alias("support")).where((F.col("support") >= least) & F.col("item").isNotNull())
    kept = single.join(often.select("item"), "item").groupBy("basket", "n").agg(F.sort_array(F.collect_list("item")).alias("rest"))
    state = kept.select("n", F.array().cast("array<string>").alias("itemset"), "rest")
    levels = [state.select("itemset", "n").limit(0)]
    while True:
        step = state.select("n", "itemset", "rest", F.posexplode("rest").alias("at", "item"))
        grown = pin(step.select("n", F.concat("itemset", F.array("item")).alias("itemset"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest")), "itemset-level")
        counts = pin(grown.groupBy("itemset").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "itemsets")
        levels.append(counts)
        longer = grown.where(F.size("rest") > 0)
        if counts.isEmpty() or longer.isEmpty():
            break
        state = longer.join(counts.select("itemset"), "itemset")
    found = reduce(DataFrame.union, levels)
    return found.select("itemset", "n", (F.col("n") / F.lit(float(total))).alias("support"))


def _subsets(items: Column) -> Column:
    """Non-empty proper subsets of a sorted array (order kept)."""
    empty = F.array(F.array().cast("array<string>"))
    every = F.aggregate(items, empty, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return F.filter(every, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(items)))


def association_rules(
    itemsets: DataFrame,
    min_confidence: float = 0.5,
    min_lift: float = 1.0,
    consequent_has: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Rules for all splits of each itemset into antecedent and consequent, within each `by` group.

    Both parts of a frequent itemset are frequent, so two equi-joins to the itemsets give all measures.
    """
    splits = itemsets.filter(F.size("itemset") > 1).select(
        *by, "itemset", F.col("support"), F.col("n"), F.explode(_subsets(F.col("itemset"))).alias("antecedents")
    )
    splits = splits.withColumn("consequents", F.sort_array(F.array_except("itemset", "antecedents")))
    if consequent_has:
        splits = splits.filter(F.array_contains("consequents", consequent_has))
    ante = itemsets.select(*by, F.col("itemset").alias("antecedents"), F.col("support").alias("antecedent_support"))
    cons = itemsets.select(*by, F.col("itemset").alias("consequents"), F.col("support").alias("consequent_support"))
    s, sa, sc = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    rules = splits.join(ante, [*by, "antecedents"]).join(cons, [*by, "consequents"])
    rules = rules.withColumn("confidence", s / sa).withColumn("lift", s / sa / sc)
    # the tolerance keeps rules that sit exactly on the threshold in exact arithmetic
    rules = rules.filter((F.col("confidence") >= min_confidence - 1e-12) & (F.col("lift") >= min_lift - 1e-12))
    return rules.select(
        *by,
        "antecedents",
        "consequents",
        "antecedent_support",
        "consequent_support",
        "support",
        "n",
        "confidence",
        "lift",
        (s - sa * sc).alias("leverage"),
        F.when(F.col("confidence") >= 1.0, F.lit(float("inf")))
        .otherwise((1 - sc) / (1 - F.col("confidence")))
        .alias("conviction"),
    )


def break_rules(rules: DataFrame) -> DataFrame:
    """Rules whose consequent contains the break, with the changed fields of the antecedent."""
    fields = strip_item_suffix(F.col("antecedents"))
    return rules.filter(F.array_contains("consequents", BREAK)).select(
        "*", fields.alias("antecedent_changes"), F.size(fields).alias("num_changes")
    )


def top_break_predictors(rules: DataFrame, top_n: int = 10) -> DataFrame:
    return (
        break_rules(rules)
        .orderBy(F.desc(F.round("confidence", 12)), F.desc(F.round("lift", 12)), "antecedents", "consequents")
        .limit(top_n)
        .select(
            "antecedent_changes",
            rule_label(F.col("antecedent_changes")).alias("label"),
            "support",
            "confidence",
            "lift",
            "num_changes",
        )
    )


def fold_itemsets(baskets: DataFrame, fold: str, k: int, min_support: float) -> DataFrame:
    """Frequent itemsets of every training part (all rows but one fold), from one mining run.

    An itemset that reaches the support in some training part has at least the count of the
    smallest part in the whole data, so the whole is mined once with that lower bound. The counts
    per fold then come from the distinct baskets, and a training count is the total minus the fold.
    """
    basket_counts = baskets.groupBy("items", fold).agg(F.count("*").alias("n"))
    sizes = basket_counts.groupBy(fold).agg(F.sum("n").alias("fold_rows"))
    n, largest = sizes.agg(F.sum("fold_rows"), F.max("fold_rows")).first()
    # a little lower still, so that rounding inside the miner cannot lose a candidate
    bound = max((min_support * (n - largest) - 1) / n, 1e-9)
    cand = frequent_itemsets(baskets.select("items"), bound).select("itemset", F.col("n").alias("n_all"))
    keyed = cand.select("itemset", F.get("itemset", F.lit(0)).alias("_item"))
    held = (
        basket_counts.select("*", F.explode("items").alias("_item"))
        .join(keyed, "_item")
        .filter(F.size(F.array_except("itemset", "items")) == 0)
        .groupBy("itemset", fold)
        .agg(F.sum("n").alias("n_fold"))
    )
    grid = cand.withColumn(fold, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    part = grid.join(held, ["itemset", fold], "left").join(sizes, fold)
    train = F.col("n_all") - F.coalesce("n_fold", F.lit(0))
    out = part.select(fold, "itemset", train.alias("n"), (train / (F.lit(n).cast("double") - F.col("fold_rows"))).alias("support"))
    return out.filter(F.col("support") >= min_support - 1e-12)


def rule_stability(
    baskets: DataFrame, fold: str, k: int = 5, min_support: float = 0.01, min_confidence: float = 0.5
) -> DataFrame:
    """Break rules of the training part of each fold; folds present and spread of the confidence per rule."""
    sets = fold_itemsets(baskets, fold, k, min_support)
    mined = break_rules(association_rules(sets, min_confidence, by=(fold,)))
    return mined.groupBy("antecedents", "consequents").agg(
        F.count("*").alias("folds"),
        F.avg("confidence").alias("mean_confidence"),
        F.stddev_pop("confidence").alias("std_confidence"),
        F.avg("lift").alias("mean_lift"),
    )
