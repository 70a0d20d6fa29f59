"""Evaluation metrics. Rows are reduced to counts in one scan; nothing is shuffled per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.functions.bands import model_complexity, model_type
from breaklens.scale import bucket_count, prefix_aggregate, value_buckets


def confusion(df: DataFrame, pairs: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """tp, fp, fn, tn per named (label, prediction) pair, all from one wide aggregate."""
    aggs, items = [], []
    for name, (y, yhat) in pairs.items():
        yc, hc = F.col(y), F.col(yhat) if isinstance(yhat, str) else yhat
        for cell, (a, b) in {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}.items():
            aggs.append(F.count_if((yc == a) & (hc == b)).alias(f"{name}__{cell}"))
        items.append(
            F.struct(F.lit(name).alias("field"), *[F.col(f"`{name}__{c}`").alias(c) for c in ("tp", "fp", "fn", "tn")])
        )
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def with_scores(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F1 from tp, fp, fn, tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def div(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        "*",
        div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        div(tp, tp + fp).alias("precision"),
        div(tp, tp + fn).alias("recall"),
        div(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per-class precision, recall, F1 and support, with macro and weighted averages."""
    cells = df.groupBy(y, yhat).agg(F.count("*").alias("n"))
    long = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col(y).alias("label"),
                    F.col("n").alias("actual"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col(y) == F.col(yhat), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col(yhat).alias("label"),
                    F.lit(0).cast("bigint").alias("actual"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        )
    )
    classes = long.groupBy("label").agg(F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))

    def div(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    per = classes.select(
        F.col("label").cast("string").alias("label"),
        div(F.col("hit"), F.col("predicted")).alias("precision"),
        div(F.col("hit"), F.col("support")).alias("recall"),
        div(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1_score"),
        "support",
    )
    scores = ["precision", "recall", "f1_score"]
    macro = per.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("label"),
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores],
        F.sum("support").alias("support"),
    )
    return per.unionByName(macro).unionByName(weighted)


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Exact ROC AUC with ties counted half.

    Equal scores are merged first, so a popular score is one row; the running count of negatives then
    goes bucket by bucket over the score range.
    """
    by_score = df.groupBy(score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    tagged = value_buckets(by_score, score, bucket_count(df.sparkSession))
    ranked = prefix_aggregate(tagged, [], [F.col(score)], "_bucket", {"neg_to": ("sum", F.col("neg"))})
    return ranked.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.try_divide(
            F.sum(F.col("pos") * (F.col("neg_to") - F.col("neg") + F.col("neg") / 2.0)),
            F.sum("pos").cast("double") * F.sum("neg").cast("double"),
        ).alias("auc"),
    )


def precision_at_recall(df: DataFrame, y: str, score: str, levels: list[float]) -> DataFrame:
    """Best precision at each recall level or above, and the false alarms it costs."""
    by_score = df.groupBy(score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    tagged = value_buckets(by_score.withColumn("_neg_score", -F.col(score)), "_neg_score", bucket_count(df.sparkSession))
    curve = prefix_aggregate(
        tagged,
        [],
        [F.col("_neg_score")],
        "_bucket",
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
    )
    total = df.agg(F.count_if(F.col(y) == 1)).scalar()
    points = curve.select(
        F.col(score).alias("threshold"),
        "fp",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / total).alias("recall"),
    )
    aggs = []
    for i, lv in enumerate(levels):
        ok = F.col("recall") >= lv
        best = F.struct(F.round("precision", 12).alias("prec"), (-F.col("fp")).alias("nfp"), "threshold")
        aggs.append(F.max(F.when(ok, best)).alias(f"b{i}"))
    items = [
        F.struct(
            F.lit(lv).alias("recall_level"),
            F.col(f"b{i}")["prec"].alias("precision"),
            (-F.col(f"b{i}")["nfp"]).alias("false_alarms"),
            F.col(f"b{i}")["threshold"].alias("threshold"),
        )
        for i, lv in enumerate(levels)
    ]
    return points.agg(*aggs).select(F.inline(F.array(*items)))


def _row_sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def multilabel(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Hamming loss, exact-match share and sample Jaccard (empty union counts 0) in one scan."""
    k = len(pairs)
    wrong = _row_sum([(F.col(y) != F.col(h)).cast("int") for y, h in pairs])
    inter = _row_sum([F.col(y) * F.col(h) for y, h in pairs])
    union = _row_sum([F.greatest(y, h) for y, h in pairs])
    return df.agg(
        (F.sum(wrong) / (F.count("*") * float(k))).alias("hamming_loss"),
        F.avg((wrong == 0).cast("double")).alias("exact_match_ratio"),
        F.avg(F.coalesce(F.try_divide(inter.cast("double"), union.cast("double")), F.lit(0.0))).alias("jaccard_score"),
    )


def macro(field_scores: DataFrame) -> DataFrame:
    """Unweighted means over fields."""
    return field_scores.agg(
        *[
            F.avg(c).alias(f"macro_{n}")
            for c, n in (("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"), ("f1_score", "f1"))
        ]
    )


def fidelity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows where a surrogate agrees with its model."""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("fidelity"))


def results_long(df: DataFrame, runs: dict[tuple[str, str], dict[str, tuple[str, Column | str]]]) -> DataFrame:
    """Result registry: (approach, model, field, metrics) for all runs from one scan."""
    flat = {f"{a}|{m}|{f}": p for (a, m), fields in runs.items() for f, p in fields.items()}
    scored = with_scores(confusion(df, flat))
    parts = F.split("field", r"\|")
    return scored.select(
        parts[0].alias("approach"),
        parts[1].alias("model"),
        parts[2].alias("field"),
        "accuracy",
        "precision",
        "recall",
        "f1_score",
    )


def compare_models(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Model table with type and complexity class, best first."""
    out = results.select(
        "model",
        F.col(metric).alias("performance"),
        model_type(F.col("model")).alias("type"),
        model_complexity(F.col("model")).alias("complexity"),
    )
    return out.orderBy(F.desc("performance"), "model")


def group_mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.count("*").alias("n"))


def approach_table(results: DataFrame) -> DataFrame:
    """Approach x model with macro scores over fields, best macro F1 first."""
    out = results.groupBy("approach", "model").agg(
        F.avg("accuracy").alias("macro_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1_score").alias("macro_f1"),
    )
    return out.orderBy(F.desc("macro_f1"), "approach", "model")


def best_per_approach(table: DataFrame) -> DataFrame:
    """Best macro-F1 model of each approach; ties go to the first name."""
    best = table.groupBy("approach").agg(
        F.min(F.struct((-F.round("macro_f1", 12)).alias("k"), F.col("model"), F.col("macro_f1"))).alias("b")
    )
    return best.select("approach", F.col("b.model").alias("model"), F.col("b.macro_f1").alias("macro_f1"))


def argmax_per_group(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The row with the highest value in each group (lowest `tie` among equals), without a window."""
    rest = [c for c in df.columns if c not in (group, tie)]
    best = df.groupBy(group).agg(
        F.min(F.struct((-F.round(value, 12)).alias("_k"), F.col(tie), *[F.col(c) for c in rest])).alias("_b")
    )
    return best.select(group, F.col(f"_b.{tie}").alias(tie), *[F.col(f"_b.{c}").alias(c) for c in rest])


def best_field_models(results: DataFrame) -> DataFrame:
    """Field scores of the best model of each approach."""
    best = best_per_approach(approach_table(results)).select("approach", "model")
    return results.join(best, ["approach", "model"], "left_semi")


def recommend(results: DataFrame) -> DataFrame:
    """Best model overall, best per approach and approach means as (section, approach, model, macro_f1)."""
    table = approach_table(results)
    best = best_per_approach(table)
    overall = best.orderBy(F.desc("macro_f1"), "approach").limit(1)
    means = table.groupBy("approach").agg(F.avg("macro_f1").alias("macro_f1"))
    return (
        overall.select(F.lit("best overall").alias("section"), "approach", "model", "macro_f1")
        .unionByName(best.select(F.lit("best of approach").alias("section"), "approach", "model", "macro_f1"))
        .unionByName(means.select(F.lit("approach mean").alias("section"), "approach", F.lit("").alias("model"), "macro_f1"))
    )


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float, by: list[str] | None = None) -> DataFrame:
    """Counts per equal-width bin 1..bins; the upper edge belongs to the last bin."""
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)) + 1, F.lit(bins))
    return df.groupBy(*(by or []), b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def root_cause_accuracy(causes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Share of explained rows whose top cause really changed; labels are long (key, field, changed)."""
    hit = causes.join(labels, (causes[key] == labels[key]) & (causes["cause"] == labels["field"]))
    return hit.agg(F.count("*").alias("n_explained"), F.avg(F.col("changed").cast("double")).alias("accuracy"))


def weighted_loss(df: DataFrame, tasks: dict[str, tuple[str, str, float]], eps: float = 1e-7) -> DataFrame:
    """Binary cross-entropy per task (label, probability, weight) and the weighted sum, in one scan."""
    losses = []
    for name, (y, p, _) in tasks.items():
        q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
        losses.append((-F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias(name))
    wide = df.agg(*losses)
    total = _row_sum([F.col(n) * w for n, (_, _, w) in tasks.items()])
    return wide.select(*tasks, total.alias("total_loss"))
