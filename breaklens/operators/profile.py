"""Base rates, label structure, break profiles and data checks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.scale import exact_quantiles


def base_rates(sig: DataFrame, flags: list[str], target: str) -> DataFrame:
    """Rows, breaks, break rate, and the change rate of each flag."""
    n = F.col("n")
    wide = sig.agg(
        F.sum("n").alias("rows"), F.sum(n * F.col(target)).alias("hits"), *[F.sum(n * F.col(c)).alias(c) for c in flags]
    )
    items = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col("rows"), F.col(c if c != target else "hits").alias("positives"))
            for c in [target, *flags]
        ]
    )
    return wide.select(F.inline(items)).withColumn("rate", F.col("positives") / F.col("rows"))


def phi(cells: DataFrame) -> Column:
    """Pearson correlation of two 0/1 columns from their 2x2 cells."""
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    den = F.sqrt(n11 + n10) * F.sqrt(n01 + n00) * F.sqrt(n11 + n01) * F.sqrt(n10 + n00)
    return F.try_divide(n11 * n00 - n10 * n01, den)


def label_corr_matrix(df: DataFrame, labels: list[str]) -> DataFrame:
    """Pearson correlation of every label pair (long form, both orders and the diagonal)."""
    wide = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in combinations(labels, 2)])
    items = [
        F.struct(
            F.lit(a).alias("field_1"),
            F.lit(b).alias("field_2"),
            (F.lit(1.0) if a == b else F.col("__".join(sorted((a, b), key=labels.index)))).alias("correlation"),
        )
        for a in labels
        for b in labels
    ]
    return wide.select(F.inline(F.array(*items)))


def label_combinations(df: DataFrame, labels: list[str], top: int = 10) -> DataFrame:
    """Most frequent label vectors with their share and active names."""
    counts = df.groupBy(*labels).agg(F.count("*").alias("n"))
    active = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in labels])), "|")
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.select(active.alias("active"), "n", (F.col("n") / total).alias("share"))
        .orderBy(F.desc("n"), "active")
        .limit(top)
    )


def label_cardinality(df: DataFrame, labels: list[str]) -> DataFrame:
    """Mean labels per row, rows without any label and rows with all."""
    k = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    return df.agg(
        F.avg(k).alias("mean_labels"),
        F.count_if(k == 0).alias("rows_without"),
        F.count_if(k == len(labels)).alias("rows_with_all"),
    )


def change_break_rates(field_cells: DataFrame, min_rate: float = 0.0) -> DataFrame:
    """Break rate with and without each change, and the lift over the base rate."""
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    base = (n11 + n01) / (n11 + n10 + n01 + n00)
    rate = F.coalesce(F.try_divide(n11, n11 + n10), F.lit(0.0))
    out = field_cells.select(
        "field",
        rate.alias("rate_with"),
        F.coalesce(F.try_divide(n01, n01 + n00), F.lit(0.0)).alias("rate_without"),
        (rate / (base + 1e-10)).alias("lift"),
        (F.col("n11") + F.col("n10")).alias("support"),
    )
    return out.filter(F.col("rate_with") > min_rate)


def percentile_range(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """25/75 percentile of each feature on the positives, and class means."""
    q = exact_quantiles(df.filter(F.col(target) == 1), cols, [0.25, 0.75])
    pos, neg = F.col(target) == 1, F.col(target) == 0
    wide = df.agg(
        *[F.avg(F.when(pos, F.col(c))).alias(f"{c}__p") for c in cols],
        *[F.avg(F.when(neg, F.col(c))).alias(f"{c}__n") for c in cols],
    )
    items = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(q[c][0]).cast("double").alias("p25"),
            F.lit(q[c][1]).cast("double").alias("p75"),
            F.col(f"{c}__p").alias("positive_mean"),
            F.coalesce(F.col(f"{c}__n"), F.lit(0.0)).alias("negative_mean"),
        )
        for c in cols
    ]
    return wide.select(F.inline(F.array(*items)))


def pair_chi2_matrix(pairs: DataFrame, flags: list[str], top: int = 20) -> DataFrame:
    """Symmetric matrix of the top pairs' chi-square; absent or zero pairs are NULL."""
    best = pairs.orderBy(F.desc_nulls_last("chi2"), "field_1", "field_2").limit(top)
    both = best.select(
        F.inline(
            F.array(
                F.struct(F.col("field_1").alias("field"), F.col("field_2").alias("other"), F.col("chi2")),
                F.struct(F.col("field_2").alias("field"), F.col("field_1").alias("other"), F.col("chi2")),
            )
        )
    )
    return both.filter("chi2 <> 0").groupBy("field").pivot("other", flags).agg(F.max("chi2"))


def break_rate_comparison(singles: DataFrame, pairs: DataFrame, triplets: DataFrame) -> DataFrame:
    """Break rates of the top five fields, five pairs and three triplets."""

    def top(df, label, name, rate, n):
        best = df.orderBy(F.desc_nulls_last("chi2"), name).limit(n)
        return best.select(F.lit(label).alias("category"), F.col(name).alias("name"), F.col(rate).alias("break_rate"))

    return (
        top(singles, "individual", "field", "rate_changed", 5)
        .unionByName(top(pairs, "pair", "pair_name", "rate_both", 5))
        .unionByName(top(triplets, "triplet", "triplet_name", "rate_changed", 3))
    )


def wilson_interval(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Confidence bounds of a rate k / n."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    centre = p + F.try_divide(F.lit(z * z / 2), n.cast("double"))
    half = z * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + F.try_divide(F.lit(z * z / 4), n.cast("double") * n))
    den = 1 + F.try_divide(F.lit(z * z), n.cast("double"))
    return (centre - half) / den, (centre + half) / den


def rate_interval(sig: DataFrame, flags: list[str], target: str) -> DataFrame:
    """Break rate of each change pattern (similar past rows) with its confidence interval."""
    pattern = F.concat(*[F.col(c).cast("string") for c in flags])
    g = sig.groupBy(pattern.alias("pattern")).agg(
        F.sum(F.col("n") * F.col(target)).alias("breaks"), F.sum("n").alias("cases")
    )
    lo, hi = wilson_interval(F.col("breaks"), F.col("cases"))
    return g.select("pattern", "breaks", "cases", (F.col("breaks") / F.col("cases")).alias("rate"), lo.alias("low"), hi.alias("high"))


def data_profile(df: DataFrame, numeric: list[str], text: list[str], sentinels: list[float]) -> DataFrame:
    """Null share, negatives and sentinel values of numbers; null share and shape count of texts.

    The shape of a text replaces letters by a and digits by 9; shapes are counted before they are
    counted distinct, so a common shape is one row per partition.
    """
    total = F.count("*").cast("double")
    wide = df.agg(
        *[(F.count_if(F.isnull(c)) / total).alias(f"{c}__null") for c in [*numeric, *text]],
        *[F.count_if(F.col(c) < 0).alias(f"{c}__neg") for c in numeric],
        *[F.count_if(F.col(c).isin(sentinels)).alias(f"{c}__sen") for c in numeric],
    )
    none = F.lit(None).cast("bigint")
    items = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__null").alias("null_share"),
            F.col(f"{c}__neg").alias("negatives"),
            F.col(f"{c}__sen").alias("sentinels"),
        )
        for c in numeric
    ] + [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__null").alias("null_share"),
            none.alias("negatives"),
            none.alias("sentinels"),
        )
        for c in text
    ]
    shape = F.regexp_replace(F.regexp_replace(F.col("value"), "[A-Za-z]+", "a"), "[0-9]+", "9")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in text])))
    shapes = (
        long.filter("value IS NOT NULL")
        .groupBy("column_name", shape.alias("shape"))
        .agg(F.count("*").alias("n"))
        .groupBy("column_name")
        .agg(F.count("*").alias("formats"))
    )
    return wide.select(F.inline(F.array(*items))).join(shapes, "column_name", "left")


def temporal_break_profile(df: DataFrame, ts: str, target: str, severity: str) -> DataFrame:
    """Break rate per calendar month with its month-end and quarter-end breaks and mean severity."""
    day = F.to_date(ts)
    month_end = F.datediff(F.last_day(day), day) < 3
    quarter_end = month_end & (F.month(day) % 3 == 0)
    brk = F.col(target) == 1
    return df.groupBy(F.date_format(F.trunc(day, "month"), "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"),
        F.avg(target).alias("break_rate"),
        F.avg(F.when(month_end, F.col(target))).alias("month_end_rate"),
        F.avg(F.when(quarter_end, F.col(target))).alias("quarter_end_rate"),
        F.avg(F.when(brk, F.col(severity))).alias("mean_severity"),
        F.max(F.when(brk, F.col(severity))).alias("max_severity"),
    )


def severity_quantiles(df: DataFrame, target: str, severity: str, probs: list[float]) -> DataFrame:
    """Distribution of the severity of breaks."""
    q = exact_quantiles(df.filter(F.col(target) == 1), [severity], probs)[severity]
    return df.sparkSession.createDataFrame(list(zip(probs, q)), "prob double, severity double")
