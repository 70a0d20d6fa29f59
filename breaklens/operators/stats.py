"""Contingency and association statistics of change flags against a target.

Everything comes from one scan: `signature_counts` groups the rows by all flags and the target.
The group count is bounded by the flag combinations seen, partial aggregation shrinks the rows
before the shuffle, and singles, pairs and triplets are read off the small result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.functions.bands import interaction_class, alert_class, ratio_or_inf, significance_band


def signature_counts(df: DataFrame, flags: list[str], target: str) -> DataFrame:
    return df.groupBy(*flags, target).agg(F.count("*").alias("n"))


def cells(pairs: Column, target: str) -> list[Column]:
    """2x2 cell counts of (condition, target) over signature rows."""
    n, t = F.col("n"), F.col(target)
    return [
        F.sum(F.when((pairs == 1) & (t == 1), n).otherwise(0)).alias("n11"),
        F.sum(F.when((pairs == 1) & (t == 0), n).otherwise(0)).alias("n10"),
        F.sum(F.when((pairs == 0) & (t == 1), n).otherwise(0)).alias("n01"),
        F.sum(F.when((pairs == 0) & (t == 0), n).otherwise(0)).alias("n00"),
    ]


def chi2_2x2(correction: bool = True) -> Column:
    """Chi-square of the cells n11..n00; NULL when a margin is empty."""
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    r1, r0, c1, c0 = n11 + n10, n01 + n00, n11 + n01, n10 + n00
    n = r1 + r0
    gap = F.abs(n11 - F.try_divide(r1 * c1, n))
    gap = F.greatest(gap - 0.5, F.lit(0.0)) if correction else gap
    inv = sum((F.try_divide(n, r * c) for r, c in ((r1, c1), (r1, c0), (r0, c1))), F.try_divide(n, r0 * c0))
    return F.when((r1 > 0) & (r0 > 0) & (c1 > 0) & (c0 > 0), gap * gap * inv)


def with_association(counts: DataFrame, correction: bool = True) -> DataFrame:
    """Add chi2, Cramer's V, odds ratio, both rates, lift and the significance band to cell counts."""
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    rate_1 = F.coalesce(F.try_divide(n11, n11 + n10), F.lit(0.0))
    rate_0 = F.coalesce(F.try_divide(n01, n01 + n00), F.lit(0.0))
    out = counts.withColumn("chi2", chi2_2x2(correction))
    ok = F.col("chi2").isNotNull()
    return out.select(
        "*",
        F.sqrt(F.col("chi2") / (n11 + n10 + n01 + n00)).alias("cramers_v"),
        F.when(ok, ratio_or_inf(n11 * n00, n10 * n01)).alias("odds_ratio"),
        F.when(ok, rate_1).alias("rate_changed"),
        F.when(ok, rate_0).alias("rate_not_changed"),
        F.when(ok, F.when(rate_0 > 0, rate_1 / rate_0).otherwise(F.lit(float("inf")))).alias("lift"),
        significance_band(F.col("chi2")).alias("significance"),
    )


def field_cells(sig: DataFrame, flags: list[str], target: str) -> DataFrame:
    """One row per flag with its 2x2 cells."""
    long = sig.unpivot([target, "n"], flags, "field", "flag")
    return long.groupBy("field").agg(*cells(F.col("flag"), target))


def pair_cells(sig: DataFrame, flags: list[str], target: str) -> DataFrame:
    """One row per pair of flags; the condition is that both changed."""
    items = F.array(
        *[
            F.struct(F.lit(a).alias("field_1"), F.lit(b).alias("field_2"), (F.col(a) * F.col(b)).alias("flag"))
            for a, b in combinations(flags, 2)
        ]
    )
    long = sig.select(target, "n", F.inline(items))
    return long.groupBy("field_1", "field_2").agg(*cells(F.col("flag"), target))


def chi2_individual(sig: DataFrame, flags: list[str], target: str, correction: bool = True) -> DataFrame:
    return with_association(field_cells(sig, flags, target), correction)


def chi2_pairwise(sig: DataFrame, flags: list[str], target: str, top_n_fields: int | None = None) -> DataFrame:
    """Association of 'both changed' for every pair with cases, and its gain over the better single field."""
    singles = chi2_individual(sig, flags, target)
    if top_n_fields:
        singles = singles.orderBy(F.desc_nulls_last("chi2"), "field").limit(top_n_fields)
    rates = singles.select("field", F.col("rate_changed").alias("rate"))
    pairs = with_association(pair_cells(sig, flags, target).filter("n11 + n10 > 0"))
    out = pairs.join(rates.toDF("field_1", "rate_1"), "field_1").join(rates.toDF("field_2", "rate_2"), "field_2")
    best = F.greatest("rate_1", "rate_2")
    return out.select(
        "field_1",
        "field_2",
        F.concat_ws(" + ", "field_1", "field_2").alias("pair_name"),
        "n11",
        "n10",
        "n01",
        "n00",
        "chi2",
        "cramers_v",
        F.col("rate_changed").alias("rate_both"),
        F.col("rate_not_changed").alias("rate_not_both"),
        "lift",
        F.when(best > 0, F.col("rate_changed") / best).otherwise(0.0).alias("interaction_lift"),
        (F.col("n11") + F.col("n10")).alias("cases"),
        "significance",
    )


def top_pair_fields(pairs: DataFrame, top_n_pairs: int = 10) -> DataFrame:
    """Distinct fields of the pairs with the highest chi-square."""
    top = pairs.orderBy(F.desc("chi2"), "field_1", "field_2").limit(top_n_pairs)
    return top.select(F.col("field_1").alias("field")).union(top.select("field_2")).distinct()


def chi2_triplet(sig: DataFrame, flags: list[str], target: str, top_n_pairs: int = 10, min_cases: int = 5) -> DataFrame:
    """Association of 'all three changed' for triplets of the fields in the top pairs."""
    fields = top_pair_fields(chi2_pairwise(sig, flags, target), top_n_pairs)
    items = [
        F.when(
            (F.col(a) == 1) & (F.col(b) == 1) & (F.col(c) == 1),
            F.struct(F.lit(a).alias("field_1"), F.lit(b).alias("field_2"), F.lit(c).alias("field_3")),
        )
        for a, b, c in combinations(flags, 3)
    ]
    hit = (
        sig.select(target, "n", F.inline(F.array_compact(F.array(*items))))
        .groupBy("field_1", "field_2", "field_3")
        .agg(
            F.sum(F.when(F.col(target) == 1, F.col("n")).otherwise(0)).alias("n11"),
            F.sum(F.when(F.col(target) == 0, F.col("n")).otherwise(0)).alias("n10"),
        )
    )
    for c in ("field_1", "field_2", "field_3"):
        hit = hit.join(fields.toDF(c), c, "left_semi")
    pos = sig.agg(F.sum(F.when(F.col(target) == 1, F.col("n")).otherwise(0))).scalar()
    neg = sig.agg(F.sum(F.when(F.col(target) == 0, F.col("n")).otherwise(0))).scalar()
    counts = hit.filter(F.col("n11") + F.col("n10") >= min_cases).select(
        "field_1",
        "field_2",
        "field_3",
        F.concat_ws(" + ", "field_1", "field_2", "field_3").alias("triplet_name"),
        "n11",
        "n10",
        (pos - F.col("n11")).alias("n01"),
        (neg - F.col("n10")).alias("n00"),
    )
    return with_association(counts).withColumn("cases", F.col("n11") + F.col("n10"))


def chi2_p_value(stat: Column) -> Column:
    """Upper tail of chi-square at one degree of freedom: erfc(sqrt(x / 2)).

    Spark has no erfc. The power series of erf serves small arguments and the continued fraction of
    erfc the others, so that tiny p-values keep their relative precision.
    """
    z = F.sqrt(stat / 2)
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(60)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * 2 * z * z / (2 * n + 3)).alias("term"),
            (acc["total"] + acc["term"] * 2 * z * z / (2 * n + 3)).alias("total"),
        ),
        lambda acc: 1 - 2 / F.sqrt(F.pi()) * F.exp(-z * z) * acc["total"],
    )
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1)), z, lambda acc, n: z + n / 2 / acc)
    return F.when(z < 2, series).otherwise(F.exp(-z * z) / F.sqrt(F.pi()) / fraction)


def lift_report(sig: DataFrame, flags: list[str], target: str) -> DataFrame:
    """The three lifts of every pair: single fields, the pair, and the pair against independence."""
    t, n = F.col(target), F.col("n")
    pair_items = F.array(
        *[
            F.struct(
                F.lit(a).alias("field_1"), F.lit(b).alias("field_2"), F.col(a).alias("f1"), F.col(b).alias("f2")
            )
            for a, b in combinations(flags, 2)
        ]
    )
    long = sig.select(target, "n", F.inline(pair_items))

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    f1, f2 = F.col("f1") == 1, F.col("f2") == 1
    agg = long.groupBy("field_1", "field_2").agg(
        F.sum("n").alias("total"),
        F.sum(n * t).alias("breaks"),
        count(f1).alias("changes_1"),
        count(f2).alias("changes_2"),
        count(f1 & (t == 1)).alias("b1"),
        count(f2 & (t == 1)).alias("b2"),
        count(f1 & f2).alias("cases_both"),
        count(f1 & f2 & (t == 1)).alias("b12"),
    )

    def rate(num: str, den: Column) -> Column:
        return F.try_divide(F.col(num).cast("double"), den.cast("double"))

    c = F.col
    rates = agg.select(
        "*",
        rate("b1", c("changes_1")).alias("rate_1"),
        rate("b2", c("changes_2")).alias("rate_2"),
        F.try_divide((c("breaks") - c("b1")).cast("double"), c("total") - c("changes_1")).alias("rate_not_1"),
        F.try_divide((c("breaks") - c("b2")).cast("double"), c("total") - c("changes_2")).alias("rate_not_2"),
        F.coalesce(rate("b12", c("cases_both")), F.lit(0.0)).alias("rate_both"),
        F.try_divide((c("breaks") - c("b12")).cast("double"), c("total") - c("cases_both")).alias("rate_not_both"),
    )
    expected = c("rate_1") + c("rate_2") - c("rate_1") * c("rate_2")
    out = rates.select(
        "field_1",
        "field_2",
        "total",
        "breaks",
        "changes_1",
        "changes_2",
        "cases_both",
        "rate_1",
        "rate_2",
        "rate_not_1",
        "rate_not_2",
        "rate_both",
        "rate_not_both",
        ratio_or_inf(c("rate_1"), c("rate_not_1")).alias("lift_1"),
        ratio_or_inf(c("rate_2"), c("rate_not_2")).alias("lift_2"),
        ratio_or_inf(c("rate_both"), c("rate_not_both")).alias("lift_pair"),
        expected.alias("expected_independent"),
        F.when(expected > 0, c("rate_both") / expected).otherwise(0.0).alias("lift_interaction"),
    )
    return out.select(
        "*",
        interaction_class(c("lift_interaction")).alias("interaction"),
        alert_class(c("lift_pair"), c("cases_both"), c("lift_1"), c("lift_2")).alias("action"),
    )
