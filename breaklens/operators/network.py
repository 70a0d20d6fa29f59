"""Co-occurrence of change flags: Jaccard similarity and the networks built from it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cooccurrence_counts(sig: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """Pair counts c12 with the single counts c1, c2 (i < j), optionally per class."""
    n = F.col("n")
    items = F.array(
        *[
            F.struct(F.lit(a).alias("field_1"), F.lit(b).alias("field_2"), F.col(a).alias("f1"), F.col(b).alias("f2"))
            for a, b in combinations(flags, 2)
        ]
    )
    long = sig.select(*(by or []), "n", F.inline(items))
    return long.groupBy(*(by or []), "field_1", "field_2").agg(
        F.sum(n * F.col("f1")).alias("c1"), F.sum(n * F.col("f2")).alias("c2"), F.sum(n * F.col("f1") * F.col("f2")).alias("c12")
    )


def jaccard(c12: Column, c1: Column, c2: Column) -> Column:
    return F.coalesce(F.try_divide(c12.cast("double"), (c1 + c2 - c12).cast("double")), F.lit(0.0))


def jaccard_matrix(counts: DataFrame, flags: list[str]) -> DataFrame:
    """Long symmetric matrix with ones on the diagonal."""
    w = jaccard(F.col("c12"), F.col("c1"), F.col("c2"))
    upper = counts.select("field_1", "field_2", w.alias("jaccard"))
    lower = upper.select(F.col("field_2").alias("field_1"), F.col("field_1").alias("field_2"), "jaccard")
    # the diagonal comes from the data too: every field is in some pair
    diag = upper.select(F.explode(F.array("field_1", "field_2")).alias("f")).distinct()
    return upper.unionByName(lower).unionByName(
        diag.select(F.col("f").alias("field_1"), F.col("f").alias("field_2"), F.lit(1.0).alias("jaccard"))
    )


def networks(
    sig: DataFrame, flags: list[str], target: str, threshold: float = 0.1, diff_threshold: float = 0.05
) -> DataFrame:
    """Edges (network_type, src, dst, weight) of the break, no-break and difference networks."""
    n, t = F.col("n"), F.col(target)
    classes = [("break", t), ("no_break", 1 - t)]
    items = F.array(
        *[
            F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.col(a).alias("f1"), F.col(b).alias("f2"))
            for a, b in combinations(flags, 2)
        ]
    )
    long = sig.select(target, "n", F.inline(items))
    aggs = []
    for name, m in classes:
        f1, f2 = F.col("f1"), F.col("f2")
        aggs += [
            F.sum(n * m * f1).alias(f"{name}_1"),
            F.sum(n * m * f2).alias(f"{name}_2"),
            F.sum(n * m * f1 * f2).alias(f"{name}_12"),
        ]
    w = long.groupBy("src", "dst").agg(*aggs)
    weights = {name: jaccard(F.col(f"{name}_12"), F.col(f"{name}_1"), F.col(f"{name}_2")) for name, _ in classes}
    weights["difference"] = weights["break"] - weights["no_break"]
    cut = {"break": threshold, "no_break": threshold, "difference": diff_threshold}
    edges = w.select(
        "src",
        "dst",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("network_type"), v.alias("weight"), F.lit(cut[k]).alias("cut"))
                    for k, v in weights.items()
                ]
            )
        ),
    )
    return edges.filter(F.abs("weight") > F.col("cut")).select("network_type", "src", "dst", "weight")


def critical_pairs(edges: DataFrame, top_n: int = 10) -> DataFrame:
    """Strongest edges of the break network and the most break-specific ones (highest difference)."""

    def top(kind: str, label: str) -> DataFrame:
        best = edges.filter(F.col("network_type") == kind).orderBy(F.desc(F.round("weight", 12)), "src", "dst").limit(top_n)
        return best.select(F.lit(label).alias("list_name"), "src", "dst", "weight")

    return top("break", "strongest_break_pairs").unionByName(top("difference", "most_break_specific_pairs"))
