"""The transaction graph: transactions linked to securities, custodians and portfolios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column -> (node prefix, node type, relation).
LINKS = {
    "security_id": ("sec_", "security", "trades"),
    "custodian": ("cust_", "custodian", "custodial"),
    "portfolio": ("port_", "portfolio", "belongs_to"),
}
SAME_TYPE, SAME_CURRENCY = 0.5, 0.3


def nodes(df: DataFrame, key: str) -> DataFrame:
    """One node per transaction and per distinct linked value; NULLs give no node."""
    txns = df.select(F.concat(F.lit("txn_"), F.col(key).cast("string")).alias("node"), F.lit("transaction").alias("type"))
    linked = df.select(F.inline(_links())).filter("value IS NOT NULL").groupBy("node", "type").agg(F.count("*").alias("n"))
    return txns.unionByName(linked.select("node", "type"))


def _links():
    return F.array(
        *[
            F.struct(
                F.col(c).cast("string").alias("value"),
                F.concat(F.lit(p), F.col(c).cast("string")).alias("node"),
                F.lit(t).alias("type"),
                F.lit(r).alias("relation"),
            )
            for c, (p, t, r) in LINKS.items()
        ]
    )


def edges(df: DataFrame, key: str) -> DataFrame:
    """Transaction to security, custodian and portfolio: a projection, no shuffle."""
    out = df.select(F.concat(F.lit("txn_"), F.col(key).cast("string")).alias("src"), F.inline(_links()))
    return out.filter("value IS NOT NULL").select("src", F.col("node").alias("dst"), "relation")


def similarity_degrees(df: DataFrame, key: str, type_col: str, currency_col: str) -> DataFrame:
    """Similarity edges of every transaction, counted without listing the pairs.

    Two transactions of one type are linked with weight .5, of one currency with weight .3 (which
    replaces .5 when both agree). The groups are cliques, so the edges of a row follow from three
    group sizes, and the work is linear in the rows although the edges are quadratic.
    """
    n_both = df.groupBy(type_col, currency_col).agg(F.count("*").alias("n_both"))
    n_type = n_both.groupBy(type_col).agg(F.sum("n_both").alias("n_type"))
    n_cur = n_both.groupBy(currency_col).agg(F.sum("n_both").alias("n_cur"))
    sized = df.select(key, type_col, currency_col)
    sized = sized.join(n_type, type_col, "left").join(n_cur, currency_col, "left").join(n_both, [type_col, currency_col], "left")
    # NULL values link to nothing
    type_only = F.when(
        F.col(type_col).isNotNull(), F.col("n_type") - F.coalesce("n_both", F.lit(1))
    ).otherwise(0)
    currency = F.when(F.col(currency_col).isNotNull(), F.col("n_cur") - 1).otherwise(0)
    return sized.select(key, type_only.alias("similar_type"), currency.alias("same_currency")).select(
        "*",
        (F.col("similar_type") + F.col("same_currency")).alias("degree"),
        (F.col("similar_type") * SAME_TYPE + F.col("same_currency") * SAME_CURRENCY).alias("weighted_degree"),
    )


def similar_pairs(df: DataFrame, key: str, type_col: str, currency_col: str, first: int = 101) -> DataFrame:
    """Listed similarity edges among the `first` transactions in key order (the bound is the feature)."""
    few = df.select(key, type_col, currency_col).orderBy(key).limit(first)
    a, b = few.toDF("src", "t", "c"), few.toDF("dst", "t", "c")
    kinds = [("t", "similar_type", SAME_TYPE, 0), ("c", "same_currency", SAME_CURRENCY, 1)]
    links = [
        a.select("src", col)
        .join(b.select("dst", col), col)
        .filter("src < dst")
        .select("src", "dst", F.struct(F.lit(rank).alias("rank"), F.lit(r).alias("relation"), F.lit(w).alias("weight")).alias("e"))
        for col, r, w, rank in kinds
    ]
    # currency is written last, so it wins where both hold
    return (
        reduce(DataFrame.unionByName, links)
        .groupBy("src", "dst")
        .agg(F.max("e").alias("e"))
        .select("src", "dst", "e.relation", "e.weight")
    )


def neighbour_aggregate(df: DataFrame, key: str, value: str) -> DataFrame:
    """Three hops of neighbour means: transactions -> hubs -> transactions -> hubs.

    Hops into hubs are partial aggregates, so a popular hub is combined before the shuffle. The hop
    back joins one small table per relation instead of shuffling edges by hub.
    """
    first = (
        df.select(F.col(value).alias("x"), F.inline(_links()))
        .filter("value IS NOT NULL")
        .groupBy("node", "relation")
        .agg(F.sum("x").alias("sum_1"), F.avg("x").alias("mean_1"), F.count("*").alias("degree"))
    )
    back = df.select(key, *LINKS)
    for c, (p, _, r) in LINKS.items():
        hub = first.filter(F.col("relation") == r).select(F.col("node").alias(f"_n_{c}"), F.col("mean_1").alias(f"_m_{c}"))
        back = back.join(hub, F.concat(F.lit(p), F.col(c).cast("string")) == F.col(f"_n_{c}"), "left")
    known = [F.col(f"_m_{c}") for c in LINKS]
    total = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(0.0)) for m in known])
    count = reduce(lambda a, b: a + b, [m.isNotNull().cast("int") for m in known])
    second = back.select(*LINKS, F.try_divide(total, count).alias("x"))
    third = (
        second.select("x", F.inline(_links()))
        .filter("value IS NOT NULL")
        .groupBy("node", "relation")
        .agg(F.avg("x").alias("mean_3"))
    )
    return first.join(third, ["node", "relation"]).select("node", "relation", "degree", "sum_1", "mean_1", "mean_3")
