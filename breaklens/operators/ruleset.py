"""Rule tables as distributed sets: rules of all flag conjunctions, similar pairs, and a greedy choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.functions.text import condition_text
from breaklens.operators.rules import rule_score
from breaklens.session import pin


def conjunction_rules(signatures: DataFrame, flags: list[str], target: str, least: int = 50, method: str = "conjunctions") -> DataFrame:
    """Scored rules `flag = 0/1 AND ...` over every conjunction of flags with at least `least` rows.

    All conjunctions are one cube over the signature counts (rows of flags, target and n), so the data are
    scanned once however many rules there are. Confidence and lift are those of the target.
    """
    cube = signatures.cube(*flags).agg(F.sum("n").alias("support"), F.sum(F.col("n") * F.col(target)).alias("hits"))
    total = signatures.agg((F.sum(F.col("n") * F.col(target)) / F.sum("n")).alias("base"))
    conditions = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("feature"), F.lit("=").alias("op"), F.col(c).cast("double").alias("threshold"))) for c in flags])
    )
    found = cube.where(f"support >= {least}").withColumn("conditions", conditions).where(F.size("conditions") > 0)
    confidence = F.col("hits") / F.col("support")
    table = found.select(
        condition_text(F.col("conditions"), 0).alias("name"),
        "conditions",
        F.lit(1).alias("prediction"),
        confidence.alias("confidence"),
        "support",
        F.try_divide(confidence, total.scalar()).alias("lift"),
        F.lit(method).alias("method"),
    )
    return table.withColumn("score", rule_score(F.col("confidence"), F.col("support"), F.col("lift"), F.size("conditions")))


def _items(conditions: Column) -> Column:
    """A rule's set: its distinct conditions, thresholds to three digits; a rule without any has one empty item."""
    texts = F.transform(conditions, lambda x: F.format_string("%s %s %.3f", x["feature"], x["op"], x["threshold"]))
    return F.when(F.size(conditions) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(texts))


def similar_sets(sets: DataFrame, limit: float, place: str = "place") -> DataFrame:
    """(better, worse) ids of all pairs of sets (id, items, `place`) whose Jaccard similarity is above `limit`.

    Prefix filter: with the items of every set ordered from rare to frequent, two sets of that similarity
    share one of their first n - ceil(limit * n) + 1 items, so only these are joined; frequent items are hardly
    ever among them. The size filter and the exact similarity follow. `better` has the lower place.
    """
    long = sets.select("id", F.explode("items").alias("item"))
    often = long.groupBy("item").agg(F.count("*").alias("often"))
    ordered = long.join(often, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("in_order"))
    n = F.size("items")
    ready = sets.join(ordered, "id").withColumn("keep", (n - F.ceil(n * F.lit(limit) - 1e-9) + 1).cast("int"))
    heads = pin(ready.select("id", place, "items", F.explode(F.slice("in_order", F.lit(1), F.col("keep"))["item"]).alias("item")), "rule-heads")
    a = heads.select("item", F.col("id").alias("better"), F.col(place).alias("place_a"), F.col("items").alias("items_a"))
    b = heads.select("item", F.col("id").alias("worse"), F.col(place).alias("place_b"), F.col("items").alias("items_b"))
    pairs = a.join(b, "item").where("place_a < place_b")
    pairs = pairs.where(F.least(F.size("items_a"), F.size("items_b")) >= F.greatest(F.size("items_a"), F.size("items_b")) * F.lit(limit) - 1e-9)
    both = F.size(F.array_intersect("items_a", "items_b"))
    return pairs.where(both > (F.size("items_a") + F.size("items_b") - both) * F.lit(limit)).select("better", "worse").distinct()


def overruled(pairs: DataFrame) -> DataFrame:
    """(id) of the nodes that a greedy pass from best to worst drops: those with a better neighbour that is kept.

    Rounds: nodes without an undecided better neighbour are kept, their worse neighbours dropped, and the edges
    of both leave. A round settles the head of every chain at once, so rounds follow the longest chain of
    pairwise similar nodes, not their number.
    """
    edges = pin(pairs, "rule-pairs")
    dropped = None
    while not edges.isEmpty():
        heads = edges.select(F.col("better").alias("id")).distinct().join(edges.select(F.col("worse").alias("id")).distinct(), "id", "left_anti")
        lost = pin(edges.join(heads, F.col("better") == F.col("id"), "left_semi").select(F.col("worse").alias("id")).distinct(), "rule-dropped")
        dropped = lost if dropped is None else dropped.union(lost)
        left = edges.join(lost, F.col("better") == F.col("id"), "left_anti")
        edges = pin(left.join(lost, F.col("worse") == F.col("id"), "left_anti"), "rule-pairs")
    return dropped if dropped is not None else pairs.select(F.col("better").alias("id")).limit(0)


def deduplicate(rules: DataFrame, limit: float = 0.8) -> DataFrame:
    """The scored rules that are not too similar (Jaccard of conditions above `limit`) to a better kept one.

    Better is a higher score (to 12 digits), then the name; equal rules keep one row. Nothing is collected.
    """
    marked = pin(rules.withColumn("_id", F.monotonically_increasing_id()), "rules")
    place = F.struct((-F.round("score", 12)).alias("score"), F.col("name"), F.col("_id")).alias("place")
    sets = marked.select(F.col("_id").alias("id"), _items(F.col("conditions")).alias("items"), place)
    return marked.join(overruled(similar_sets(sets, limit)), F.col("_id") == F.col("id"), "left_anti").drop("_id")
