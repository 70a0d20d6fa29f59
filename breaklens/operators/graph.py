"""Measures on undirected edge tables (network_type, src, dst, weight).

Vertices are change flags, so all-pairs results are bounded by the number of columns squared.
Loops cut their lineage with a reliable checkpoint and stop when nothing changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.session import cut_lineage

NET = "network_type"


def vertices(edges: DataFrame, flags: list[str]) -> DataFrame:
    """All flags in every network, isolated ones included."""
    spark = edges.sparkSession
    nets = spark.createDataFrame([(n,) for n in ("break", "no_break", "difference")], f"{NET} string")
    return nets.select(NET, F.explode(F.array(*[F.lit(f) for f in flags])).alias("node"))


def symmetric(edges: DataFrame) -> DataFrame:
    flip = edges.select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select(NET, "src", "dst", "weight").unionByName(flip)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = symmetric(edges).groupBy(NET, F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(d, [NET, "node"], "left").select(NET, "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degrees(edges, nodes)
    n = nodes.groupBy(NET).agg(F.count("*").alias("n"))
    return d.join(n, NET).select(NET, "node", (F.col("degree") / (F.col("n") - 1.0)).alias("degree_centrality"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles each node belongs to, from edges turned towards the greater name."""
    e = edges.select(NET, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    ab, bc, ac = e, e.toDF(NET, "b", "c"), e.toDF(NET, "a", "c")
    closed = ab.join(bc, [NET, "b"]).join(ac, [NET, "a", "c"])
    return (
        closed.select(NET, F.explode(F.array("a", "b", "c")).alias("node"))
        .groupBy(NET, "node")
        .agg(F.count("*").alias("triangles"))
    )


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degrees(edges, nodes).join(triangles(edges), [NET, "node"], "left")
    pairs = F.col("degree") * (F.col("degree") - 1)
    c = F.when(pairs > 0, 2.0 * F.coalesce("triangles", F.lit(0)) / pairs).otherwise(0.0)
    return d.select(NET, "node", c.alias("clustering"))


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node name of each component, by label propagation until nothing changes."""
    sym = cut_lineage(symmetric(edges).select(NET, "src", "dst"))
    labels = cut_lineage(nodes.select(NET, "node", F.col("node").alias("component")))
    while True:
        heard = (
            sym.join(labels.toDF(NET, "src", "component"), [NET, "src"])
            .groupBy(NET, F.col("dst").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        step = labels.join(heard, [NET, "node"], "left").select(
            NET,
            "node",
            F.least("component", F.coalesce("heard", "component")).alias("new"),
            F.col("component").alias("old"),
        )
        step = cut_lineage(step)
        changed = step.filter("new <> old").limit(1).count()
        labels = step.select(NET, "node", F.col("new").alias("component"))
        if not changed:
            return labels


def shortest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unweighted distance and number of shortest paths for all reachable pairs, level by level."""
    sym = cut_lineage(symmetric(edges).select(NET, "src", "dst"))
    front = cut_lineage(
        nodes.select(NET, F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("dist"), F.lit(1.0).alias("paths"))
    )
    levels, level = [front], 0
    while True:
        level += 1
        seen = reduce(DataFrame.unionByName, levels).select(NET, "s", "v")
        reached = (
            front.join(sym.toDF(NET, "v", "w"), [NET, "v"])
            .groupBy(NET, "s", F.col("w").alias("v"))
            .agg(F.lit(level).alias("dist"), F.sum("paths").alias("paths"))
            .select(NET, "s", "v", "dist", "paths")
        )
        front = cut_lineage(reached.join(seen, [NET, "s", "v"], "left_anti"))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(front)


def closeness_centrality(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(r-1)/sum(dist) scaled by the reachable share (r-1)/(n-1)."""
    n = nodes.groupBy(NET).agg(F.count("*").alias("n"))
    per = paths.groupBy(NET, F.col("s").alias("node")).agg((F.count("*") - 1.0).alias("r"), F.sum("dist").alias("total"))
    c = F.when(F.col("total") > 0, F.col("r") / F.col("total") * F.col("r") / (F.col("n") - 1)).otherwise(0.0)
    return per.join(n, NET).select(NET, "node", c.alias("closeness"))


def betweenness_centrality(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of shortest paths through a node, normalised for undirected graphs."""
    cols = [NET, "s", "v", "dist", "paths"]
    sv = paths.select(*cols).toDF(NET, "s", "v", "d_sv", "p_sv").filter("s <> v")
    vt = paths.select(*cols).toDF(NET, "v", "t", "d_vt", "p_vt").filter("v <> t")
    st = paths.select(*cols).toDF(NET, "s", "t", "d_st", "p_st").filter("s < t")
    through = (
        sv.join(vt, [NET, "v"])
        .filter("s < t")
        .join(st, [NET, "s", "t"])
        .filter("d_sv + d_vt = d_st")
        .groupBy(NET, F.col("v").alias("node"))
        .agg(F.sum(F.col("p_sv") * F.col("p_vt") / F.col("p_st")).alias("b"))
    )
    n = nodes.groupBy(NET).agg(F.count("*").alias("n"))
    scale = F.when(F.col("n") > 2, 2.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    return (
        nodes.join(through, [NET, "node"], "left")
        .join(n, NET)
        .select(NET, "node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))
    )


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, edges, density, average clustering and components per network."""
    n = nodes.groupBy(NET).agg(F.count("*").alias("num_nodes"))
    m = edges.groupBy(NET).agg(F.count("*").alias("num_edges"))
    cl = clustering(edges, nodes).groupBy(NET).agg(F.avg("clustering").alias("avg_clustering"))
    comp = connected_components(edges, nodes).groupBy(NET).agg(F.countDistinct("component").alias("num_components"))
    out = n.join(m, NET, "left").withColumn("num_edges", F.coalesce("num_edges", F.lit(0)))
    density = F.try_divide(2.0 * F.col("num_edges"), F.col("num_nodes") * (F.col("num_nodes") - 1))
    return (
        out.join(cl, NET)
        .join(comp, NET)
        .select(NET, "num_nodes", "num_edges", density.alias("density"), "avg_clustering", "num_components")
    )


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 6) -> DataFrame:
    """Communities by weighted label propagation with fixed tie-breaks, and their modularity.

    Nodes with even and odd hashes move in turn, which keeps synchronous updates from swapping for
    ever. A network whose result scores below its connected components keeps the components.
    """
    sym = cut_lineage(symmetric(edges.filter("weight > 0")))
    components = connected_components(edges.filter("weight > 0"), nodes).toDF(NET, "node", "community")
    labels = cut_lineage(nodes.select(NET, "node", F.col("node").alias("community")))
    for i in range(rounds):
        votes = (
            sym.join(labels.toDF(NET, "dst", "community"), [NET, "dst"])
            .groupBy(NET, F.col("src").alias("node"), "community")
            .agg(F.sum("weight").alias("w"))
            .groupBy(NET, "node")
            .agg(F.min(F.struct((-F.round("w", 12)).alias("k"), F.col("community"))).alias("best"))
        )
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        labels = cut_lineage(
            labels.join(votes, [NET, "node"], "left").select(
                NET, "node", F.when(turn, F.coalesce("best.community", "community")).otherwise(F.col("community")).alias("community")
            )
        )
    both = labels.join(modularity(sym, labels), NET).unionByName(components.join(modularity(sym, components), NET))
    best = both.groupBy(NET, "node").agg(
        F.max(F.struct(F.round("modularity", 12).alias("modularity"), F.col("community"))).alias("b")
    )
    # the modularity is the same for all nodes of a network, so every node picks the same alternative
    # unless both tie, where any choice scores the same
    return best.select(NET, "node", F.col("b.community").alias("community"), F.col("b.modularity").alias("modularity"))


def modularity(sym: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of a labelling (0 for a network without edges)."""
    total = sym.groupBy(NET).agg(F.sum("weight").alias("m2"))
    inside = (
        sym.join(labels.toDF(NET, "src", "ca"), [NET, "src"])
        .join(labels.toDF(NET, "dst", "cb"), [NET, "dst"])
        .groupBy(NET)
        .agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("w_in"))
    )
    strength = (
        sym.join(labels.toDF(NET, "src", "community"), [NET, "src"])
        .groupBy(NET, "community")
        .agg(F.sum("weight").alias("k"))
        .groupBy(NET)
        .agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    )
    nets = labels.select(NET).distinct()
    q = F.col("w_in") / F.col("m2") - F.col("k2") / (F.col("m2") * F.col("m2"))
    return (
        nets.join(total, NET, "left")
        .join(inside, NET, "left")
        .join(strength, NET, "left")
        .select(NET, F.coalesce(q, F.lit(0.0)).alias("modularity"))
    )


def network_insights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All measures in one long table (network_type, measure, node, value)."""
    summary = graph_summary(edges, nodes)
    wide = ["num_nodes", "num_edges", "density", "avg_clustering", "num_components"]
    flat = summary.select(NET, *[F.col(c).cast("double").alias(c) for c in wide]).unpivot(NET, wide, "measure", "value")
    paths = shortest_paths(edges, nodes)
    parts = [flat.select(NET, "measure", F.lit("").alias("node"), "value")]
    for df, c in (
        (degree_centrality(edges, nodes), "degree_centrality"),
        (closeness_centrality(paths, nodes), "closeness"),
        (betweenness_centrality(paths, nodes), "betweenness"),
    ):
        parts.append(df.select(NET, F.lit(c).alias("measure"), "node", F.col(c).alias("value")))
    return reduce(DataFrame.unionByName, parts)
