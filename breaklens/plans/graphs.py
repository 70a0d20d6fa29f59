"""Graph queries over co-occurrence networks and the transaction graph."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from breaklens.operators import graph, profile, stats, txn_graph
from breaklens.plans.association import NETS, edges
from breaklens.plans.parts import FIELD_ROWS, rounded, signatures
from breaklens.plans.registry import TXN, register
from breaklens.session import cut_lineage
from breaklens.sources.tables import txn
from breaklens.spec import FLAGS, TARGET

_V = ", ".join(f"('{c}')" for c in FLAGS)
G = f"""{NETS}, nodes AS (SELECT n AS network_type, v AS node FROM (VALUES ('break'), ('no_break'), ('difference')) a(n), (VALUES {_V}) b(v)),
  sym AS (SELECT network_type, src, dst FROM edges UNION ALL SELECT network_type, dst, src FROM edges),
  deg AS (SELECT network_type, node, (SELECT count(*) FROM sym s WHERE s.network_type = nodes.network_type AND s.src = nodes.node) AS degree FROM nodes),
  walk AS (SELECT network_type, node AS s, node AS v, 0 AS dist FROM nodes
     UNION SELECT w.network_type, w.s, e.dst, w.dist+1 FROM walk w JOIN sym e ON e.network_type = w.network_type AND e.src = w.v WHERE w.dist < {len(FLAGS)}),
  dist AS (SELECT network_type, s, v, min(dist) AS dist FROM walk GROUP BY ALL),
  sig AS (SELECT network_type, s, v, 0 AS dist, 1.0::DOUBLE AS paths FROM dist WHERE dist = 0
     UNION ALL SELECT p.network_type, p.s, e.dst, p.dist+1, p.paths FROM sig p JOIN sym e ON e.network_type = p.network_type AND e.src = p.v
       JOIN dist d ON d.network_type = p.network_type AND d.s = p.s AND d.v = e.dst AND d.dist = p.dist+1),
  sp AS (SELECT network_type, s, v, dist, sum(paths) AS paths FROM sig GROUP BY ALL),
  comp AS (SELECT network_type, s AS node, min(v) AS component FROM dist GROUP BY ALL),
  tri AS (SELECT a.network_type, a.src AS node, count(*)/2 AS t FROM sym a JOIN sym b ON a.network_type=b.network_type AND a.dst=b.src
     JOIN sym c ON c.network_type=a.network_type AND c.src=b.dst AND c.dst=a.src GROUP BY ALL),
  clus AS (SELECT network_type, node, CASE WHEN degree > 1 THEN 2*coalesce(t,0)/(degree*(degree-1)) ELSE 0 END AS c FROM deg LEFT JOIN tri USING (network_type, node)),
  degc AS (SELECT network_type, node, degree/{len(FLAGS) - 1}.0::DOUBLE AS degree_centrality FROM deg),
  clo AS (SELECT network_type, s AS node, CASE WHEN sum(dist) > 0 THEN (count(*)-1)/sum(dist)*(count(*)-1)/{len(FLAGS) - 1} ELSE 0 END AS closeness FROM dist GROUP BY ALL),
  btw AS (SELECT n.network_type, n.node, coalesce(sum(a.paths*b.paths/c.paths), 0)*2/({len(FLAGS) - 1}*{len(FLAGS) - 2}) AS betweenness
     FROM nodes n LEFT JOIN (sp a JOIN sp b ON a.network_type=b.network_type AND a.v=b.s AND a.s < b.v AND a.s <> a.v AND b.s <> b.v
       JOIN sp c ON c.network_type=a.network_type AND c.s=a.s AND c.v=b.v AND c.dist=a.dist+b.dist)
     ON a.network_type=n.network_type AND a.v=n.node GROUP BY ALL),
  summ AS (SELECT n.network_type, count(*) AS num_nodes, (SELECT count(*) FROM edges e WHERE e.network_type=n.network_type) AS num_edges,
     2*(SELECT count(*) FROM edges e WHERE e.network_type=n.network_type)/(count(*)*(count(*)-1)) AS density,
     (SELECT avg(c) FROM clus k WHERE k.network_type=n.network_type) AS avg_clustering,
     (SELECT count(DISTINCT component) FROM comp k WHERE k.network_type=n.network_type) AS num_components FROM nodes n GROUP BY n.network_type)"""
G = "RECURSIVE " + G


def field_graph(spark, sf):
    """Edges read by several jobs: checkpointed once."""
    e = cut_lineage(edges(spark, sf))
    return e, graph.vertices(e, FLAGS)


@register(
    "graph_summary",
    f"""WITH {G} SELECT network_type, num_nodes, num_edges, round(density, 6) AS density, round(avg_clustering, 6) AS avg_clustering, num_components FROM summ""",
)
def graph_summary(spark, sf):
    return rounded(graph.graph_summary(*field_graph(spark, sf)))


@register(
    "network_comparison",
    f"WITH {G} SELECT network_type, num_edges, round(density, 6) AS density, round(avg_clustering, 6) AS avg_clustering FROM summ",
)
def network_comparison(spark, sf):
    s = graph.graph_summary(*field_graph(spark, sf))
    return rounded(s.select("network_type", "num_edges", "density", "avg_clustering"))


@register(
    "degree_centrality",
    f"""WITH {G} SELECT network_type, node, round(degree_centrality, 6) AS degree_centrality FROM
        (SELECT *, row_number() OVER (PARTITION BY network_type ORDER BY round(degree_centrality,12) DESC, node) AS rn FROM degc) WHERE rn <= 5""",
)
def degree_centrality(spark, sf):
    return rounded(_top5(graph.degree_centrality(*field_graph(spark, sf)), "degree_centrality"))


def _top5(df, col):
    """Five highest nodes of each network (field-level table)."""
    w = W.partitionBy("network_type").orderBy(F.desc(F.round(col, 12)), "node")
    return df.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").drop("rn")


@register("closeness_centrality", f"WITH {G} SELECT network_type, node, round(closeness, 6) AS closeness FROM clo")
def closeness_centrality(spark, sf):
    e, v = field_graph(spark, sf)
    return rounded(graph.closeness_centrality(graph.shortest_paths(e, v), v))


@register(
    "betweenness_centrality",
    f"""WITH {G} SELECT network_type, node, round(betweenness, 6) AS betweenness FROM
        (SELECT *, row_number() OVER (PARTITION BY network_type ORDER BY round(betweenness,12) DESC, node) AS rn FROM btw) WHERE rn <= 5""",
)
def betweenness_centrality(spark, sf):
    e, v = field_graph(spark, sf)
    return rounded(_top5(graph.betweenness_centrality(graph.shortest_paths(e, v), v), "betweenness"))


@register("connected_components", f"WITH {G} SELECT network_type, node, component FROM comp")
def connected_components(spark, sf):
    return graph.connected_components(*field_graph(spark, sf))


@register("communities")
def communities(spark, sf):
    return graph.communities(*field_graph(spark, sf))


@register(
    "network_insights",
    f"""WITH {G} SELECT network_type, 'num_nodes' AS measure, '' AS node, num_nodes::DOUBLE AS value FROM summ
        UNION ALL SELECT network_type, 'num_edges', '', num_edges FROM summ UNION ALL SELECT network_type, 'density', '', round(density,6) FROM summ
        UNION ALL SELECT network_type, 'avg_clustering', '', round(avg_clustering,6) FROM summ UNION ALL SELECT network_type, 'num_components', '', num_components FROM summ
        UNION ALL SELECT network_type, 'degree_centrality', node, round(degree_centrality,6) FROM degc
        UNION ALL SELECT network_type, 'closeness', node, round(closeness,6) FROM clo
        UNION ALL SELECT network_type, 'betweenness', node, round(betweenness,6) FROM btw""",
)
def network_insights(spark, sf):
    return rounded(graph.network_insights(*field_graph(spark, sf)))


@register(
    "importance_vs_centrality",
    f"""WITH {G} SELECT field, round(abs(corr(f, y)), 6) AS individual_importance,
        round(coalesce((SELECT degree_centrality FROM degc WHERE network_type='break' AND node=field), 0), 6) AS network_centrality
        FROM ({FIELD_ROWS}) GROUP BY field""",
)
def importance_vs_centrality(spark, sf):
    cells = stats.field_cells(signatures(spark, sf), FLAGS, TARGET)
    imp = cells.select("field", F.abs(profile.phi(cells)).alias("individual_importance"))
    e = edges(spark, sf)
    cen = graph.degree_centrality(e, graph.vertices(e, FLAGS)).filter("network_type = 'break'")
    out = imp.join(cen.select(F.col("node").alias("field"), "degree_centrality"), "field", "left")
    return rounded(
        out.select(
            "field", "individual_importance", F.coalesce("degree_centrality", F.lit(0.0)).alias("network_centrality")
        )
    )


_LINK_COLS = ["txn_key", "security_id", "custodian", "portfolio"]


@register(
    "txn_graph_nodes",
    f"""WITH {TXN} SELECT 'txn_' || txn_key AS node, 'transaction' AS type FROM txn UNION ALL
        SELECT DISTINCT 'sec_' || security_id, 'security' FROM txn UNION ALL SELECT DISTINCT 'cust_' || custodian, 'custodian' FROM txn
        UNION ALL SELECT DISTINCT 'port_' || portfolio, 'portfolio' FROM txn""",
)
def txn_graph_nodes(spark, sf):
    return txn_graph.nodes(txn(spark, sf, _LINK_COLS), "txn_key")


@register(
    "txn_graph_edges",
    f"""WITH {TXN} SELECT 'txn_' || txn_key AS src, 'sec_' || security_id AS dst, 'trades' AS relation FROM txn
        UNION ALL SELECT 'txn_' || txn_key, 'cust_' || custodian, 'custodial' FROM txn
        UNION ALL SELECT 'txn_' || txn_key, 'port_' || portfolio, 'belongs_to' FROM txn""",
)
def txn_graph_edges(spark, sf):
    return txn_graph.edges(txn(spark, sf, _LINK_COLS), "txn_key")


@register(
    "txn_similarity_edges",
    f"""WITH {TXN}, g AS (SELECT txn_key, count(*) OVER (PARTITION BY security_type) AS nt, count(*) OVER (PARTITION BY currency) AS nc,
          count(*) OVER (PARTITION BY security_type, currency) AS nb FROM txn)
        SELECT txn_key, nt - nb AS similar_type, nc - 1 AS same_currency, nt - nb + nc - 1 AS degree,
          round((nt - nb)*0.5::DOUBLE + (nc - 1)*0.3::DOUBLE, 6) AS weighted_degree FROM g""",
)
def txn_similarity_edges(spark, sf):
    t = txn(spark, sf, ["txn_key", "security_type", "currency"])
    return rounded(txn_graph.similarity_degrees(t, "txn_key", "security_type", "currency"))


@register(
    "neighbour_aggregate",
    f"""WITH {TXN}, e AS (SELECT txn_key, l_extendedprice AS x, unnest([{{'n':'sec_'||security_id,'r':'trades'}}, {{'n':'cust_'||custodian,'r':'custodial'}},
          {{'n':'port_'||portfolio,'r':'belongs_to'}}]) AS h FROM txn),
        h1 AS (SELECT h, sum(x) AS sum_1, avg(x) AS mean_1, count(*) AS degree FROM e GROUP BY 1),
        t2 AS (SELECT txn_key, avg(mean_1) AS x2 FROM e JOIN h1 USING (h) GROUP BY 1),
        h3 AS (SELECT h, avg(x2) AS mean_3 FROM e JOIN t2 USING (txn_key) GROUP BY 1)
        SELECT h.n AS node, h.r AS relation, degree, round(sum_1, 2) AS sum_1, round(mean_3, 4) AS mean_3 FROM h1 JOIN h3 USING (h)""",
)
def neighbour_aggregate(spark, sf):
    t = txn(spark, sf, [*_LINK_COLS, "l_extendedprice"])
    out = txn_graph.neighbour_aggregate(t, "txn_key", "l_extendedprice")
    return out.select(
        "node", "relation", "degree", F.round("sum_1", 2).alias("sum_1"), F.round("mean_3", 4).alias("mean_3")
    )
