"""Graph queries on the business graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.checks.registry import REL_NODES, kid, query, rel_edges_sql
from strata.functions.props import to_map
from strata.operators.dedup import union_facts
from strata.plans import graph as g
from strata.sources.bindings import key_id, load, rel_edges, rel_nodes


@query(f"""
WITH e AS ({rel_edges_sql('CONTAINS')}), b AS (SELECT source_id AS a, target_id AS b FROM e UNION ALL SELECT target_id, source_id FROM e)
SELECT DISTINCT a AS entity_id, 'CONTAINS' AS type, b AS neighbor FROM b WHERE a LIKE 'nation:%'""")
def neighbors_nation(spark, sf):
    """G1: neighbours of every nation in both directions."""
    graph = g.Graph(rel_nodes(spark, sf, ("nation",)), rel_edges(spark, sf, ("CONTAINS",)))
    return g.neighbors(graph, graph.nodes, "CONTAINS", "both")


@query(f"""
SELECT DISTINCT {kid('orders', 'l_orderkey')} AS entity_id, 'CALLS' AS type, {kid('supplier', 'l_suppkey')} AS neighbor FROM lineitem""")
def neighbors_out_orders(spark, sf):
    """G1: what each order calls."""
    graph = g.Graph(rel_nodes(spark, sf, ("orders",)), rel_edges(spark, sf, ("CALLS",)))
    return g.neighbors(graph, graph.nodes, "CALLS", "out")


@query(f"""
SELECT {kid('region', 'n_regionkey')} AS n0, {kid('nation', 'n_nationkey')} AS n1, {kid('customer', 'c_custkey')} AS n2,
       {kid('orders', 'o_orderkey')} AS n3
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey""")
def pattern_region_orders(spark, sf):
    """Region → nation → customer → order."""
    graph = g.Graph(rel_nodes(spark, sf), rel_edges(spark, sf, ("CONTAINS", "PLACED")))
    return g.match(graph, "region", ("CONTAINS", "out", "nation"), ("CONTAINS", "out", "customer"), ("PLACED", "out", "orders"))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM ({rel_edges_sql('CONTAINS', 'PLACED')})),
  r AS (SELECT DISTINCT source_id AS seed, source_id AS node, 0 AS hops FROM e WHERE source_id LIKE 'region:%'
        UNION ALL SELECT r.seed, e.target_id, r.hops + 1 FROM r JOIN e ON e.source_id = r.node WHERE r.hops < 4)
SELECT seed, node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY seed, node""")
def reach_region(spark, sf):
    """Everything below each region with its distance."""
    graph = g.Graph(rel_nodes(spark, sf), rel_edges(spark, sf, ("CONTAINS", "PLACED")))
    return g.reach(graph, g.find(graph, F.col("kind") == "region"), 4)


@query(f"""
WITH RECURSIVE e AS (SELECT source_id AS a, target_id AS b FROM ({rel_edges_sql('CONTAINS')}) UNION SELECT target_id, source_id FROM ({rel_edges_sql('CONTAINS')})),
  r AS (SELECT DISTINCT a AS seed, a AS node, 0 AS hops FROM e WHERE a LIKE 'nation:%'
        UNION SELECT r.seed, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 2)
SELECT seed, node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY seed, node""")
def reach_cyclic_nation(spark, sf):
    """Two hops in both directions, so every step could lead back."""
    graph = g.Graph(rel_nodes(spark, sf), rel_edges(spark, sf, ("CONTAINS",)))
    return g.reach(graph, g.find(graph, F.col("kind") == "nation"), 2, None, "both")


@query(f"""
WITH o AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem),
     c AS (SELECT DISTINCT l_suppkey, o_custkey FROM o JOIN orders ON o_orderkey = l_orderkey)
SELECT {kid('supplier', 'l_suppkey')} AS seed, {kid('orders', 'l_orderkey')} AS node, 1 AS hops FROM o
UNION ALL SELECT {kid('supplier', 'l_suppkey')}, {kid('customer', 'o_custkey')}, 2 FROM c""")
def impact_supplier(spark, sf):
    """Which orders and customers are hit if a supplier changes, for every supplier."""
    graph = g.Graph(rel_nodes(spark, sf), rel_edges(spark, sf, ("CALLS", "PLACED")))
    return g.impact(graph, g.find(graph, F.col("kind") == "supplier"), 3, ["CALLS", "PLACED"])


@query(f"""
WITH p AS (SELECT min(['region:0', {kid('nation', 'n_nationkey')}, {kid('customer', 'c_custkey')}, {kid('orders', 'o_orderkey')}, 'part:7']) AS path
           FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
           WHERE n_regionkey = 0 AND l_partkey = 7)
SELECT 4 AS hops, array_to_string(path, '>') AS path FROM p WHERE path IS NOT NULL""")
def path_shortest(spark, sf):
    """One shortest path, the lowest by ids."""
    graph = g.Graph(rel_nodes(spark, sf), rel_edges(spark, sf))
    return g.shortest_path(graph, "region:0", "part:7", 6).select("hops", F.array_join("path", ">").alias("path"))


def _placed_graph(spark, sf):
    """Orders filed under their customer's nation, suppliers under their own; CALLS between."""
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nodes = union_facts(
        o.select(key_id("orders", "o_orderkey").alias("entity_id"), F.lit("orders").alias("kind"),
                 F.col("c_nationkey").cast("string").alias("file_path")),
        load(spark, sf, "supplier").select(key_id("supplier", "s_suppkey").alias("entity_id"), F.lit("supplier").alias("kind"),
                                           F.col("s_nationkey").cast("string").alias("file_path")))
    return g.Graph(nodes, rel_edges(spark, sf, ("CALLS",)).distinct())


_CALLED = f"""
SELECT DISTINCT {kid('orders', 'l_orderkey')} AS source_id, {kid('supplier', 'l_suppkey')} AS target_id, c_nationkey, s_nationkey
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey"""


@query(f"SELECT source_id, target_id FROM ({_CALLED}) WHERE c_nationkey <> s_nationkey")
def cross_edges_nation(spark, sf):
    """Only edges that leave their nation."""
    return g.cross_edges(_placed_graph(spark, sf)).select("source_id", "target_id")


@query(f"""
SELECT {kid('customer', 'c_custkey')} AS entity_id, c_name AS name FROM customer WHERE c_mktsegment = 'HOUSEHOLD'""")
def find_customers(spark, sf):
    """Nodes by a property."""
    graph = g.Graph(rel_nodes(spark, sf), rel_edges(spark, sf))
    return g.find(graph, F.element_at("properties", "segment") == "HOUSEHOLD").select("entity_id", "name")


@query(f"""
SELECT {kid('part', 'l_partkey')} AS target_id, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' GROUP BY l_partkey""")
def accesses_parts(spark, sf):
    """Where nodes with a property are used."""
    graph = g.Graph(rel_nodes(spark, sf, ("part",)), rel_edges(spark, sf, ("USES",)))
    return g.accesses(graph, F.element_at("properties", "brand") == "Brand#2").groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH n AS ({REL_NODES}), e AS ({rel_edges_sql()})
SELECT s.kind AS source_kind, e.type, t.kind AS target_kind, count(*) AS n
FROM e JOIN n s ON s.entity_id = e.source_id JOIN n t ON t.entity_id = e.target_id GROUP BY ALL""")
def edge_schema(spark, sf):
    """Which kinds each edge type joins, with counts."""
    return g.schema(g.Graph(rel_nodes(spark, sf), rel_edges(spark, sf)))


@query("""
SELECT 'customer' AS kind, 'segment' AS property, count(*) AS n FROM customer UNION ALL SELECT 'part', 'brand', count(*) FROM part
UNION ALL SELECT 'part', 'type', count(*) FROM part UNION ALL SELECT 'orders', 'status', count(*) FROM orders""")
def property_keys(spark, sf):
    """Property keys in use per kind."""
    return g.property_keys(rel_nodes(spark, sf))


@query(f"""
SELECT 'CALLS' AS type, {kid('supplier', 'l_suppkey')} AS target_id, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE s_nationkey < 10 GROUP BY l_suppkey""")
def unresolved_report(spark, sf):
    """References to suppliers whose nodes are held out."""
    s = load(spark, sf, "supplier").where("s_nationkey >= 10").select(key_id("supplier", "s_suppkey").alias("entity_id"))
    return g.unresolved(g.Graph(s, rel_edges(spark, sf, ("CALLS",))))


@query(f"""
SELECT {kid('customer', 'c_custkey')} AS entity_id, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'red' END AS state FROM customer""")
def patch_customers(spark, sf):
    """A patch sets its own keys and leaves the others."""
    updates = load(spark, sf, "customer").where("c_acctbal < 0").select(
        key_id("customer", "c_custkey").alias("entity_id"), to_map(state=F.lit("red")).alias("properties"))
    out = g.patch(g.Graph(rel_nodes(spark, sf, ("customer",)), rel_edges(spark, sf, ("PLACED",))), updates).nodes
    return out.select("entity_id", F.element_at("properties", "segment").alias("segment"), F.element_at("properties", "state").alias("state"))


@query(f"""
SELECT from_layer, to_layer, count(*) AS n FROM (
  SELECT CAST(c_nationkey AS VARCHAR) AS from_layer, CAST(s_nationkey AS VARCHAR) AS to_layer FROM ({_CALLED}) x
  JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
GROUP BY ALL""")
def layer_violations(spark, sf):
    """Calls into another nation of the same region are forbidden."""
    graph = _placed_graph(spark, sf)
    layers = graph.nodes.select("entity_id", F.col("file_path").alias("layer"))
    a, b = load(spark, sf, "nation"), load(spark, sf, "nation")
    side = lambda t, c: t.select("n_regionkey", F.col("n_nationkey").cast("string").alias(c))
    rules = side(a, "from_layer").join(side(b, "to_layer"), "n_regionkey").where("from_layer <> to_layer").select("from_layer", "to_layer")
    return g.violations(graph, layers, rules, "CALLS").groupBy("from_layer", "to_layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH n AS ({REL_NODES}), e AS ({rel_edges_sql()}),
     s AS (SELECT DISTINCT source_id AS id, type || '>' || t.kind AS shape FROM e JOIN n t ON t.entity_id = target_id
           UNION SELECT DISTINCT target_id, type || '<' || s.kind FROM e JOIN n s ON s.entity_id = source_id),
     g AS (SELECT id, array_to_string(list_sort(list(shape)), ';') AS signature FROM s GROUP BY id)
SELECT n.kind, o.kind AS owner_kind, coalesce(signature, '') AS signature, count(*) AS n, min(n.entity_id) AS example
FROM n LEFT JOIN n o ON o.entity_id = n.parent_id LEFT JOIN g ON g.id = n.entity_id GROUP BY ALL""")
def similar_profiles(spark, sf):
    """Nodes alike in kind, owner kind and edge shapes."""
    return g.profile(g.Graph(rel_nodes(spark, sf), rel_edges(spark, sf)))
