"""Graph queries over node and edge DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strata.operators.joins import attach, hot_keys, placeholder, skew_join
from strata.operators.ordered import best_by_rank
from strata.session import materialise
from strata.sources.store import patch_nodes

# Edge types along which a change spreads to its dependants.
IMPACT_TYPES = ["CALLS", "EXTENDS", "IMPLEMENTS", "IMPORTS"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def of_types(self, types) -> DataFrame:
        if types is None:
            return self.edges
        types = [types] if isinstance(types, str) else list(types)
        return self.edges.where(F.col("type").isin(types))

    def views(self, nodes: str = "nodes", edges: str = "edges") -> None:
        """Temporary views for SQL."""
        self.nodes.createOrReplaceTempView(nodes)
        self.edges.createOrReplaceTempView(edges)


def _steps(g: Graph, types, direction: str) -> DataFrame:
    """(src, dst, type) along the wanted direction."""
    e = g.of_types(types)
    out = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "type")
    back = e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), "type")
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()


def neighbors(g: Graph, ids: DataFrame, types=None, direction: str = "both") -> DataFrame:
    """Distinct (entity_id, type, neighbor) of the given ids."""
    steps = _steps(g, types, direction)
    hit = skew_join(steps, ids.select(F.col("entity_id").alias("src")).distinct(), "src", "inner")
    return hit.select(F.col("src").alias("entity_id"), "type", F.col("dst").alias("neighbor")).distinct()


def match(g: Graph, first_kind: str, *steps: tuple[str, str, str]) -> DataFrame:
    """Fixed pattern of typed steps (edge type, direction, kind): distinct id columns n0, n1, …"""
    by_kind = lambda k, c: g.nodes.where(F.col("kind") == k).select(F.col("entity_id").alias(c))
    out = by_kind(first_kind, "n0")
    for i, (type_, direction, kind) in enumerate(steps, 1):
        hop = _steps(g, type_, direction).select(F.col("src").alias(f"n{i - 1}"), F.col("dst").alias(f"n{i}")).distinct()
        out = out.join(hop, f"n{i - 1}").join(by_kind(kind, f"n{i}"), f"n{i}", "left_semi")
    return out.select(*[f"n{i}" for i in range(len(steps) + 1)])


def _adjacency(g: Graph, types, direction: str) -> tuple[DataFrame, list[int]]:
    """Distinct steps, materialised once for all hops, and the hashes of hub nodes."""
    steps = materialise(_steps(g, types, direction).select("src", "dst").distinct())
    return steps, hot_keys(steps, ["src"])


def reach(g: Graph, seeds: DataFrame, depth: int, types=None, direction: str = "out") -> DataFrame:
    """(seed, node, hops) within ``depth`` hops, with the least hops; seeds are at 0.

    Each hop expands only nodes new to their seed and is checkpointed, so plans stay short and
    a lost executor redoes one hop. Expansion stops when nothing new is found."""
    steps, hubs = _adjacency(g, types, direction)
    frontier = materialise(seeds.select(F.col("entity_id").alias("seed"), F.col("entity_id").alias("node")).distinct())
    seen = [frontier.withColumn("hops", F.lit(0))]
    for hop in range(1, depth + 1):
        known = reduce(DataFrame.unionByName, [s.select("seed", "node") for s in seen])
        hit = skew_join(steps.withColumnRenamed("src", "node"), frontier, "node", "inner", hot=hubs)
        new = hit.select("seed", F.col("dst").alias("node")).distinct()
        frontier = materialise(new.join(known, ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen.append(frontier.withColumn("hops", F.lit(hop)))
    return reduce(DataFrame.unionByName, seen)


def impact(g: Graph, ids: DataFrame, depth: int, types=None) -> DataFrame:
    """Everything that depends on the given nodes, with the least distance."""
    found = reach(g, ids, depth, types or IMPACT_TYPES, "in")
    return found.where("hops > 0")


def shortest_path(g: Graph, source: str, target: str, depth: int, types=None, direction: str = "out") -> DataFrame:
    """One row (hops, path) or none: a shortest path, the lowest by ids among equals. Each node
    keeps the lowest path that first reached it."""
    spark = g.edges.sparkSession
    steps, hubs = _adjacency(g, types, direction)
    frontier = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = frontier.select("node")
    for hop in range(depth + 1):
        hit = frontier.where(F.col("node") == target).select(F.lit(hop).alias("hops"), "path")
        if hop == depth or not hit.isEmpty():
            return hit
        nxt = skew_join(steps.withColumnRenamed("src", "node"), frontier, "node", "inner", hot=hubs)
        nxt = nxt.select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        nxt = nxt.groupBy("node").agg(F.min("path").alias("path"))
        frontier = materialise(nxt.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return hit
        seen = seen.unionByName(frontier.select("node"))
    raise AssertionError("unreachable")


def ends(g: Graph, cols=("kind", "name", "file_path", "language")) -> DataFrame:
    """Edges with the given node columns of both ends, as source_… and target_…"""
    have = [c for c in cols if c in g.nodes.columns]
    e = attach(g.edges, g.nodes, "source_id", "source", have)
    return attach(e, g.nodes, "target_id", "target", have)


def cross_edges(g: Graph, by: str = "file_path") -> DataFrame:
    """Edges whose ends are both known and differ in ``by`` (file_path or language)."""
    e = ends(g, (by,))
    return e.where(F.col(f"source_{by}") != F.col(f"target_{by}"))


def find(g: Graph, predicate: Column) -> DataFrame:
    return g.nodes.where(predicate)


def accesses(g: Graph, predicate: Column) -> DataFrame:
    """Edges into the nodes a predicate finds: where they are used, by edge type."""
    found = find(g, predicate).select(F.col("entity_id").alias("target_id"))
    return g.edges.join(found, "target_id", "left_semi")


def schema(g: Graph) -> DataFrame:
    """(source_kind, type, target_kind, n): counts of edge ends. Pairs are counted before the
    kinds are attached, which keeps hubs small."""
    pairs = g.edges.groupBy("source_id", "target_id", "type").agg(F.count(F.lit(1)).alias("c"))
    e = ends(Graph(g.nodes, pairs), ("kind",))
    kind = lambda c: F.coalesce(c, F.lit("Placeholder"))
    return e.groupBy(kind("source_kind").alias("source_kind"), "type", kind("target_kind").alias("target_kind")) \
        .agg(F.sum("c").alias("n"))


def property_keys(nodes: DataFrame) -> DataFrame:
    """(kind, property, n): keys in use per kind."""
    return nodes.select("kind", F.explode(F.map_keys("properties")).alias("property")) \
        .groupBy("kind", "property").agg(F.count(F.lit(1)).alias("n"))


def unresolved(g: Graph) -> DataFrame:
    """(type, target_id, n): references to nodes that no fact declares."""
    counted = g.edges.groupBy("type", "target_id").agg(F.count(F.lit(1)).alias("n"))
    return placeholder(counted, g.nodes).where("is_placeholder").drop("is_placeholder")


def patch(g: Graph, updates: DataFrame) -> Graph:
    return Graph(patch_nodes(g.nodes, updates), g.edges)


def violations(g: Graph, layers: DataFrame, rules: DataFrame, types=None) -> DataFrame:
    """Edges from one layer to another that a rule (from_layer, to_layer) forbids. ``layers``
    maps entity ids to layers; Spark broadcasts the rules when they measure small."""
    side = lambda on, out: layers.select(F.col("entity_id").alias(on), F.col("layer").alias(out))
    e = skew_join(g.of_types(types), side("source_id", "from_layer"), "source_id", "inner")
    e = skew_join(e, side("target_id", "to_layer"), "target_id", "inner")
    return e.join(rules.distinct(), ["from_layer", "to_layer"], "left_semi")


def profile(g: Graph) -> DataFrame:
    """(kind, owner_kind, signature, n, example): nodes with one kind, owner kind and set of
    edge shapes. A signature lists distinct (type, direction, other kind), so it is bounded by
    the catalog; shapes are made distinct before they are gathered."""
    e = g.edges.select("type", "source_id", "target_id")

    def shapes_of(me: str, other: str, arrow: str) -> DataFrame:
        """A shape needs the kind of one end only, so edges move once for it."""
        found = attach(e, g.nodes, other, "other", ("kind",), hot=hot_keys(e, [other]))
        return found.select(F.col(me).alias("entity_id"), F.concat("type", F.lit(arrow), F.coalesce("other_kind", F.lit("Placeholder"))).alias("shape"))
    shapes = shapes_of("source_id", "target_id", ">").unionByName(shapes_of("target_id", "source_id", "<")).distinct()
    signed = shapes.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("shape")), ";").alias("signature"))
    owners = g.nodes.select(F.col("entity_id").alias("parent_id"), F.col("kind").alias("owner_kind"))
    n = g.nodes.select("entity_id", "kind", "parent_id")
    n = skew_join(n, owners, "parent_id", "left").join(signed, "entity_id", "left")
    return n.groupBy("kind", "owner_kind", F.coalesce("signature", F.lit("")).alias("signature")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("example"))

