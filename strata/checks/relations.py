"""Dedup, joins, order, upserts and store checks on business rows and events."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from strata.checks.registry import PAGE_PATH, REL_NODES, eid, kid, query, rel_edges_sql
from strata.functions import ids, props
from strata.functions.props import to_map
from strata.model import DECLARED_KINDS, DECLARED_TYPES
from strata.operators import dedup, joins, ordered
from strata.operators.enclosing import enclosing
from strata.plans import resolve
from strata.plans.extract.common import union_all
from strata.plans.graph import Graph
from strata.session import scratch
from strata.sources import store
from strata.sources.bindings import (
    LINE_ORDER, call_ids, call_sites, change_feed, doc_src, key_id, load, order_calls, page_path, rel_edges, rel_nodes)

_LINE = ", ".join(LINE_ORDER)
_CALL_ORDER = ["call_line", *LINE_ORDER]


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def dedup_last_orders(spark, sf):
    """A1: the last order of a customer wins."""
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return dedup.dedup_last(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"""
SELECT {eid("'CALLS'", kid('orders', 'l_orderkey') + " || ':' || " + kid('supplier', 'l_suppkey'))} AS entity_id,
       l_linenumber AS call_line, l_linestatus = 'O' AS is_awaited, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {_LINE}) AS n FROM lineitem) WHERE n = 1""")
def dedup_first_calls(spark, sf):
    """A2: the first call site of a pair wins."""
    c = order_calls(spark, sf).select("entity_id", *LINE_ORDER, "call_line", "is_awaited")
    return dedup.dedup_first(c, "entity_id", _CALL_ORDER).select("entity_id", "call_line", "is_awaited", "l_partkey")


@query(f"""
WITH p1 AS (SELECT type, source_id, target_id, row_number() OVER (PARTITION BY type, source_id, target_id) AS n
            FROM ({rel_edges_sql('PLACED', 'CALLS')})),
     a AS (SELECT DISTINCT type, source_id, target_id, 1 AS pass FROM p1),
     b AS (SELECT DISTINCT type, source_id, target_id, 2 AS pass FROM ({rel_edges_sql('CALLS')}))
SELECT type, source_id, target_id, CAST(max(pass) AS INT) AS pass FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
GROUP BY type, source_id, target_id""")
def merge_passes(spark, sf):
    """A3, A4: edges of two passes, the second winning."""
    first = rel_edges(spark, sf, ("PLACED", "CALLS")).withColumn("seq", F.xxhash64("target_id"))
    first = dedup.dedup_last(first, "entity_id", "seq")
    second = rel_edges(spark, sf, ("CALLS",)).withColumn("seq", F.xxhash64("target_id"))
    return dedup.merge_passes(first, second).select("type", "source_id", "target_id", "pass")


@query(f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {_LINE}) AS n FROM lineitem) WHERE n = 1""")
def child_once_lineitem(spark, sf):
    """A child only counts once per owner."""
    li = load(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER)
    return dedup.dedup_first(li, ["l_orderkey", "l_partkey"], LINE_ORDER).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""
SELECT l_orderkey AS file, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_keys,
       count(*) - count(DISTINCT l_suppkey) AS n_duplicates FROM lineitem GROUP BY l_orderkey""")
def duplicate_report(spark, sf):
    """Surplus rows per file."""
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), "l_suppkey")
    return dedup.duplicate_report(li, "file", "l_suppkey")


@query(f"""
WITH n AS (SELECT kind FROM ({REL_NODES})), e AS (SELECT type FROM ({rel_edges_sql()}))
SELECT 'node' AS what, coalesce(kind, '*') AS label, count(*) AS n FROM n GROUP BY ROLLUP (kind)
UNION ALL SELECT 'edge', coalesce(type, '*'), count(*) FROM e GROUP BY ROLLUP (type)""")
def graph_stats(spark, sf):
    """Totals per kind and type over the union of all branches."""
    return dedup.graph_stats(rel_nodes(spark, sf), rel_edges(spark, sf))


@query("""
SELECT coalesce(lang, '*') AS language, coalesce(source, '*') AS kind, count(*) AS n,
       CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level
FROM documents GROUP BY ROLLUP (lang, source)""")
def language_rollup_docs(spark, sf):
    """Counts by language and kind with subtotals."""
    d = doc_src(spark, sf).select(F.col("lang").alias("language"), F.col("source").alias("kind"))
    return dedup.language_rollup(d).select(
        F.coalesce("language", F.lit("*")).alias("language"), F.coalesce("kind", F.lit("*")).alias("kind"), "n", "level")


@query("""
SELECT page_id, array_to_string(list_sort(regexp_extract_all(html, 'href="([^"]*)"', 1)), ',') AS symbols,
       array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), ['/a', '/b']))), ',') AS joined
FROM pages""")
def collect_symbols_pages(spark, sf):
    """The symbols of one declaration as sorted text; lists united without repeats."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    both = dedup.array_union(hrefs, F.array(F.lit("/a"), F.lit("/b")))
    return load(spark, sf, "pages").select("page_id", dedup.joined_symbols(hrefs).alias("symbols"),
                                           dedup.joined_symbols(both).alias("joined"))


@query(f"""
WITH n AS ({REL_NODES}), e AS ({rel_edges_sql('PLACED', 'CONTAINS')})
SELECT e.type, e.source_id, e.target_id, s.kind AS source_kind, t.name AS target_name, t.entity_id IS NOT NULL AS target_found
FROM e LEFT JOIN n s ON s.entity_id = e.source_id
LEFT JOIN (SELECT * FROM n WHERE kind <> 'orders' OR name <> '1-URGENT') t ON t.entity_id = e.target_id""")
def attach_edge_ends(spark, sf):
    """Edges with the columns of both ends."""
    n, e = rel_nodes(spark, sf), rel_edges(spark, sf, ("PLACED", "CONTAINS"))
    out = joins.attach(e, n, "source_id", "source", ("kind",))
    known = n.where("kind <> 'orders' or name <> '1-URGENT'")
    out = joins.attach(out, known, "target_id", "target", ("name",))
    return out.select("type", "source_id", "target_id", "source_kind", "target_name", "target_found")


def _call_edges(spark, sf):
    """CALLS edges, one per pair, with nation flags of both ends."""
    # The two keys stand for the ids until the rows are together: they are shorter, and one pair has one id.
    lines = load(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER)
    sites = call_sites(dedup.dedup_first(lines, ["l_orderkey", "l_suppkey"], LINE_ORDER)).select(
        "l_orderkey", "l_suppkey", "call_line", "is_awaited", "is_conditional")
    orders = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.col("o_orderkey").alias("entity_id"), F.col("c_nationkey").alias("file_path"))
    # Suppliers of one status of balance are held out, so some targets stay unresolved.
    suppliers = load(spark, sf, "supplier").where("s_acctbal >= 0").select(
        F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("file_path"))
    e = joins.attach(sites, orders, "l_orderkey", "source", ("file_path",), hot=joins.hot_keys(lines, ["l_orderkey"]))
    e = joins.attach(e, suppliers, "l_suppkey", "target", ("file_path",), hot=joins.hot_keys(lines, ["l_suppkey"]))
    e = e.withColumns({c: F.col(c).cast("string") for c in ("source_file_path", "target_file_path")} | call_ids())
    return e.withColumn("is_cross_file", props.cross_file("source_file_path", "target_file_path"))


CALL_EDGES_SQL = f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {_LINE}) AS n FROM lineitem),
     s AS (SELECT * FROM supplier WHERE s_acctbal >= 0),
     e AS (SELECT {kid('orders', 'l_orderkey')} AS source_id, {kid('supplier', 'l_suppkey')} AS target_id,
                  l_linenumber AS call_line, l_linestatus = 'O' AS is_awaited, l_returnflag = 'R' AS is_conditional,
                  coalesce(c_nationkey <> s_nationkey, false) AS is_cross_file, s_suppkey IS NULL AS is_placeholder
           FROM f LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
           LEFT JOIN s ON s_suppkey = l_suppkey WHERE n = 1)"""


@query(CALL_EDGES_SQL + """
SELECT *, CAST(CASE WHEN is_cross_file THEN 6 ELSE 7 END AS INT) AS weight FROM e""")
def call_edges_cross_nation(spark, sf):
    """Call edges with site data, cross and placeholder flags, and weight."""
    e = _call_edges(spark, sf)
    return e.select("source_id", "target_id", "call_line", "is_awaited", "is_conditional", "is_cross_file",
                    (~F.col("target_found")).alias("is_placeholder"), props.call_weight("is_cross_file").alias("weight"))


@query(f"""
WITH u AS (SELECT user_id, event_type, ts, event_id,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT 'mutates_state:user:' || CAST(user_id AS VARCHAR) || ':variable:' || event_type AS entity_id, event_id,
       event_type = 'error' AS is_placeholder, 8 AS weight FROM u WHERE n = 1""")
def mutations_events(spark, sf):
    """A user mutates a variable; first site per pair, unknown variables as placeholders."""
    e = change_feed(spark, sf)
    target = ids.entity_id("Variable", "operation")
    e = e.select(ids.edge_id("MUTATES_STATE", "entity_id", target).alias("edge"), target.alias("target_id"), "ts", "event_id")
    first = dedup.dedup_first(e.withColumnRenamed("edge", "entity_id"), "entity_id", ["ts", "event_id"])
    known = change_feed(spark, sf).where("operation <> 'error'").select(ids.entity_id("Variable", "operation").alias("entity_id")).distinct()
    return joins.placeholder(first, known).select("entity_id", "event_id", "is_placeholder", F.lit(8).alias("weight"))


@query(f"""
SELECT 'EXTENDS' AS type, {kid('nation', 'n_nationkey')} AS source_id,
       CASE WHEN r_regionkey IS NULL THEN 'unresolved:' || 'region' || CAST(n_regionkey AS VARCHAR) ELSE {kid('region', 'r_regionkey')} END AS target_id,
       r_regionkey IS NULL AS is_placeholder
FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey""")
def heritage_nation(spark, sf):
    """Nation extends region by name, one region unknown."""
    name = F.concat(F.lit("Region"), F.col("n_regionkey").cast("string"))
    rows = load(spark, sf, "nation").select(
        F.lit("/n").alias("path"), key_id("nation", "n_nationkey").alias("source_id"), F.lit("Class").alias("source_kind"),
        F.lit(0).alias("place"), F.lit("EXTENDS").alias("relation"), name.alias("name"), F.col("n_nationkey").cast("bigint").alias("seq"))
    known = load(spark, sf, "region").where("r_regionkey <> 2").select(
        F.lit("/n").alias("path"), F.concat(F.lit("Region"), F.col("r_regionkey").cast("string")).alias("qual"),
        key_id("region", "r_regionkey").alias("id"), F.lit("Class").alias("kind"), F.lit(True).alias("exported"))
    e = resolve.resolve_heritage(rows, known, None)
    return e.select("type", "source_id", "target_id", (F.element_at("properties", "isPlaceholder") == "true").alias("is_placeholder"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_labelled_docs(spark, sf):
    """Only documents of the target set."""
    targets = load(spark, sf, "labels").where("quality = 1").select("doc_id")
    return joins.restrict(load(spark, sf, "documents").select("doc_id", "lang"), targets, "doc_id")


@query(f"""
WITH e AS ({rel_edges_sql('CALLS', 'PLACED')}),
     n AS (SELECT entity_id FROM ({REL_NODES}) WHERE NOT (kind = 'supplier' AND CAST(split_part(entity_id, ':', 2) AS INT) % 3 = 0))
SELECT DISTINCT id AS entity_id, 'Placeholder' AS kind
FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) WHERE id NOT IN (SELECT entity_id FROM n)""")
def placeholder_endpoints(spark, sf):
    """Nodes for endpoints that no node has."""
    number = F.split("entity_id", ":")[1].cast("int")
    n = rel_nodes(spark, sf).where(~((F.col("kind") == "supplier") & (number % 3 == 0)))
    return joins.placeholders(rel_edges(spark, sf, ("CALLS", "PLACED")), n)


@query(f"""
SELECT {kid('customer', 'o_custkey')} AS file_path, {kid('orders', 'o_orderkey')} AS entity_id FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1""")
def default_export_orders(spark, sf):
    """The first default export of a file."""
    o = load(spark, sf, "orders").select(
        key_id("customer", "o_custkey").alias("file_path"), key_id("orders", "o_orderkey").alias("entity_id"),
        F.lit("orders").alias("kind"), F.col("o_orderpriority").alias("name"),
        (F.col("o_orderstatus") == "F").alias("is_default_export"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return resolve.default_export(o).select("file_path", "entity_id")


@query("""
SELECT o_custkey, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
    WHEN '3-MEDIUM' THEN 3 ELSE 9 END, o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def priority_choice_orders(spark, sf):
    """The best candidate by a fixed order of kinds."""
    rank = F.array_position(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM")), F.col("o_orderpriority"))
    rank = F.when(rank > 0, rank).otherwise(9)
    return ordered.best_by_rank(load(spark, sf, "orders"), ["o_custkey"], [rank, "o_orderdate", "o_orderkey"], ["o_orderkey"])


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_quantity DESC, l_suppkey DESC, {_LINE}) AS ord FROM lineitem""")
def document_order_lineitem(spark, sf):
    """Pre-order position of facts in a file."""
    li = load(spark, sf, "lineitem")
    out = ordered.document_order(li, "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", LINE_ORDER)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ord")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_scope FROM events""")
def carry_forward_events(spark, sf):
    """The scope opened last, carried over the rows behind it."""
    e = load(spark, sf, "events")
    scope = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return ordered.carry_forward(e, ["user_id"], ["ts", "event_id"], scope, "current_scope").select("event_id", "current_scope")


@query("""
SELECT event_id, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth FROM events""")
def depth_sum_events(spark, sf):
    """Running depth of opens and closes."""
    e = load(spark, sf, "events")
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return ordered.running_sum(e, ["user_id"], ["ts", "event_id"], step, "depth").select("event_id", "depth")


@query("""
WITH s AS (SELECT DISTINCT user_id, 'day' AS kind, date_trunc('day', ts) AS a, date_trunc('day', ts) + INTERVAL 1 DAY AS b FROM events WHERE event_type = 'signup'
           UNION SELECT DISTINCT user_id, 'hour', date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 1 HOUR FROM events WHERE event_type IN ('view', 'click')),
     p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
     m AS (SELECT p.event_id, s.kind || ':' || CAST(epoch(s.a)::BIGINT AS VARCHAR) AS owner,
                  row_number() OVER (PARTITION BY p.event_id ORDER BY s.b - s.a) AS n
           FROM p JOIN s ON s.user_id = p.user_id AND p.ts >= s.a AND p.ts < s.b)
SELECT p.event_id, m.owner FROM p LEFT JOIN m ON m.event_id = p.event_id AND m.n = 1""")
def enclosing_spans_events(spark, sf):
    """The innermost block of a user around each error: an active hour, else an active day."""
    e = load(spark, sf, "events")
    def blocks(unit, seconds, kinds):
        a = F.unix_timestamp(F.date_trunc(unit, "ts"))
        return e.where(F.col("event_type").isin(kinds)).select(
            "user_id", a.alias("a"), (a + seconds).alias("b"),
            F.concat(F.lit(f"{unit}:"), a.cast("string")).alias("span_id")).distinct()
    spans = blocks("day", 86400, ["signup"]).unionByName(blocks("hour", 3600, ["view", "click"]))
    points = e.where("event_type = 'error'").select("user_id", F.unix_timestamp("ts").alias("at"), "event_id")
    out = enclosing(points, spans, "user_id", "at", "a", "b", "span_id", "event_id", inclusive_end=False)
    return out.select("event_id", "owner")


@query(f"""
WITH p AS (SELECT page_id, {PAGE_PATH} AS path FROM pages),
     f AS (SELECT DISTINCT path FROM p WHERE path <> '' AND path <> '/'),
     l AS (SELECT unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS i, string_split(path, '/') AS parts FROM f),
     k AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS parent, array_to_string(parts[1:i + 1], '/') AS child, i + 1 = len(parts) AS is_file FROM l)
SELECT {eid("'Directory'", "CASE WHEN parent = '' THEN '/' ELSE parent END")} AS source_id,
       CASE WHEN is_file THEN {eid("'File'", "child")} ELSE {eid("'Directory'", "child")} END AS target_id FROM k WHERE parent <> child""")
def directory_containment_pages(spark, sf):
    """Folders of all paths and what they contain."""
    files = load(spark, sf, "pages").select(page_path().alias("path")).where("path not in ('', '/')").distinct()
    return resolve.containment(files)[1].select("source_id", "target_id")


@query("""
WITH l AS (SELECT unnest(generate_series(1, 3)) AS i, source, lang, doc_id FROM documents)
SELECT DISTINCT CASE i WHEN 1 THEN 'directory:/' WHEN 2 THEN 'directory:/' || source ELSE 'directory:/' || source || '/' || lang END AS entity_id,
       CASE i WHEN 1 THEN '' WHEN 2 THEN source ELSE lang END AS name FROM l""")
def directory_nodes_docs(spark, sf):
    """A node for every folder."""
    return resolve.containment(doc_src(spark, sf).select("path"))[0].select("entity_id", "name")


def _two_batches(spark, sf):
    """All business rows, then a batch that renames some, moves some to a new kind and adds some."""
    n = rel_nodes(spark, sf, ("nation", "customer", "supplier"))
    number = F.split("entity_id", ":")[1].cast("int")
    current = n.withColumn("seq", F.lit(1)).where(~((F.col("kind") == "supplier") & (number % 2 == 0)))
    moved = F.when((F.col("kind") == "customer") & (number % 10 == 0), "prospect").otherwise(F.col("kind"))
    batch = n.where((F.col("kind") != "nation") & (number % 5 == 0)).select(
        "entity_id", moved.alias("kind"), F.upper("name").alias("name"), "parent_id",
        to_map(batch=F.lit("2")).alias("properties"), F.lit(2).alias("seq"))
    return current, batch.unionByName(batch.withColumns({"name": F.lit("stale"), "seq": F.lit(0)}))


_TWO = f"""
WITH n AS (SELECT *, CAST(split_part(entity_id, ':', 2) AS INT) AS k FROM ({REL_NODES}) WHERE kind IN ('nation', 'customer', 'supplier')),
     cur AS (SELECT * FROM n WHERE NOT (kind = 'supplier' AND k % 2 = 0)),
     bat AS (SELECT entity_id, CASE WHEN kind = 'customer' AND k % 10 = 0 THEN 'prospect' ELSE kind END AS kind, upper(name) AS name FROM n
             WHERE kind <> 'nation' AND k % 5 = 0),
     res AS (SELECT entity_id, kind, name, '2' AS batch FROM bat UNION ALL
             SELECT entity_id, kind, name, NULL FROM cur WHERE entity_id NOT IN (SELECT entity_id FROM bat))"""


@query(_TWO + " SELECT * FROM res")
def upsert_nodes_two_batches(spark, sf):
    """A batch replaces nodes whole, label included; new ones are added."""
    out = store.upsert_nodes(*_two_batches(spark, sf))
    return out.select("entity_id", "kind", "name", F.element_at("properties", "batch").alias("batch"))


@query(_TWO + f""" SELECT kind, entity_id, name FROM res
UNION ALL SELECT type, lower(type) || ':' || source_id || ':' || target_id, source_id FROM ({rel_edges_sql('CONTAINS')})""")
def store_roundtrip_nodes(spark, sf):
    """Two committed versions on disk, nodes read back label by label and edges by type."""
    s = store.GraphStore(spark, scratch(spark, "graph"))
    current, batch = _two_batches(spark, sf)
    edges = rel_edges(spark, sf, ("CONTAINS",))
    s.write(current, edges)
    s.upsert(batch, edges.limit(0))
    nodes, kept = s.read()
    found = [store.lookup(nodes, k).select("kind", "entity_id", "name") for k in ("nation", "customer", "prospect", "supplier")]
    found.append(kept.where("type = 'CONTAINS'").select(F.col("type").alias("kind"), "entity_id", F.col("source_id").alias("name")))
    return union_all(found)


@query(f"""
WITH c AS (SELECT DISTINCT source_id, target_id FROM ({rel_edges_sql('CALLS')})),
     e AS (SELECT *, CAST(split_part(source_id, ':', 2) AS INT) AS k FROM c)
SELECT source_id, target_id,
       CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE 7 END AS INT) AS weight,
       CASE WHEN k % 3 = 0 THEN NULL ELSE 'first' END AS kept, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'second' ELSE 'first' END AS patched FROM e""")
def upsert_edges_patch(spark, sf):
    """New edges come in whole with default weight; known ones only get their keys patched."""
    e = dedup.dedup_first(rel_edges(spark, sf, ("CALLS",)), "entity_id", "target_id")
    k = F.split("source_id", ":")[1].cast("int")
    current = e.where(k % 3 != 0).withColumns({
        "weight": F.lit(7), "created_at": F.lit("2024-01-01").cast("timestamp"), "seq": F.lit(1),
        "properties": to_map(kept=F.lit("first"), patched=F.lit("first"))})
    batch = e.where((k % 2 == 0) | (k % 3 == 0)).withColumns({
        "weight": F.lit(None).cast("int"), "created_at": F.lit("2024-02-01").cast("timestamp"), "seq": F.lit(2),
        "properties": to_map(patched=F.lit("second"))})
    out = store.upsert_edges(current, batch)
    return out.select("source_id", "target_id", "weight", F.element_at("properties", "kept").alias("kept"),
                      F.element_at("properties", "patched").alias("patched"))


@query(f"""
WITH e AS (SELECT DISTINCT source_id, target_id FROM ({rel_edges_sql('PLACED')}))
SELECT {eid("'PLACED'", "source_id || ':' || target_id")} AS entity_id, source_id, target_id,
       CAST(CASE WHEN CAST(split_part(target_id, ':', 2) AS INT) % 2 = 0 THEN 1 ELSE 0 END AS INT) AS weight,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at, CASE WHEN CAST(split_part(target_id, ':', 2) AS INT) % 2 = 0 THEN 'x' END AS note FROM e""")
def pack_edges_placed(spark, sf):
    """Edges packed with default weight and one creation time."""
    even = F.split("target_id", ":")[1].cast("int") % 2 == 0
    e = rel_edges(spark, sf, ("PLACED",)).withColumns({
        "weight": F.when(even, props.coalesce_weight(F.lit(None).cast("int"), 1)),
        "properties": to_map(note=F.when(even, "x"))})
    out = props.pack_edge(props.stamp(e, "2024-01-01 00:00:00"))
    return out.select("entity_id", "source_id", "target_id", "weight", "created_at", F.element_at("properties", "note").alias("note"))


@query(f"""
SELECT kind, entity_id, count(*) AS n FROM ({REL_NODES} UNION ALL SELECT {kid('customer', 'c_custkey')}, 'customer', c_name, NULL FROM customer WHERE c_nationkey < 5)
GROUP BY kind, entity_id HAVING count(*) > 1""")
def uniqueness_violations(spark, sf):
    """Ids that occur twice within a label."""
    again = load(spark, sf, "customer").where("c_nationkey < 5").select(
        key_id("customer", "c_custkey").alias("entity_id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return store.duplicate_ids(dedup.union_facts(rel_nodes(spark, sf), again))


_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(f"""
SELECT 'node' AS what, kind AS label, count(*) AS n FROM ({REL_NODES}) WHERE kind NOT IN ({_IN(DECLARED_KINDS)}) GROUP BY kind
UNION ALL SELECT 'edge', type, count(*) FROM ({rel_edges_sql()}) WHERE type NOT IN ({_IN(DECLARED_TYPES)}) GROUP BY type""")
def unknown_labels(spark, sf):
    """Kinds and edge types outside the declared catalog."""
    return store.unknown_labels(rel_nodes(spark, sf), rel_edges(spark, sf), DECLARED_KINDS, DECLARED_TYPES)


@query(f"SELECT entity_id, name FROM ({REL_NODES}) WHERE kind = 'part' AND name = 'red widget'")
def lookup_parts(spark, sf):
    """Nodes of a label by name."""
    return store.lookup(rel_nodes(spark, sf), "part", name="red widget").select("entity_id", "name")


@query("SELECT DISTINCT type, CASE WHEN type = 'CALLS' THEN 'CROSS_FILE_CALLS' END AS cross_type FROM (" + rel_edges_sql() + ")")
def cross_file_types(spark, sf):
    """Types that may leave their file, with the prefixed name."""
    return rel_edges(spark, sf).select("type", props.cross_file_type("type").alias("cross_type")).distinct()
