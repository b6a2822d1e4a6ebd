"""Scalar helpers on pages, customers, parts, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.checks.registry import PAGE_PATH, eid, query
from strata.functions import ids, props, text
from strata.sources.bindings import LINE_ORDER, change_feed, doc_src, load, page_path


@query(rf"""
WITH p AS (SELECT page_id, replace(replace({PAGE_PATH}, '/', '\'), '\', '/') AS path FROM pages)
SELECT page_id, path, split_part(path, '/', -1) AS base,
       CASE WHEN split_part(path, '/', -1) = '..' THEN ''
            ELSE lower(regexp_extract(split_part(path, '/', -1), '^.+(\.[^.]*)$', 1)) END AS ext,
       regexp_replace(path, '/[^/]*$', '') AS dir
FROM p""")
def path_parts_pages(spark, sf):
    """Separators, base name, extension, folder."""
    back = F.replace(page_path(), F.lit("/"), F.lit("\\"))
    p = load(spark, sf, "pages").select("page_id", ids.norm_path(back).alias("path"))
    return p.select("page_id", "path", ids.base_name("path").alias("base"), ids.ext_name("path").alias("ext"),
                    ids.dir_name("path").alias("dir"))


@query(f"""
SELECT 'customer' AS source, c_custkey AS k, {eid("'Class'", "c_name")} AS id FROM customer
UNION ALL SELECT 'page', page_id, {eid("'File'", "url")} FROM pages
UNION ALL SELECT 'empty', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'unknown:' || c_name || ':7' ELSE 'Class:unknown:7' END FROM customer""")
def entity_id_customers(spark, sf):
    """P5: entity ids, and the unknown-filled form for an empty part."""
    c, p = load(spark, sf, "customer"), load(spark, sf, "pages")
    even = F.col("c_custkey") % 2 == 0
    empty = ids.entity_id(F.when(even, "").otherwise("Class"), F.when(even, F.col("c_name")).otherwise(""), "7")
    return (c.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k"), ids.entity_id("Class", "c_name").alias("id"))
            .unionByName(p.select(F.lit("page").alias("source"), F.col("page_id").alias("k"), ids.entity_id("File", "url").alias("id")))
            .unionByName(c.select(F.lit("empty").alias("source"), F.col("c_custkey").alias("k"), empty.alias("id"))))


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       'Line:' || 'Order_' || CAST(l_orderkey AS VARCHAR) || '_' || l_returnflag || ':L' || CAST(l_linenumber AS VARCHAR) || ':C0:' ||
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS VARCHAR) AS instance_id
FROM lineitem""")
def instance_ids_lineitem(spark, sf):
    """Instance ids with a counter running over each order."""
    li = load(spark, sf, "lineitem").withColumn("ident", F.concat_ws("#", F.concat(F.lit("Order "), "l_orderkey"), "l_returnflag"))
    li = li.withColumn("zero", F.lit(0))
    out = ids.instance_id(li, "Line", "ident", "l_orderkey", LINE_ORDER, line="l_linenumber", col="zero")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "instance_id")


@query("""
WITH d AS (SELECT doc_id, '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
                  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'PythonVariable' WHEN 1 THEN 'PythonParameter'
                       WHEN 2 THEN 'PythonClass' ELSE 'PythonMethod' END AS kind, source || '.Name' AS q, n_chars AS line
           FROM documents)
SELECT doc_id, lower(kind) || ':' || path || ':' || q ||
       CASE WHEN kind IN ('PythonVariable', 'PythonParameter') THEN ':' || CAST(line AS VARCHAR) ELSE '' END AS id FROM d""")
def python_ids_docs(spark, sf):
    """Python ids keep case and carry a line for two kinds only."""
    d = doc_src(spark, sf).join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    m = F.col("doc_id") % 4
    kind = F.when(m == 0, "PythonVariable").when(m == 1, "PythonParameter").when(m == 2, "PythonClass").otherwise("PythonMethod")
    return d.select("doc_id", ids.py_entity_id(kind, "path", F.concat("source", F.lit(".Name")), "n_chars").alias("id"))


@query(rf"""
WITH l AS (SELECT page_id, {PAGE_PATH} AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
     i AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN href ELSE '..' || href || CASE WHEN page_id % 3 = 1 THEN '.JSX' ELSE '/./x' END END AS imp FROM l),
     j AS (SELECT *, regexp_replace(path, '/[^/]*$', '') || '/' || regexp_replace(imp, '\.jsx?$', '', 'i') AS joined FROM i)
SELECT page_id, path, imp, CASE WHEN imp LIKE '.%' THEN '/' || array_to_string(list_reduce(
         list_transform(string_split(joined, '/'), lambda e: [e]),
         lambda acc, e: CASE WHEN e[1] IN ('', '.') THEN acc WHEN e[1] = '..' THEN acc[1:len(acc) - 1]
                        ELSE list_concat(acc, e) END, CAST([] AS VARCHAR[])), '/') ELSE imp END AS resolved
FROM j""")
def resolve_relative_links(spark, sf):
    """Links as relative imports of their page."""
    p = load(spark, sf, "pages").select(
        "page_id", page_path().alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    m = F.col("page_id") % 3
    imp = F.when(m == 0, F.col("href")).otherwise(F.concat(F.lit(".."), "href", F.when(m == 1, ".JSX").otherwise("/./x")))
    p = p.withColumn("imp", imp)
    return p.select("page_id", "path", "imp", ids.resolve_rel("path", "imp").alias("resolved"))


@query(r"""
SELECT p_partkey,
       regexp_replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN '.js' WHEN p_partkey % 3 = 1 THEN '.JSX' ELSE '.ts' END, '\.jsx?$', '', 'i') AS stripped,
       'callback_' || substring(regexp_replace(p_type || '.' || p_name || '.' || p_brand, '[^a-zA-Z0-9_]', '_', 'g'), 1, 30) || '_arg' || CAST(p_size AS VARCHAR) AS callback,
       coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, ''), 'anonymousVar') AS named,
       coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END, ''), 'any') AS typed,
       replace('"' || p_name || '"', '"', '') AS bare
FROM part""")
def name_helpers_parts(spark, sf):
    """P9, P22, P26, P29, P30 on part names."""
    p = load(spark, sf, "part")
    m = F.col("p_partkey") % 3
    suffix = F.when(m == 0, ".js").when(m == 1, ".JSX").otherwise(".ts")
    return p.select(
        "p_partkey", ids.strip_js(F.concat("p_name", suffix)).alias("stripped"),
        text.callback_name(F.concat_ws(".", "p_type", "p_name", "p_brand"), F.col("p_size")).alias("callback"),
        text.name_or(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")), "anonymousVar").alias("named"),
        text.type_or_any(F.when(F.col("p_size") % 3 != 0, F.col("p_type"))).alias("typed"),
        text.unquote(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("bare"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE r_name || '.' || n_name END AS qualified,
       CASE WHEN n_nationkey % 5 = 0 THEN 'dbo' ELSE r_name END AS schema_name, n_name AS object_name
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def qualified_names_nation(spark, sf):
    """Qualified names and their split with a default schema."""
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    scope = F.when(F.col("n_nationkey") % 5 != 0, F.col("r_name"))
    q = n.select("n_nationkey", ids.qualify(scope, "n_name").alias("qualified"))
    schema, obj = ids.split_qualified("qualified", "dbo")
    return q.select("n_nationkey", "qualified", schema.alias("schema_name"), obj.alias("object_name"))


@query("""
SELECT 'doc' AS source, doc_id AS k, length(text) - length(replace(text, chr(10), '')) + 1 AS loc FROM documents
UNION ALL SELECT 'page', page_id, length(html) - length(replace(html, chr(10), '')) + 1 FROM pages
UNION ALL SELECT 'span', l_orderkey, CAST(max(l_linenumber) - min(l_linenumber) + 1 AS BIGINT) FROM lineitem GROUP BY l_orderkey""")
def doc_line_counts(spark, sf):
    """Lines of a file, and of a span."""
    n = lambda c: ids.line_count(c).cast("bigint").alias("loc")
    d = load(spark, sf, "documents").select(F.lit("doc").alias("source"), F.col("doc_id").alias("k"), n("text"))
    p = load(spark, sf, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("k"), n("html"))
    s = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return d.unionByName(p).unionByName(s.select(F.lit("span").alias("source"), "k", ids.loc("a", "b").cast("bigint").alias("loc")))


@query("""
SELECT doc_id, CASE CAST(doc_id % 17 AS INT)
  WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'TSX' WHEN 2 THEN 'TypeScript' WHEN 3 THEN 'TSX' WHEN 4 THEN 'Python' WHEN 5 THEN 'C'
  WHEN 6 THEN 'C' WHEN 7 THEN 'C++' WHEN 8 THEN 'C++' WHEN 9 THEN 'C++' WHEN 10 THEN 'C++' WHEN 11 THEN 'Java' WHEN 12 THEN 'C#'
  WHEN 13 THEN 'Go' WHEN 14 THEN 'SQL' WHEN 15 THEN 'TypeScript' ELSE NULL END AS language FROM documents""")
def languages_docs(spark, sf):
    """P25: language of a path with each extension."""
    exts = F.array(*[F.lit(e) for e in ids.EXTENSIONS + [".MJS", ".txt"]])
    ext = F.get(exts, (F.col("doc_id") % 17).cast("int"))
    path = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), ext)
    return load(spark, sf, "documents").select("doc_id", ids.language(ids.ext_name(path)).alias("language"))


@query(r"""
SELECT p_partkey,
       CASE WHEN p_partkey % 2 = 0 THEN p_name || '.h' ELSE p_brand END AS include_path,
       p_partkey % 2 = 0 AS is_system, p_size % 2 = 0 AS on_demand,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN p_name WHEN 1 THEN '{' || p_name || '}' WHEN 2 THEN 'true' ELSE p_type END AS value,
       regexp_matches(CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END, '^[A-Z]') AS component,
       CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'private' WHEN 1 THEN 'protected' ELSE 'public' END AS visibility,
       CASE WHEN p_size % 2 = 0 THEN 'export,const' ELSE 'let' END AS modifiers
FROM part""")
def token_helpers_parts(spark, sf):
    """P19, P20, P23, P24, P27, P31 on texts made from parts."""
    p = load(spark, sf, "part")
    even, size, m4 = F.col("p_partkey") % 2 == 0, F.col("p_size"), F.col("p_partkey") % 4
    inc = F.when(even, F.concat(F.lit("<"), "p_name", F.lit(".h>"))).otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
    imp = F.when(size % 2 == 0, F.concat("p_type", F.lit(".*;"))).otherwise(F.concat("p_type", F.lit(".Name;")))
    attr = (F.when(m4 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(m4 == 1, F.concat(F.lit("{ "), "p_name", F.lit(" }")))
            .when(m4 == 2, F.lit(None).cast("string")).otherwise(F.col("p_type")))
    mods = F.when(size % 3 == 0, F.array(F.lit("static"), F.lit("private"))).when(size % 3 == 1, F.array(F.lit("protected"))) \
        .otherwise(F.array(F.lit("static")))
    var = F.when(size % 2 == 0, F.array(F.lit("export")))
    return p.select(
        "p_partkey", text.include_path(inc).alias("include_path"), text.is_system_include(inc).alias("is_system"),
        text.is_on_demand(imp).alias("on_demand"), text.attr_value(attr).alias("value"),
        text.is_component_name(F.when(size % 3 == 0, F.col("p_type")).otherwise(F.col("p_name"))).alias("component"),
        text.visibility(mods).alias("visibility"),
        F.array_join(text.var_modifiers(var, F.when(size % 2 == 0, F.lit("const")).otherwise(F.lit("let"))), ",").alias("modifiers"))


@query("""
SELECT p_partkey, p_name || chr(10) || p_type AS doc, p_name AS description, 'param,returns' AS tags FROM part""")
def doc_comments_parts(spark, sf):
    """Text, description and tags of comment blocks."""
    p = load(spark, sf, "part")
    c = F.concat(F.lit("/**\n * "), "p_name", F.lit("\n * @since 1\n */\n/** "), "p_type",
                 F.lit("\n   * @param a left\n   * @returns x */ function f() {"))
    return p.select("p_partkey", text.doc_text(c).alias("doc"), text.doc_description(c).alias("description"),
                    F.array_join(text.doc_tags(c), ",").alias("tags"))


@query("""
WITH b AS (SELECT event_id, 'user:' || CAST(user_id AS VARCHAR) AS entity_id, event_type AS operation,
                  json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, unnest(['entity_id', 'operation', 'k', 'name']) AS key,
       unnest([entity_id, CASE WHEN CAST(k AS INT) % 2 = 0 THEN 'patched' ELSE operation END, k, 'n' || k]) AS value FROM b""")
def props_flatten_events(spark, sf):
    """P12, S17 (node): core and nested properties in one bag, nested keys winning, NULLs gone."""
    e = change_feed(spark, sf)
    k = F.get_json_object("props", "$.k")
    nested = props.to_map(k=k, name=F.concat(F.lit("n"), k), gone=F.lit(None).cast("string"))
    nested = F.when(k.cast("int") % 2 == 0, F.map_concat(nested, props.to_map(operation=F.lit("patched")))).otherwise(nested)
    flat = props.flatten_props(e.select("event_id", "entity_id", "operation", nested.alias("properties")))
    return flat.select("event_id", F.explode("bag").alias("key", "value")).where("key <> 'event_id'")


@query("""
WITH b AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, unnest(['k', 'odd']) AS key, unnest([k, CASE WHEN CAST(k AS INT) % 2 = 1 THEN 'yes' END]) AS value FROM b""")
def props_keep_nulls_events(spark, sf):
    """S17 (edge): a key without a value stays as NULL."""
    k = F.get_json_object("props", "$.k")
    e = load(spark, sf, "events").select("event_id", props.clean_props(
        props.to_map(k=k, odd=F.when(k.cast("int") % 2 == 1, "yes")), "edge").alias("p"))
    return e.select("event_id", F.explode("p").alias("key", "value"))
