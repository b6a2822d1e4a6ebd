"""Sources, markup, scripts and metrics on pages, documents and events."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from strata.checks.registry import PAGE_PATH, eid, query
from strata.functions import ids, text
from strata.operators.dedup import intern
from strata.plans.extract import markup, typescript
from strata.plans.extract.common import file_nodes, lines
from strata.session import scratch
from strata.sources import corpus, facts, globs
from strata.sources.bindings import doc_files, doc_src, load, page_path, page_scripts, page_src
from strata.sources.files import write_files

_PAGE_FILE = f"'/pages/' || CAST(page_id AS VARCHAR) || {PAGE_PATH}"
_ATTR = r"""[A-Za-z_:@][\w:.@-]*(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''<>={}]+))?"""
_TAG = rf"<[A-Za-z][\w.:-]*(?:\s+{_ATTR})*\s*/?>"
_ANY = rf"(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<title>.*?</title>|{_TAG}|</[A-Za-z][\w.:-]*\s*>"
_TAGS_SQL = rf"""
SELECT page_id, path, generate_subscripts(t, 1) AS nth, unnest(t) AS tok FROM (
  SELECT page_id, {_PAGE_FILE} AS path, regexp_extract_all(html, '{_TAG}') AS t FROM pages)"""
_ATTRS_SQL = rf"""
SELECT page_id, path, nth, tag, regexp_extract(a, '^([^\s=]+)', 1) AS name,
       CASE WHEN a LIKE '%=%' THEN trim(regexp_extract(a, '(?s)^[^\s=]+\s*=\s*(.*)$', 1), '"''') ELSE 'true' END AS value, place FROM (
  SELECT page_id, path, nth, regexp_extract(tok, '^<([\w.:-]+)', 1) AS tag, generate_subscripts(l, 1) AS place, unnest(l) AS a FROM (
    SELECT *, regexp_extract_all(regexp_extract(tok, '(?s)^<[A-Za-z][\w.:-]*(.*?)/?>$', 1), '{_ATTR}') AS l FROM ({_TAGS_SQL})))"""


@query(f"""
SELECT 'page' AS source, page_id AS k, {eid("'File'", _PAGE_FILE)} AS entity_id, split_part({_PAGE_FILE}, '/', -1) AS name,
       CAST(length(html) - length(replace(html, chr(10), '')) + 1 AS INT) AS loc FROM pages
UNION ALL SELECT 'doc', doc_id, 'file:/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt', CAST(doc_id AS VARCHAR) || '.txt',
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) FROM documents""")
def file_nodes_pages(spark, sf):
    """A File node per page and document."""
    p, d = page_src(spark, sf), doc_src(spark, sf)
    def named(src, what, key, first):
        rows = file_nodes(src)
        k = F.regexp_extract("file_path", first, 1).cast("bigint")
        return rows.select(F.lit(what).alias("source"), k.alias("k"), "entity_id", "name", "loc")
    return named(p, "page", "page_id", r"^/pages/(\d+)").unionByName(named(d, "doc", "doc_id", r"/(\d+)\.txt$"))


@query("""
SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def doc_lines(spark, sf):
    """Numbered lines of every document."""
    rows = lines(doc_src(spark, sf))
    return rows.select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint").alias("doc_id"),
                       F.col("line").cast("bigint").alias("line"), "text")


def _numbered(els):
    """Elements with their number in the page; one page is one input row."""
    nth = F.row_number().over(W.partitionBy("path").orderBy("seq")).cast("bigint")
    return els.withColumn("nth", nth).withColumn("page_id", F.regexp_extract("path", r"^/pages/(\d+)", 1).cast("bigint"))


@query(rf"""
SELECT page_id, nth, regexp_extract(tok, '^<([\w.:-]+)', 1) AS tag, tok LIKE '%/>' AS self_closing FROM ({_TAGS_SQL})""")
def markup_elements(spark, sf):
    """Elements of every page in order."""
    return _numbered(markup.elements(page_src(spark, sf))).select("page_id", "nth", "tag", "self_closing")


@query(f"SELECT page_id, nth, name, value FROM ({_ATTRS_SQL})")
def markup_attributes(spark, sf):
    """Attributes with their values."""
    els = _numbered(markup.elements(page_src(spark, sf)))
    return markup.attributes(els).join(els.select(F.col("entity_id").alias("element_id"), "path", "page_id", "nth"), ["path", "element_id"]) \
        .select("page_id", "nth", "name", "value")


@query(rf"""
WITH t AS (SELECT path, nth, place, generate_subscripts(c, 1) AS i, unnest(c) AS class FROM (
  SELECT path, nth, place, list_filter(string_split_regex(value, '\s+'), lambda x: x <> '') AS c FROM ({_ATTRS_SQL}) WHERE name IN ('class', 'className')))
SELECT {eid("'TailwindClass'", 'class')} AS entity_id, class AS name, path AS file_path FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY path, nth, place, i) AS n FROM t) WHERE n = 1""")
def class_tokens(spark, sf):
    """One global node per class token, from its first use."""
    uses = markup.class_uses(markup.attributes(markup.elements(page_src(spark, sf))))
    first = intern(uses, "entity_id", ["path", "seq", "place", "nth"])
    return first.select("entity_id", F.col("class").alias("name"), F.col("path").alias("file_path"))


# Tags of a page with their places. Scripts, styles and titles are one token, as they hold no elements.
_PLACED_SQL = rf"""
SELECT page_id, path, i, tok, name, tok LIKE '</%' AS closes, line, col FROM (
  SELECT *, 1 + length(before) - length(replace(before, chr(10), '')) AS line, length(regexp_extract(before, '[^\n]*$')) AS col FROM (
    SELECT *, lower(regexp_extract(tok, '^</?([\w.:-]+)', 1)) AS name,
           substr(html, 1, CAST(sum(length(gap)) OVER w + sum(length(tok)) OVER w - length(tok) AS BIGINT)) AS before FROM (
      SELECT page_id, html, path, generate_subscripts(t, 1) AS i, unnest(t) AS tok, unnest(g[:len(t)]) AS gap FROM (
        SELECT page_id, html, {_PAGE_FILE} AS path, regexp_extract_all(html, '{_ANY}') AS t, regexp_split_to_array(html, '{_ANY}') AS g FROM pages))
    WINDOW w AS (PARTITION BY page_id ORDER BY i)) WHERE tok NOT LIKE '<!--%')"""
# An element ends at the closing tag of its name at which as many are closed as were opened since; a paragraph and what is
# in it (only b and a are) end at the next tag that is none of text.
_NESTING_SQL = rf"""
WITH t AS ({_PLACED_SQL}),
n AS (SELECT *, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) AS depth FROM t),
o AS (SELECT * FROM n WHERE NOT closes AND name NOT IN ('meta', 'br', 'script', 'style', 'title')),
e AS (SELECT o.page_id, o.i, o.name, coalesce(min(c.i), 1e9) AS stop FROM o
      LEFT JOIN n c ON c.page_id = o.page_id AND c.i > o.i AND (
        CASE WHEN o.name IN ('p', 'b') THEN c.name NOT IN ('a', 'b', 'br') OR (c.closes AND c.name = o.name)
             ELSE c.closes AND c.name = o.name AND c.depth = o.depth - 1 END)
      GROUP BY o.page_id, o.i, o.name),
f AS (SELECT x.page_id, x.i, max(e.i) AS parent FROM t x LEFT JOIN e ON e.page_id = x.page_id AND e.i < x.i AND x.i < e.stop WHERE NOT x.closes GROUP BY x.page_id, x.i),
d AS (SELECT page_id, path, i, {eid("'JSXElement'", "path || ':' || regexp_extract(tok, '^<([^ />]+)', 1) || ':' || CAST(line AS VARCHAR) || ':' || CAST(col AS VARCHAR)")} AS entity_id FROM t)
SELECT d.path, d.entity_id, p.entity_id AS parent_id FROM f JOIN d USING (page_id, i) LEFT JOIN d p ON p.page_id = f.page_id AND p.i = f.parent"""


@query(_NESTING_SQL)
def markup_nesting(spark, sf):
    """Every page element with the innermost one open at its tag; many paragraphs are never closed."""
    return markup.elements(page_src(spark, sf)).select("path", "entity_id", "parent_id")


_SCRIPT = "array_to_string(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1), chr(10))"


@query(rf"""
SELECT page_id, regexp_extract(c, '^([\w.]+)', 1) AS callee, 1 AS line, CAST(strpos({_SCRIPT}, c) - 1 AS INT) AS col FROM (
  SELECT page_id, html, unnest(regexp_extract_all(regexp_replace({_SCRIPT}, '"[^"]*"', '', 'g'), '[\w.]+\(')) AS c FROM pages)""")
def script_calls(spark, sf):
    """Call sites of page scripts and their places."""
    toks = typescript.tokens(page_scripts(spark, sf)).where("cls = 'call'")
    return toks.select(F.regexp_extract("path", r"^/pages/(\d+)", 1).cast("bigint").alias("page_id"),
                       F.regexp_extract("tok", r"^([\w.]+)", 1).alias("callee"), "line", "col")


@query(rf"""
SELECT page_id, {eid("'Variable'", _PAGE_FILE + " || ':' || name || ':1'")} AS entity_id, name, false AS is_constant FROM (
  SELECT page_id, url, unnest(regexp_extract_all({_SCRIPT}, 'var (\w+)=', 1)) AS name FROM pages)""")
def script_variables(spark, sf):
    """Variables of page scripts."""
    d = typescript.decorate(typescript.tokens(page_scripts(spark, sf)))
    n = typescript.nodes(d).where("kind = 'Variable'")
    return n.select(F.regexp_extract("file_path", r"^/pages/(\d+)", 1).cast("bigint").alias("page_id"), "entity_id", "name", "is_constant")


@query(r"""
SELECT doc_id, 1 + len(regexp_extract_all(text, '[.?]')) AS points FROM documents""")
def complexity_docs(spark, sf):
    """Decision points with the token list given; here the sentence ends."""
    return load(spark, sf, "documents").select("doc_id", text.complexity("text", [], [".", "?"]).cast("bigint").alias("points"))


@query(f"""
SELECT page_id, sha256(replace({PAGE_PATH}, '\\', '/')) AS path_key FROM pages""")
def path_hash_pages(spark, sf):
    """Facts written under the hash of their path, read back."""
    folder = scratch(spark, "facts")
    facts.write_facts(load(spark, sf, "pages").select("page_id", page_path().alias("file_path")), folder)
    return spark.read.parquet(folder).select("page_id", "path_key")


@query(f"SELECT page_id FROM pages WHERE lower(regexp_extract({PAGE_PATH}, '[^/](\\.[^./]*)$', 1)) IN ('.html', '.php')")
def filter_extensions_pages(spark, sf):
    """Pages whose extension is listed; a missing dot is added."""
    p = load(spark, sf, "pages").withColumn("extension", ids.ext_name(page_path()))
    return globs.filter_extensions(p, ["html", ".php"]).select("page_id")


@query(f"""
SELECT page_id FROM pages WHERE NOT (regexp_matches({PAGE_PATH}, '^(/[^/]+)*/fr(/.*)?$') OR regexp_matches({PAGE_PATH}, '^(/[^./][^/]*)*/[^./][^/]*\\.html(/.*)?$')
  OR regexp_matches({PAGE_PATH}, '^(/[^/]+)*/(node_modules|dist)(/.*)?$'))""")
def filter_ignored_pages(spark, sf):
    """S3, A10: pages whose path no ignore pattern matches."""
    p = load(spark, sf, "pages").withColumn("path", page_path())
    return globs.filter_ignored(p, globs.ignore_patterns(["**/fr/**", "**/*.html", "**/dist/**"])).select("page_id")


@query("""
SELECT source, length(text) + 1 AS n, CAST(length(text) - length(replace(text, chr(10), '')) + 2 AS INT) AS loc
FROM documents WHERE source <> 'src1' AND lang <> 'fr'""")
def scan_corpus_docs(spark, sf):
    """Documents written as one file each, then scanned with an ignored tree pruned
    before listing and another filtered by path."""
    root = scratch(spark, "corpus")
    doc_files(spark, sf, root, "source", "lang")
    files = corpus.scan_corpus(spark, root, exts=["txt"], ignore=["**/source=src1/**", "**/lang=fr/**"])
    return files.select(F.regexp_extract("path", r"/source=(\w+)/", 1).alias("source"),
                        F.length("text").alias("n"), ids.line_count("text").alias("loc"))


# Names that Spark's own file sources do not list, and two ordinary ones.
_NAMES = ["__init__.py", "_app.txt", ".hidden.txt", "_x/a.txt", ".y/b.txt", "pkg.d.ts/c.txt", "plain.txt", "skipped/_d.txt"]


@query(f"""
SELECT doc_id, name, length(coalesce(text, '')) AS n, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM (
  SELECT doc_id, text, [{", ".join(f"'{n}'" for n in _NAMES)}][doc_id % {len(_NAMES)} + 1] AS name FROM documents) WHERE name NOT LIKE 'skipped/%'""")
def scan_hidden_docs(spark, sf):
    """Every document as a file, most with a name or folder that begins with ``_`` or ``.``."""
    root = scratch(spark, "hidden")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    d = load(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"), "text")
    write_files(d, root).write.format("noop").mode("overwrite").save()
    found = corpus.scan_corpus(spark, root, exts=["txt", "py"], ignore=["**/skipped/**"])
    return found.select(F.regexp_extract("path", r"/doc-(\d+)/", 1).cast("bigint").alias("doc_id"),
                        F.regexp_extract("path", r"/doc-\d+/(.*)$", 1).alias("name"), F.length("text").alias("n"), "size")


_DOCS = """
WITH d AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def _fact_documents(spark, sf):
    """Fact documents from events: one in seven lacks relationships, one in eleven is broken."""
    e = load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    path = F.concat(F.lit("/e/"), F.col("event_id").cast("string"))
    node = F.struct(F.lit("Function").alias("kind"), F.col("event_type").alias("name"), path.alias("filePath"),
                    F.concat(F.lit("function:"), path).alias("entityId"), F.col("k").alias("startLine"))
    rel = F.when(F.col("k") % 7 != 0, F.array(F.struct(
        F.lit("CALLS").alias("type"), F.concat(F.lit("function:"), path).alias("sourceId"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("targetId"),
        F.concat(F.lit("calls:"), path).alias("entityId"), F.col("k").alias("weight"))))
    doc = F.to_json(F.struct(path.alias("filePath"), F.array(node, node).alias("nodes"), rel.alias("relationships")))
    broken = F.when(F.col("k") % 11 == 0, F.substring(doc, F.lit(1), F.length(doc) - 3)).otherwise(doc)
    return facts.parse_documents(e.select("event_id", broken.alias("value")))


@query(_DOCS + """
SELECT 'function:/e/' || CAST(event_id AS VARCHAR) AS entity_id, event_type AS name, k AS start_line, CAST(unnest([0, 1]) AS BIGINT) AS seq
FROM d WHERE k % 7 <> 0 AND k % 11 <> 0""")
def read_facts_nodes(spark, sf):
    """Nodes of the valid fact documents."""
    return facts.fact_nodes(facts.valid_facts(_fact_documents(spark, sf))).select("entity_id", "name", "start_line", "seq")


@query(_DOCS + """
SELECT 'calls:/e/' || CAST(event_id AS VARCHAR) AS entity_id, 'user:' || CAST(user_id AS VARCHAR) AS target_id, k AS weight
FROM d WHERE k % 7 <> 0 AND k % 11 <> 0""")
def read_facts_edges(spark, sf):
    """Edges of the valid fact documents."""
    return facts.fact_edges(facts.valid_facts(_fact_documents(spark, sf))).select("entity_id", "target_id", "weight")
