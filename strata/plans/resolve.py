"""References across files, resolved by joins on names and paths.

There is no type checker: a name is looked up in its own file, then through that file's
imports, then in the whole corpus when only one declaration has it; otherwise the edge points
at a placeholder. Sites are reduced to the first per (source, name) before any join, and each
lookup table has one row per key, so every join is many-to-one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.functions.ids import EXTENSIONS, dir_name, entity_id, ext_name, fold_dots, resolve_rel
from strata.functions.props import call_weight, cross_file
from strata.model import edges_like
from strata.operators.dedup import dedup_first
from strata.operators.joins import skew_join
from strata.operators.ordered import best_by_rank
from strata.plans.extract.common import edge, explode_edges, file_id, props, union_all
from strata.session import is_small, written

# Order in which kinds answer to an imported name.
KIND_ORDER = ["Function", "Class", "Interface", "Variable", "TypeAlias"]


def _meet(left: DataFrame, right: DataFrame, keys, how: str = "left", limit: int | None = None) -> DataFrame:
    """``skew_join`` of rows that take work to make: where their keys are counted, they are written first, so that
    neither the count nor the count of a later join makes them again."""
    if limit is not None or not is_small(left):
        left = written(left, "asked")
    return skew_join(left, right, keys, how, limit)


def import_keys(files: DataFrame, exts=EXTENSIONS) -> DataFrame:
    """(key, target_path): what an import may say to mean a file. A file answers to its path, to
    its path without extension, and as ``index`` to its folder; the extension order decides
    between files with one key. Three keys per file take the place of two dozen guesses per
    import."""
    rows = answers(files, exts).where("rank is not null")
    return best_by_rank(rows, ["key"], ["rank", "target_path"], ["target_path"])


def answers(files: DataFrame, exts=EXTENSIONS) -> DataFrame:
    """(target_path, key, rank): every key that a file answers to."""
    exts = list(exts)
    rank = F.array_position(F.array(*[F.lit(e) for e in exts]), ext_name("path"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    cand = lambda key, r: F.struct(key.alias("key"), r.alias("rank"))
    none = F.lit(None).cast("bigint")
    rows = files.select("path", F.explode(F.array(
        cand(F.col("path"), F.lit(0).cast("bigint")),
        cand(F.when(ext_name(stem) == "", stem), rank),
        cand(F.when(stem.endswith("/index"), dir_name(stem)), rank + len(exts)))).alias("c"))
    return rows.select(F.col("path").alias("target_path"), "c.*").where("key is not null and key <> ''")


def resolve_imports(imports: DataFrame, files: DataFrame, exts=EXTENSIONS, limit: int | None = None) -> DataFrame:
    """Imports with ``target_path`` (NULL when no file matches) and ``resolved_path``."""
    asked = imports.withColumn("key", resolve_rel("path", "module"))
    hit = _meet(asked, import_keys(files, exts), "key", "left", limit)
    return hit.withColumn("resolved_path", F.coalesce("target_path", "key")).drop("key")


def import_edges(resolved: DataFrame) -> DataFrame:
    """File → file IMPORTS with symbols and flags; one per pair, the first statement wins."""
    target = entity_id("file", "resolved_path")
    made = explode_edges(resolved, edge("IMPORTS", file_id(), target, 5, props(
        moduleSpecifier="module", resolvedPath="resolved_path", isPlaceholder=F.col("target_path").isNull(),
        isDynamicImport=F.lit(False), isTypeOnly="type_only", importedSymbols=F.nullif(F.col("symbols"), F.lit("")))))
    return dedup_first(made, "entity_id", "seq")


def imported_names(resolved: DataFrame) -> DataFrame:
    """(path, import_id, target_path, local, name, form, seq): one row per imported symbol."""
    return resolved.where("target_path is not null").select(
        "path", "import_id", "target_path", "seq", F.explode("imported").alias("i")) \
        .select("path", "import_id", "target_path", "seq", "i.*")


def declared(nodes: DataFrame, export_rows: DataFrame | None = None, kinds=None) -> DataFrame:
    """(path, qual, id, kind, exported): one row per name that can be referred to in a file.
    Methods answer to ``Class.method``, default exports also to ``default``."""
    kinds = kinds or KIND_ORDER + ["Method"]
    n = nodes.where(F.col("kind").isin(kinds))
    owner = F.regexp_extract("entity_id", r"([^:]*)\.[^.:]*$", 1)
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    # A method's class name keeps its case only on the class node, so names meet lower-cased.
    qual = F.when(F.col("kind") == "Method", F.concat_ws(".", owner, F.lower("name"))).otherwise(F.col("name"))
    rows = n.select(
        F.col("file_path").alias("path"), qual.alias("qual"), F.col("entity_id").alias("id"), "kind",
        (F.coalesce("is_exported", F.lit(False)) | F.coalesce("is_default_export", F.lit(False))).alias("exported"),
        F.coalesce("is_default_export", F.lit(False)).alias("is_default"),
        F.when(rank > 0, rank).otherwise(99).alias("rank"), "seq")
    if export_rows is not None:
        named = export_rows.where("form in ('exports', 'export_default')").select(
            "path", F.col("form").alias("_form"), F.explode("exported").alias("qual"))
        marks = named.groupBy("path", "qual").agg(
            F.lit(True).alias("_listed"), F.max(F.col("_form") == "export_default").alias("_def"))
        rows = rows.join(marks, ["path", "qual"], "left").withColumns({
            "exported": F.col("exported") | F.coalesce("_listed", F.lit(False)),
            "is_default": F.col("is_default") | F.coalesce("_def", F.lit(False))}).drop("_listed", "_def")
    both = rows.withColumn("qual", F.explode(F.when(F.col("is_default"), F.array(F.col("qual"), F.lit("default")))
                                             .otherwise(F.array("qual"))))
    return best_by_rank(both, ["path", "qual"], ["rank", "seq", "id"], ["id", "kind", "exported"])


def default_export(nodes: DataFrame) -> DataFrame:
    """First default-exported declaration of each file."""
    d = nodes.where("is_default_export").select("file_path", "seq", "entity_id", "kind", "name")
    return best_by_rank(d, ["file_path"], ["seq", "entity_id"], ["entity_id", "kind", "name"])


def resolve_symbols(names: DataFrame, decls: DataFrame, limit: int | None = None) -> DataFrame:
    """RESOLVES_IMPORT from the import to the exported declaration, or to the file for a
    namespace import."""
    wanted = names.where("form <> 'namespace'").withColumn("qual", F.col("name"))
    d = decls.where("exported").select(F.col("path").alias("target_path"), "qual", "id")
    hit = _meet(wanted, d, ["target_path", "qual"], "inner", limit)
    form_default = F.col("form") == "default"
    suffix = F.when(form_default, F.concat(F.lit(":default")))
    made = explode_edges(hit, edge("RESOLVES_IMPORT", F.col("import_id"), F.col("id"), 8, props(
        importedSymbol="local", targetSymbol=F.when(~form_default, F.col("name")),
        isDefaultImport=F.when(form_default, F.lit(True)))))
    spaces = names.where("form = 'namespace'").withColumn("id", entity_id("file", "target_path"))
    ns = explode_edges(spaces, edge("RESOLVES_IMPORT", F.col("import_id"), F.col("id"), 8, props(
        importedSymbol="local", isNamespaceImport=F.lit(True))))
    tagged = lambda df, tag: df.withColumn("entity_id", F.concat("entity_id", F.lit(tag)))
    default = made.where("element_at(properties, 'isDefaultImport') is not null")
    named = made.where("element_at(properties, 'isDefaultImport') is null")
    return union_all([named, tagged(default, ":default"), tagged(ns, ":namespace")])


def reexports(exports: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """File → file EXPORTS where the target exists."""
    r = resolve_imports(exports.where("form = 'reexport'"), files, limit=limit).where("target_path is not null")
    made = explode_edges(r, edge("EXPORTS", file_id(), entity_id("file", "target_path"), 4, props(
        isReExport=F.lit(True), reExportedSpecifiers=F.nullif(F.array_join("exported", ","), F.lit("")),
        sourceModuleSpecifier="module")))
    return dedup_first(made.withColumn("entity_id", F.concat("entity_id", F.lit(":reexport"))), "entity_id", "seq")


def exports(rows: DataFrame, decls: DataFrame, limit: int | None = None) -> DataFrame:
    """File → declaration EXPORTS of local lists and default assignments."""
    names = rows.where("form in ('exports', 'export_default')").select(
        "path", "form", "seq", F.explode("exported").alias("qual"))
    hit = _meet(names, decls.select("path", "qual", "id"), ["path", "qual"], "inner", limit)
    default = F.col("form") == "export_default"
    made = explode_edges(hit, edge("EXPORTS", file_id(), F.col("id"), 8, props(
        exportedName=F.when(~default, F.col("qual")), isDefaultExport=F.when(default, F.lit(True)))))
    is_default = F.element_at("properties", "isDefaultExport").isNotNull()
    return made.withColumn("entity_id", F.when(is_default, F.concat("entity_id", F.lit(":default"))).otherwise(F.col("entity_id")))


def lookup_names(sites: DataFrame, decls: DataFrame, names: DataFrame | None,
                 unique_kinds=(), limit: int | None = None) -> DataFrame:
    """Sites (path, local, member, qual, …) with ``id``, ``kind`` and ``target_path`` of what they
    mean, NULL when nothing does.

    ``local`` is the first part of the name, ``member`` the part behind it (or NULL), ``qual``
    the name in its own file."""
    if names is not None:
        mine = dedup_first(names.select("path", "local", "target_path", "name", "form", "seq"), ["path", "local"], "seq") \
            .select("path", "local", F.col("target_path").alias("_file"), F.col("name").alias("_name"), F.col("form").alias("_form"))
        sites = _meet(sites, mine, ["path", "local"], "left", limit)
        member = F.lower("member")
        through = (F.when(F.col("_form") == "namespace", F.col("member"))
                   .when(F.col("member").isNull(), F.col("_name"))
                   .otherwise(F.concat_ws(".", F.lower("_name"), member)))
        sites = sites.withColumns({"_at": F.coalesce("_file", "path"),
                                   "_qual": F.when(F.col("_file").isNotNull(), through).otherwise(F.col("qual"))})
        imported = F.col("_file").isNotNull()
    else:
        sites = sites.withColumns({"_at": F.col("path"), "_qual": F.col("qual")})
        imported = F.lit(False)
    sites = sites.withColumn("_imported", imported).drop("_file", "_name", "_form")
    here = decls.select(F.col("path").alias("_at"), F.col("qual").alias("_qual"), "id", "kind",
                        F.col("exported").alias("_exported"))
    hit = _meet(sites, here, ["_at", "_qual"], "left", limit)
    # Another file's declaration counts only when that file exports it.
    hidden = F.col("_imported") & ~F.coalesce("_exported", F.lit(False)) & F.col("kind").isin(KIND_ORDER)
    for c in ("id", "kind"):
        hit = hit.withColumn(f"_{c}", F.when(~F.coalesce(hidden, F.lit(False)), F.col(c)))
    hit = hit.drop("id", "kind", "_exported").withColumnsRenamed({"_id": "id", "_kind": "kind"}) \
        .withColumn("target_path", F.when(F.col("id").isNotNull(), F.col("_at")))
    if unique_kinds:
        # A private declaration of another file is never meant.
        only = decls.where(F.col("kind").isin(list(unique_kinds)) & (F.col("qual") != "default") & F.coalesce("exported", F.lit(False))) \
            .groupBy("qual").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_uid"),
                                 F.min("kind").alias("_ukind"), F.min("path").alias("_upath")).where("_n = 1")
        may = F.when(F.col("id").isNull() & F.col("member").isNull() & ~F.col("_imported"), F.col("local"))
        hit = _meet(hit.withColumn("_lone", may), only.select(F.col("qual").alias("_lone"), "_uid", "_ukind", "_upath"),
                        "_lone", "left", limit)
        hit = hit.withColumns({"target_path": F.coalesce("target_path", "_upath"), "kind": F.coalesce("kind", "_ukind"),
                               "id": F.coalesce("id", "_uid")}).drop("_lone", "_uid", "_ukind", "_upath")
    return hit.drop("_at", "_qual", "_imported")


def _named(sites: DataFrame, full: str) -> DataFrame:
    """Split a dotted name: ``local``, ``member``, and ``qual`` within its own file."""
    first = F.substring_index(full, ".", 1)
    dotted = F.col(full).contains(".")
    last = F.substring_index(full, ".", -1)
    qual = F.when((first == "this") & dotted, F.concat(F.lower("source_class"), F.lit("."), F.lower(last))) \
        .when(dotted, F.concat_ws(".", F.lower(first), F.lower(last))).otherwise(F.col(full))
    return sites.withColumns({"local": first, "member": F.when(dotted, F.expr(f"substring({full}, length(substring_index({full}, '.', 1)) + 2)")),
                              "qual": qual})


def _edge_rows(hit: DataFrame, type_: str, weight, bag) -> DataFrame:
    """One edge per (source, target), the first site wins; the target of a miss is a placeholder."""
    target = F.coalesce("id", entity_id("unresolved", "label"))
    rows = hit.withColumns({"target_id": target, "is_placeholder": F.col("id").isNull(),
                            "is_cross_file": cross_file("path", "target_path")})
    made = explode_edges(rows, edge(type_, F.col("source_id"), F.col("target_id"), 0, bag))
    made = dedup_first(made, "entity_id", "seq")
    return edges_like(made.withColumn("weight", weight))


def resolve_calls(sites: DataFrame, decls: DataFrame, names: DataFrame | None, limit: int | None = None) -> DataFrame:
    """CALLS with call-site data and flags, weight 6 across files and 7 within."""
    first = dedup_first(sites, ["path", "source_id", "callee"], "seq")
    callable_ = decls.where("kind in ('Function', 'Method', 'Class', 'Variable', 'Interface')")
    hit = lookup_names(_named(first, "callee"), callable_, names, ["Function"], limit).withColumn("label", F.col("callee"))
    bag = props(callSiteLine="line", callSiteColumn="col", isAwaited="is_awaited", isConditional="is_conditional",
                isCrossFile="is_cross_file", targetName="name", targetKind="kind", isPlaceholder="is_placeholder")
    return _edge_rows(hit, "CALLS", call_weight(F.element_at("properties", "isCrossFile") == "true"), bag)


def resolve_mutations(rows: DataFrame, decls: DataFrame, names: DataFrame | None, limit: int | None = None) -> DataFrame:
    """MUTATES_STATE from function to variable; a property target stays a placeholder by its name."""
    first = dedup_first(rows, ["path", "source_id", "target"], "seq").withColumn("source_class", F.lit(None).cast("string"))
    bare = F.regexp_replace("target", r"\[.*$", "")
    hit = lookup_names(_named(first.withColumn("bare", bare), "bare"), decls.where("kind = 'Variable'"), names, (), limit)
    bag = props(startLine="line", column="col", isCrossFile="is_cross_file", targetName="name", targetKind="kind",
                isPlaceholder="is_placeholder")
    return _edge_rows(hit.withColumn("label", F.col("name")), "MUTATES_STATE", F.lit(8), bag)


def resolve_heritage(rows: DataFrame, decls: DataFrame, names: DataFrame | None, limit: int | None = None) -> DataFrame:
    """EXTENDS and IMPLEMENTS with placeholders for bases outside the corpus."""
    base = rows.withColumns({"source_class": F.lit(None).cast("string"), "seq": F.col("seq") * 64 + F.col("place")})
    types = decls.where("kind in ('Class', 'Interface', 'CppClass')")
    hit = lookup_names(_named(base, "name"), types, names, ["Class", "Interface", "CppClass"], limit) \
        .withColumn("label", F.col("name"))
    bag = props(isPlaceholder="is_placeholder", targetName="name", targetKind="kind", isCrossFile="is_cross_file")
    return union_all([_edge_rows(hit.where(F.col("relation") == r), r, F.lit(9), bag) for r in ("EXTENDS", "IMPLEMENTS")])


def resolve_includes(includes: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """INCLUDES from file to file: a quoted include is looked up beside its file; anything else
    is a placeholder by its text."""
    asked = includes.withColumn("key", F.when(~F.col("is_system"), fold_dots(F.concat(dir_name("path"), F.lit("/"), F.col("include")))))
    known = files.select(F.col("path").alias("key"), F.lit(True).alias("_known"))
    hit = _meet(asked, known, "key", "left", limit)
    found = F.coalesce("_known", F.lit(False))
    target = entity_id("file", F.when(found, F.col("key")).otherwise(F.col("include")))
    made = explode_edges(hit, edge("INCLUDES", file_id(), target, 4, props(
        includePath="include", isSystemInclude="is_system", isPlaceholder=~found)))
    return dedup_first(made, "entity_id", "seq")


def include_rows(nodes: DataFrame) -> DataFrame:
    """(path, include, is_system, seq) from IncludeDirective nodes."""
    n = nodes.where("kind = 'IncludeDirective'")
    return n.select(F.col("file_path").alias("path"), F.element_at("properties", "includePath").alias("include"),
                    (F.element_at("properties", "isSystemInclude") == "true").alias("is_system"), "seq")


def py_calls(sites: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """PYTHON_CALLS by the called name: a function, method or class of the same file, else a
    placeholder function of that file."""
    kinds = ["PythonFunction", "PythonClass", "PythonMethod"]
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    d = best_by_rank(nodes.where(F.col("kind").isin(kinds)).select(
        F.col("file_path").alias("path"), "name", "entity_id", rank.alias("rank"), "seq"),
        ["path", "name"], ["rank", "seq", "entity_id"], ["entity_id"]).withColumnRenamed("entity_id", "id")
    first = dedup_first(sites, ["path", "source_id", "name"], "seq")
    hit = _meet(first, d, ["path", "name"], "left", limit)
    target = F.coalesce("id", F.concat(F.lit("pythonfunction:"), F.col("path"), F.lit(":"), F.col("name")))
    made = explode_edges(hit, edge("PYTHON_CALLS", F.col("source_id"), target, 1, props(
        calledName="name", isPlaceholder=F.col("id").isNull())))
    return dedup_first(made, "entity_id", "seq")


def uses_component(owned: DataFrame, els: DataFrame, components: DataFrame, names: DataFrame | None,
                   limit: int | None = None) -> DataFrame:
    """USES_COMPONENT from the component around an element to the component it names."""
    used = els.where(F.col("tag").rlike("^[A-Z]")).join(
        owned.where("owner is not null").select("path", "entity_id", F.col("owner").alias("source_id")),
        ["path", "entity_id"]).select("path", "source_id", "tag", "line", "col", "seq", F.lit(None).cast("string").alias("source_class"))
    first = dedup_first(used, ["path", "source_id", "tag"], "seq")
    decls = declared(components, kinds=["Component"])
    hit = lookup_names(_named(first, "tag"), decls, names, (), limit).where("id is not null").withColumn("label", F.col("tag"))
    bag = props(isCrossFile="is_cross_file", targetName="tag", isPlaceholder="is_placeholder")
    return _edge_rows(hit, "USES_COMPONENT", F.lit(7), bag)


def sql_references(rows: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """REFERENCES_TABLE / REFERENCES_VIEW / CALLS_FUNCTION / CALLS_PROCEDURE to objects of the
    corpus; a relation no file defines is a placeholder table."""
    kinds = ["SQLTable", "SQLView", "SQLFunction", "SQLProcedure"]
    full = F.lower(F.coalesce(F.element_at("properties", "qualifiedName"), F.col("name")))
    objects = nodes.where(F.col("kind").isin(kinds)).select(
        full.alias("object"), "kind", F.when(F.col("kind").isin("SQLTable", "SQLView"), "relation")
        .when(F.col("kind") == "SQLFunction", "function").otherwise("procedure").alias("form"), "entity_id")
    objects = best_by_rank(objects, ["object", "form"], ["kind", "entity_id"], ["kind", "entity_id"]) \
        .withColumnsRenamed({"entity_id": "id"})
    asked = rows.withColumn("object", F.lower("object"))
    hit = _meet(asked, objects, ["object", "form"], "left", limit).where("id is not null or form = 'relation'")
    type_ = (F.when(F.col("kind") == "SQLView", "REFERENCES_VIEW").when(F.col("form") == "relation", "REFERENCES_TABLE")
             .when(F.col("form") == "function", "CALLS_FUNCTION").otherwise("CALLS_PROCEDURE"))
    target = F.coalesce("id", entity_id("sqltable", "object"))
    made = explode_edges(hit.withColumn("seq", F.lit(0).cast("bigint")), edge(
        type_, F.col("source_id"), target, 5, props(isPlaceholder=F.col("id").isNull(), targetName="object")))
    return dedup_first(made, "entity_id", "seq")


def containment(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directory nodes for every prefix of every path, and CONTAINS edges down to the files.
    Prefixes are made distinct with map-side combine, so a folder with most of the files costs
    no more than its distinct links."""
    parts = F.split("path", "/")
    depth = F.size(parts)
    links = files.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("parent"),
                           F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("child"),
                           (i + 1 == depth).alias("is_file")))).alias("l")).select("l.*") \
        .where("parent <> child").distinct()
    folder = lambda c: F.when(F.col(c) == "", F.lit("/")).otherwise(F.col(c))
    dirs = links.select(F.explode(F.array(folder("parent"), F.when(~F.col("is_file"), F.col("child")))).alias("path")) \
        .where("path is not null").distinct()
    nodes = dirs.select(entity_id("directory", "path").alias("entity_id"), F.lit("Directory").alias("kind"),
                        F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("file_path"))
    child = F.when(F.col("is_file"), entity_id("file", "child")).otherwise(entity_id("directory", "child"))
    edges = explode_edges(links.withColumn("seq", F.lit(0).cast("bigint")), edge(
        "CONTAINS", entity_id("directory", folder("parent")), child, 10))
    return nodes, edges
