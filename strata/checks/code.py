"""Extraction and resolution on source text rendered from tables. The SQL says from the table's
columns alone what has to be found; the Spark side reads nothing but the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.checks.registry import query
from strata.operators.dedup import count_by, union_facts
from strata.plans import components, resolve
from strata.plans.analyze import analyze
from strata.plans.extract import cfamily, csharp, golang, java, markup, python, sql, typescript
from strata.session import written
from strata.sources import bindings as b


def facts(table: str, columns: str, *rows: str) -> str:
    """SQL with one row of ``columns`` per table row and entry of ``rows``."""
    names = [c.strip() for c in columns.split(",")]
    first, *rest = rows
    head = _aliased(first, names)
    return "\nUNION ALL ".join([f"SELECT {head} FROM {table}"] + [f"SELECT {r} FROM {table}" for r in rest])


def _aliased(row: str, names: list[str]) -> str:
    depth, start, parts = 0, 0, []
    quoted = False
    for i, ch in enumerate(row):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "([":
            depth += 1
        elif not quoted and ch in ")]":
            depth -= 1
        elif not quoted and ch == "," and depth == 0:
            parts.append(row[start:i])
            start = i + 1
    parts.append(row[start:])
    return ", ".join(f"{p.strip()} AS {n}" for p, n in zip(parts, names, strict=True))


# SQL fragments of the rendered corpora.
_S = "(SELECT CAST(s_suppkey AS VARCHAR) AS k, CAST(s_nationkey AS VARCHAR) AS n FROM supplier)"
_N = "(SELECT CAST(n_nationkey AS VARCHAR) AS k, CAST(n_regionkey AS VARCHAR) AS r FROM nation)"
_R = "(SELECT CAST(r_regionkey AS VARCHAR) AS k, CASE WHEN r_regionkey = 0 THEN 'index' ELSE 'r' || CAST(r_regionkey AS VARCHAR) END AS f FROM region)"
_SP, _NP = "'/shop/supplier/s' || k || '.ts'", "'/shop/nation/n' || k || '.ts'"
_SHIP = f"'function:' || {_SP} || ':ship' || k || ':10'"
_LOAD = f"'function:' || {_SP} || ':load' || k || ':21'"
_OPEN = f"'method:' || {_SP} || ':supplier' || k || '.open' || k"
_CLOSE = f"'method:' || {_SP} || ':supplier' || k || '.close' || k"
_BACK = f"'function:' || {_SP} || ':callback_rest_foreach_arg0:18'"
_AREA = f"'function:' || {_NP} || ':area' || k || ':4'"
_AREA_OF = "'function:/shop/nation/n' || n || '.ts:area' || n || ':4'"


def _ts(spark, sf):
    """TypeScript constructs, written once: every check reads them in more than one place."""
    return written(typescript.decorate(typescript.tokens(b.ts_src(spark, sf))), "ts")


def _ts_parts(spark, sf):
    """(constructs, declared names, imported names, resolved imports, files)."""
    d = _ts(spark, sf)
    files = b.ts_src(spark, sf).select("path")
    imports = written(resolve.resolve_imports(typescript.import_rows(d), files), "imports")
    decls = written(resolve.declared(typescript.nodes(d), typescript.export_rows(d)), "declared")
    return d, decls, resolve.imported_names(imports), imports, files


@query(facts(_S, "entity_id, name, start_line, end_line, complexity, is_exported, is_async, documentation, tags, return_type",
             f"{_SHIP}, 'ship' || k, 10, 20, 4, true, true, 'Ships goods.', 'param,returns', 'Promise<void>'",
             f"{_LOAD}, 'load' || k, 21, 24, 3, false, false, NULL, NULL, 'any'",
             f"{_BACK}, 'callback_rest_forEach_arg0', 18, 18, 1, false, false, NULL, NULL, 'any'")
       + "\nUNION ALL " + facts(_N, "a, b, c, d, e, f, g, h, i, j", f"{_AREA}, 'area' || k, 4, 4, 3, true, false, NULL, NULL, 'number'"))
def ts_functions(spark, sf):
    """Functions and callbacks with flags, docs and complexity."""
    n = typescript.nodes(_ts(spark, sf)).where("kind = 'Function'")
    return n.select("entity_id", "name", "start_line", "end_line", "complexity", "is_exported", "is_async", "documentation",
                    F.array_join("tags", ",").alias("tags"), "return_type")


@query(facts(_S, "kind, entity_id, start_line, end_line, is_abstract, implements",
             f"'Class', 'class:' || {_SP} || ':supplier' || k, 25, 28, false, 'Rated'")
       + "\nUNION ALL " + facts(_N, "a, b, c, d, e, f",
                                f"'Class', 'class:' || {_NP} || ':nation' || k, 1, 3, true, NULL",
                                f"'Interface', 'interface:' || {_NP} || ':place' || k, 5, 7, NULL, NULL",
                                f"'TypeAlias', 'typealias:' || {_NP} || ':code' || k, 8, 8, NULL, NULL")
       + "\nUNION ALL " + facts(_R, "a, b, c, d, e, f", "'Interface', 'interface:/shop/region/' || f || '.ts:region' || k, 1, 1, NULL, NULL"))
def ts_types(spark, sf):
    """Classes, interfaces and aliases."""
    n = typescript.nodes(_ts(spark, sf)).where("kind in ('Class', 'Interface', 'TypeAlias')")
    return n.select("kind", "entity_id", "start_line", "end_line", "is_abstract", F.array_join("implements", ",").alias("implements"))


@query(facts(_S, "source_id, target_id, visibility, is_static, is_async, signature",
             f"'class:' || {_SP} || ':supplier' || k, {_OPEN}, 'private', true, true, NULL",
             f"'class:' || {_SP} || ':supplier' || k, {_CLOSE}, 'protected', false, false, NULL")
       + "\nUNION ALL " + facts(_N, "a, b, c, d, e, f",
                                f"'class:' || {_NP} || ':nation' || k, 'method:' || {_NP} || ':nation' || k || '.label', 'public', false, false, NULL",
                                f"'interface:' || {_NP} || ':place' || k, 'method:' || {_NP} || ':place' || k || '.size', 'public', false, false, 'true'")
       + "\nUNION ALL " + facts(_R, "a, b, c, d, e, f", "'interface:/shop/region/' || f || '.ts:region' || k, 'method:/shop/region/' || f || '.ts:region' || k || '.size', 'public', false, false, 'true'"))
def ts_methods(spark, sf):
    """Methods and signatures with their owner."""
    d = _ts(spark, sf)
    e = typescript.edges(d).where("type = 'HAS_METHOD'").select("source_id", "target_id")
    n = typescript.nodes(d).where("kind = 'Method'").select(
        F.col("entity_id").alias("target_id"), "visibility", "is_static", "is_async",
        F.element_at("properties", "isSignature").alias("signature"))
    return e.join(n, "target_id")


@query(facts(_S, "parent_id, name, type, is_optional, is_rest",
             f"{_SHIP}, 'qty', 'number', false, false", f"{_SHIP}, 'note', 'string', true, false", f"{_SHIP}, 'rest', 'string[]', true, true",
             f"{_LOAD}, 'qty', 'any', false, false", f"{_BACK}, 'r', 'any', false, false", f"{_BACK}, 'i', 'any', false, false",
             f"{_OPEN}, 'a', 'string', false, false", f"{_OPEN}, 'b', 'any', true, false", f"{_CLOSE}, 'a', 'string', false, false")
       + "\nUNION ALL " + facts(_N, "a, b, c, d, e", f"{_AREA}, 'x', 'number', false, false",
                                f"'method:' || {_NP} || ':place' || k || '.size', 'unit', 'string', false, false"))
def ts_parameters(spark, sf):
    """Parameters with type and flags."""
    n = typescript.nodes(_ts(spark, sf)).where("kind = 'Parameter'")
    return n.select("parent_id", "name", "type", "is_optional", "is_rest")


@query(facts(_S, "entity_id, name, type, modifiers, is_constant, is_exported",
             f"'variable:' || {_SP} || ':rate' || k || ':4', 'rate' || k, 'number', 'export,let', false, true",
             f"'variable:' || {_SP} || ':spare:4', 'spare', 'any', 'export,let', false, true"))
def ts_variables(spark, sf):
    """Variables of a module; those inside functions are none."""
    n = typescript.nodes(_ts(spark, sf)).where("kind = 'Variable'")
    return n.select("entity_id", "name", "type", F.array_join("modifiers", ",").alias("modifiers"), "is_constant", "is_exported")


_C = "(SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS n FROM customer)"
_CP = "'/shop/note/c' || k || '.ts'"
_PICK, _TEXT = f"'function:' || {_CP} || ':pick' || k || ':3'", f"'function:' || {_CP} || ':text' || k || ':6'"


def _note_parts(spark, sf):
    """(constructs, declared names, imported names) of the notes."""
    src = b.note_src(spark, sf)
    d = written(typescript.decorate(typescript.tokens(src)), "notes")
    imports = written(resolve.resolve_imports(typescript.import_rows(d), src.select("path")), "imports")
    decls = written(resolve.declared(typescript.nodes(d), typescript.export_rows(d)), "declared")
    return d, decls, resolve.imported_names(imports)


def _declared(name: str, line: int, type_: str, modifiers: str) -> str:
    flags = ", ".join(str(w in modifiers).lower() for w in ("const", "export"))
    return f"'variable:' || {_CP} || ':{name}' || k || ':{line}', '{name}' || k, '{type_}', '{modifiers}', {flags}"


@query(facts(_C, "entity_id, name, type, modifiers, is_constant, is_exported",
             _declared("quote", 2, "any", "const"), _declared("half", 2, "any", "const"), _declared("names", 2, "Map<string, number>", "const"),
             _declared("last", 3, "[string, number]", "const"), _declared("open", 4, "(a: number, b: string) => void", "export,let"),
             _declared("shut", 4, "any", "export,let"), _declared("one", 5, "any", "var"), _declared("two", 5, "any", "var")))
def ts_declarators(spark, sf):
    """Every declarator of a statement, function values and loop headers aside."""
    n = typescript.nodes(_note_parts(spark, sf)[0]).where("kind = 'Variable'")
    return n.select("entity_id", "name", "type", F.array_join("modifiers", ",").alias("modifiers"), "is_constant", "is_exported")


@query(facts(_C, "source_id, target_id, line, is_conditional, is_awaited, weight",
             f"{_TEXT}, {_AREA_OF}, 7, 'false', 'false', 6", f"{_TEXT}, {_PICK}, 7, 'true', 'false', 7",
             f"{_TEXT}, 'unresolved:line.split', 10, 'false', 'false', 7", f"{_TEXT}, 'unresolved:note' || k, 10, 'false', 'false', 7",
             f"{_PICK}, 'unresolved:keen' || k, 3, 'false', 'false', 7"))
def ts_nested_calls(spark, sf):
    """Calls in templates to any depth, beside regular expressions and divisions."""
    d, decls, names = _note_parts(spark, sf)
    e = resolve.resolve_calls(typescript.call_sites(d), decls, names)
    p = lambda k: F.element_at("properties", k)
    return e.select("source_id", "target_id", p("callSiteLine").cast("int").alias("line"), p("isConditional").alias("is_conditional"),
                    p("isAwaited").alias("is_awaited"), "weight")


@query(facts(_C, "source_id, target_id, line, is_placeholder",
             f"{_TEXT}, 'variable:' || {_CP} || ':open' || k || ':4', 8, 'false'", f"{_TEXT}, 'variable:' || {_CP} || ':shut' || k || ':4', 9, 'false'"))
def ts_nested_mutations(spark, sf):
    """Assignments beside divisions and templates; declarators assign nothing."""
    d, decls, names = _note_parts(spark, sf)
    e = resolve.resolve_mutations(typescript.assignments(d), decls, names)
    p = lambda k: F.element_at("properties", k)
    return e.select("source_id", "target_id", p("startLine").cast("int").alias("line"), p("isPlaceholder").alias("is_placeholder"))


@query(facts(_S, "entity_id, module, named, def, space, type_only",
             f"'import:' || {_SP} || ':../nation/n' || n || ':1', '../nation/n' || n, 'Nation' || n || ',area' || n, NULL, NULL, 'false'",
             f"'import:' || {_SP} || ':../nation/n' || n || '.js:2', '../nation/n' || n || '.js', NULL, 'home', 'world', 'false'",
             f"'import:' || {_SP} || ':../shared/rated:3', '../shared/rated', 'Rated', NULL, NULL, 'true'"))
def ts_imports(spark, sf):
    """Import statements and their parts."""
    n = typescript.nodes(_ts(spark, sf)).where("kind = 'Import'")
    p = lambda k: F.element_at("properties", k)
    return n.select("entity_id", p("moduleSpecifier").alias("module"), p("namedImports").alias("named"),
                    p("defaultImport").alias("def"), p("namespaceImport").alias("space"), p("isTypeOnly").alias("type_only"))


@query(facts(_S, "source_id, target_id, symbols, is_placeholder, type_only",
             f"'file:' || {_SP}, 'file:/shop/nation/n' || n || '.ts', 'Nation' || n || ',area', 'false', 'false'",
             f"'file:' || {_SP}, 'file:/shop/shared/rated', 'Rated', 'true', 'true'"))
def ts_import_files(spark, sf):
    """Imports resolved to files, one edge per pair, misses as placeholders."""
    e = resolve.import_edges(_ts_parts(spark, sf)[3])
    p = lambda k: F.element_at("properties", k)
    return e.select("source_id", "target_id", p("importedSymbols").alias("symbols"), p("isPlaceholder").alias("is_placeholder"),
                    p("isTypeOnly").alias("type_only"))


@query(facts(_S, "source_id, target_id, symbol, form",
             f"'import:' || {_SP} || ':../nation/n' || n || ':1', 'class:/shop/nation/n' || n || '.ts:nation' || n, 'Nation' || n, 'named'",
             f"'import:' || {_SP} || ':../nation/n' || n || ':1', {_AREA_OF}, 'area', 'named'",
             f"'import:' || {_SP} || ':../nation/n' || n || '.js:2', {_AREA_OF}, 'home', 'default'",
             f"'import:' || {_SP} || ':../nation/n' || n || '.js:2', 'file:/shop/nation/n' || n || '.ts', 'world', 'namespace'"))
def ts_import_symbols(spark, sf):
    """Imported names resolved to exported declarations, default and namespace included."""
    _, decls, names, _, _ = _ts_parts(spark, sf)
    e = resolve.resolve_symbols(names, decls)
    p = lambda k: F.element_at("properties", k)
    form = F.when(p("isDefaultImport").isNotNull(), "default").when(p("isNamespaceImport").isNotNull(), "namespace").otherwise("named")
    return e.select("source_id", "target_id", p("importedSymbol").alias("symbol"), form.alias("form"))


@query(facts(_S, "source_id, target_id, weight, suffix", f"'file:' || {_SP}, {_LOAD}, 8, NULL")
       + "\nUNION ALL " + facts(_N, "a, b, c, d", f"'file:' || {_NP}, {_AREA}, 8, 'default'",
                                f"'file:' || {_NP}, 'file:/shop/region/index.ts', 4, 'reexport'"))
def ts_exports(spark, sf):
    """Local export lists, default exports, re-exports of a folder's index."""
    d, decls, _, _, files = _ts_parts(spark, sf)
    rows = typescript.export_rows(d)
    e = resolve.exports(rows, decls).unionByName(resolve.reexports(rows, files))
    suffix = F.nullif(F.regexp_extract("entity_id", r":(default|reexport)$", 1), F.lit(""))
    return e.select("source_id", "target_id", "weight", suffix.alias("suffix"))


@query(facts(_S, "source_id, target_id, line, is_conditional, is_awaited, weight",
             f"{_SHIP}, {_AREA_OF}, 13, 'true', 'false', 6", f"{_SHIP}, {_LOAD}, 14, 'false', 'true', 7",
             f"{_SHIP}, 'unresolved:rest.foreach', 18, 'false', 'false', 7", f"{_SHIP}, 'unresolved:track', 18, 'false', 'false', 7",
             f"{_SHIP}, 'unresolved:risky', 19, 'false', 'false', 7", f"{_SHIP}, 'unresolved:log', 19, 'false', 'false', 7",
             f"{_LOAD}, 'unresolved:track', 22, 'true', 'false', 7", f"{_LOAD}, {_AREA_OF}, 23, 'true', 'false', 6",
             f"{_LOAD}, 'unresolved:lone' || k, 23, 'true', 'false', 7",
             f"{_OPEN}, {_CLOSE}, 26, 'false', 'false', 7", f"{_CLOSE}, {_LOAD}, 27, 'false', 'false', 7"))
def ts_calls(spark, sf):
    """Calls resolved in the file, through imports, or left as placeholders."""
    d, decls, names, _, _ = _ts_parts(spark, sf)
    e = resolve.resolve_calls(typescript.call_sites(d), decls, names)
    p = lambda k: F.element_at("properties", k)
    return e.select("source_id", "target_id", p("callSiteLine").cast("int").alias("line"), p("isConditional").alias("is_conditional"),
                    p("isAwaited").alias("is_awaited"), "weight")


@query(facts(_S, "source_id, target_id, line, is_placeholder",
             f"{_SHIP}, 'variable:' || {_SP} || ':rate' || k || ':4', 15, 'false'", f"{_CLOSE}, 'unresolved:state', 27, 'true'"))
def ts_mutations(spark, sf):
    """Assignments to variables and properties."""
    d, decls, names, _, _ = _ts_parts(spark, sf)
    e = resolve.resolve_mutations(typescript.assignments(d), decls, names)
    p = lambda k: F.element_at("properties", k)
    return e.select("source_id", "target_id", p("startLine").cast("int").alias("line"), p("isPlaceholder").alias("is_placeholder"))


@query(facts(_S, "source_id, target_id, weight", f"{_SHIP}, 'parameter:' || {_SHIP} || ':catch:e:19', 5"))
def ts_error_handlers(spark, sf):
    """Catch clauses."""
    return typescript.handlers(_ts(spark, sf)).select("source_id", "target_id", "weight")


@query(facts(_S, "type, source_id, target_id, is_placeholder",
             f"'EXTENDS', 'class:' || {_SP} || ':supplier' || k, 'class:/shop/nation/n' || n || '.ts:nation' || n, 'false'",
             f"'IMPLEMENTS', 'class:' || {_SP} || ':supplier' || k, 'unresolved:rated', 'true'")
       + "\nUNION ALL " + facts(_N, "a, b, c, d", f"'EXTENDS', 'interface:' || {_NP} || ':place' || k, 'unresolved:base' || r, 'true'"))
def ts_heritage(spark, sf):
    """Base classes and interfaces."""
    d, decls, names, _, _ = _ts_parts(spark, sf)
    e = resolve.resolve_heritage(typescript.heritage_rows(d), decls, names)
    return e.select("type", "source_id", "target_id", F.element_at("properties", "isPlaceholder").alias("is_placeholder"))


_C = "(SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS n, lower(c_mktsegment) AS seg, c_name AS cname FROM customer)"
_G = "(SELECT DISTINCT lower(c_mktsegment) AS seg FROM customer)"
_CP, _GP = "'/ui/c' || k || '.tsx'", "'/ui/seg/' || seg || '.tsx'"
_DIV, _USE = f"'jsxelement:' || {_CP} || ':div:4:4'", f"'jsxelement:' || {_CP} || ':' || seg || ':6:6'"
_COMP, _SCOMP = f"'component:' || {_CP} || ':customer' || k", f"'component:' || {_GP} || ':' || seg"
_BOLD = f"'jsxelement:' || {_GP} || ':b:2:9'"


def _tsx(spark, sf):
    src = b.tsx_src(spark, sf)
    d = written(typescript.decorate(typescript.tokens(src)), "tsx")
    els = written(markup.elements(src), "elements")
    return src, d, els, components.component_spans(d, els)


@query(facts(_C, "entity_id, start_line, end_line, is_exported", f"{_COMP}, 2, 9, true")
       + "\nUNION ALL " + facts(_G, "a, b, c, d", f"{_SCOMP}, 1, 3, true"))
def tsx_components(spark, sf):
    """Components by name and markup."""
    return components.nodes(_tsx(spark, sf)[3]).select("entity_id", "start_line", "end_line", "is_exported")


@query(facts(_C, "source_id, target_id", f"{_COMP}, {_DIV}", f"{_DIV}, {_USE}")
       + "\nUNION ALL " + facts(_G, "a, b", f"{_SCOMP}, {_BOLD}"))
def tsx_nesting(spark, sf):
    """Elements under their component or parent element."""
    _, _, els, spans = _tsx(spark, sf)
    e = markup.edges(els).unionByName(components.edges(els, spans)).where("type = 'RENDERS_ELEMENT'")
    return e.select("source_id", "target_id")


@query(facts(_C, "parent_id, name, value", f"{_DIV}, 'className', 'p-' || n || ' flex  m-1'", f"{_DIV}, 'id', 'c' || k",
             f"{_USE}, 'key', '{{' || k || '}}'".replace("{{", "{").replace("}}", "}"), f"{_USE}, 'title', cname", f"{_USE}, 'bold', 'true'")
       + "\nUNION ALL " + facts(_G, "a, b, c", f"{_BOLD}, 'className', 'flex'"))
def tsx_attributes(spark, sf):
    """Attribute values of each form."""
    n = markup.nodes(markup.elements(b.tsx_src(spark, sf))).where("kind = 'JSXAttribute'")
    return n.select("parent_id", "name", F.element_at("properties", "value").alias("value"))


@query(facts(_C, "source_id, target_id", f"{_DIV}, 'tailwindclass:p-' || n", f"{_DIV}, 'tailwindclass:flex'", f"{_DIV}, 'tailwindclass:m-1'")
       + "\nUNION ALL " + facts(_G, "a, b", f"{_BOLD}, 'tailwindclass:flex'"))
def tsx_class_edges(spark, sf):
    """Elements and the class tokens they use."""
    e = markup.edges(markup.elements(b.tsx_src(spark, sf))).where("type = 'USES_TAILWIND_CLASS'")
    return e.select("source_id", "target_id")


@query(facts(_C, "source_id, target_id, cross_file", f"{_COMP}, {_SCOMP}, 'true'"))
def tsx_component_uses(spark, sf):
    """Components used by components of other files."""
    src, d, els, spans = _tsx(spark, sf)
    names = resolve.imported_names(resolve.resolve_imports(typescript.import_rows(d), src.select("path")))
    e = resolve.uses_component(components.owners(els, spans), els, components.nodes(spans), names)
    return e.select("source_id", "target_id", F.element_at("properties", "isCrossFile").alias("cross_file"))


_P = ("(SELECT CAST(p_partkey AS VARCHAR) AS k, lower(p_type) AS t, CAST(p_size AS VARCHAR) AS size, "
      "lower(replace(p_brand, '#', '')) AS brand FROM part)")
_JP = "'/java/part' || k || '.java'"
_JC, _JI = "'javaclass:shop.' || t || '.part' || k", "'javainterface:shop.' || t || '.item' || k"


@query(facts(_P, "kind, entity_id, start_line, end_line, parent_id",
             f"'PackageDeclaration', 'packagedeclaration:' || {_JP} || ':shop.' || t, 1, 1, NULL",
             f"'ImportDeclaration', 'importdeclaration:' || {_JP} || ':java.util.list:3', 3, 3, NULL",
             f"'ImportDeclaration', 'importdeclaration:' || {_JP} || ':shop.brand:4', 4, 4, NULL",
             f"'JavaClass', {_JC}, 7, 16, NULL", f"'JavaInterface', {_JI}, 17, 19, NULL",
             f"'JavaEnum', 'javaenum:shop.' || t || '.grade', 15, 15, NULL",
             f"'JavaField', 'javafield:' || {_JC} || '.names', 8, 8, {_JC}", f"'JavaField', 'javafield:' || {_JC} || '.size', 9, 9, {_JC}",
             f"'JavaField', 'javafield:' || {_JC} || '.weight', 9, 9, {_JC}",
             f"'JavaMethod', 'javamethod:' || {_JC} || '.part' || k, 10, 10, {_JC}",
             f"'JavaMethod', 'javamethod:' || {_JC} || '.getsize' || k, 11, 14, {_JC}",
             f"'JavaMethod', 'javamethod:' || {_JI} || '.use' || k, 18, 18, {_JI}"))
def java_nodes(spark, sf):
    """E5, E9, E11, E17 (Java): packages, imports, types, members with owners."""
    n = java.nodes(java.decorate(b.java_src(spark, sf)))
    return n.select("kind", "entity_id", "start_line", "end_line", "parent_id")


@query(facts(_P, "type, source_id, target_id, weight",
             f"'DECLARES_PACKAGE', 'file:' || {_JP}, 'packagedeclaration:' || {_JP} || ':shop.' || t, 9",
             f"'JAVA_IMPORTS', 'file:' || {_JP}, 'importdeclaration:' || {_JP} || ':java.util.list:3', 5",
             f"'JAVA_IMPORTS', 'file:' || {_JP}, 'importdeclaration:' || {_JP} || ':shop.brand:4', 5",
             f"'DEFINES_CLASS', 'file:' || {_JP}, {_JC}, 9", f"'DEFINES_INTERFACE', 'file:' || {_JP}, {_JI}, 9",
             f"'DEFINES_ENUM', 'file:' || {_JP}, 'javaenum:shop.' || t || '.grade', 9",
             f"'HAS_FIELD', {_JC}, 'javafield:' || {_JC} || '.names', 7", f"'HAS_FIELD', {_JC}, 'javafield:' || {_JC} || '.size', 7",
             f"'HAS_FIELD', {_JC}, 'javafield:' || {_JC} || '.weight', 7",
             f"'HAS_METHOD', {_JC}, 'javamethod:' || {_JC} || '.part' || k, 8",
             f"'HAS_METHOD', {_JC}, 'javamethod:' || {_JC} || '.getsize' || k, 8",
             f"'HAS_METHOD', {_JI}, 'javamethod:' || {_JI} || '.use' || k, 8"))
def java_edges(spark, sf):
    """E5, E9, E11, E17 (Java): edges with weights."""
    return java.edges(java.decorate(b.java_src(spark, sf))).select("type", "source_id", "target_id", "weight")


_O = "(SELECT CAST(o_orderkey AS VARCHAR) AS k, lower(o_orderstatus) AS s, CAST(o_custkey AS VARCHAR) AS c FROM orders)"
_OP = "'/go/o' || k || '.go'"
_GS = "'gostruct:p' || s || '.order' || k"


@query(facts(_O, "kind, entity_id, start_line, end_line, parent_id",
             f"'PackageClause', 'packageclause:' || {_OP} || ':p' || s, 1, 1, NULL",
             f"'ImportSpec', 'importspec:' || {_OP} || ':fmt:4', 4, 4, NULL", f"'ImportSpec', 'importspec:' || {_OP} || ':net/http:5', 5, 5, NULL",
             f"'GoStruct', {_GS}, 8, 10, NULL", "'TypeAlias', 'typealias:p' || s || '.key' || k, 12, 12, NULL",
             "'GoFunction', 'gofunction:p' || s || '.new' || k, 14, 16, NULL",
             f"'GoMethod', 'gomethod:order' || k || '.total' || c, 18, 21, {_GS}"))
def go_nodes(spark, sf):
    """E6, E9–E11 (Go): package, import block with alias, types, functions, pointer receivers."""
    n = golang.nodes(golang.decorate(b.go_src(spark, sf)))
    return n.select("kind", "entity_id", "start_line", "end_line", "parent_id")


@query(facts(_O, "type, source_id, target_id, weight",
             f"'DECLARES_PACKAGE', 'file:' || {_OP}, 'packageclause:' || {_OP} || ':p' || s, 9",
             f"'GO_IMPORTS', 'file:' || {_OP}, 'importspec:' || {_OP} || ':fmt:4', 5",
             f"'GO_IMPORTS', 'file:' || {_OP}, 'importspec:' || {_OP} || ':net/http:5', 5",
             f"'DEFINES_STRUCT', 'file:' || {_OP}, {_GS}, 9", f"'DEFINES_FUNCTION', 'file:' || {_OP}, 'gofunction:p' || s || '.new' || k, 8",
             f"'HAS_METHOD', {_GS}, 'gomethod:order' || k || '.total' || c, 8"))
def go_edges(spark, sf):
    """E6, E9–E11 (Go): edges with weights."""
    return golang.edges(golang.decorate(b.go_src(spark, sf))).select("type", "source_id", "target_id", "weight")


_KP = "'/cs/c' || k || '.cs'"
_NS, _KC = f"'namespacedeclaration:' || {_KP} || ':shop.' || seg", "'csharpclass:shop.' || seg || '.customer' || k"
_KI, _KS = "'csharpinterface:shop.' || seg || '.iknown' || k", "'csharpstruct:shop.' || seg || '.point' || k"


@query(facts(_C, "kind, entity_id, start_line, end_line, parent_id",
             f"'UsingDirective', 'usingdirective:' || {_KP} || ':system:1', 1, 1, NULL",
             f"'UsingDirective', 'usingdirective:' || {_KP} || ':system.math:2', 2, 2, NULL",
             f"'UsingDirective', 'usingdirective:' || {_KP} || ':system.text:3', 3, 3, NULL",
             f"'NamespaceDeclaration', {_NS}, 5, 19, NULL", f"'CSharpClass', {_KC}, 7, 16, {_NS}",
             f"'CSharpInterface', {_KI}, 17, 17, {_NS}", f"'CSharpStruct', {_KS}, 18, 18, {_NS}",
             f"'Field', 'field:' || {_KC} || '.nation', 9, 9, {_KC}", f"'Field', 'field:' || {_KC} || '.region', 9, 9, {_KC}",
             f"'Field', 'field:' || {_KS} || '.x', 18, 18, {_KS}", f"'Property', 'property:' || {_KC} || '.name', 10, 10, {_KC}",
             f"'CSharpMethod', 'csharpmethod:' || {_KC} || '.customer' || k, 11, 11, {_KC}",
             f"'CSharpMethod', 'csharpmethod:' || {_KC} || '.nation' || k, 12, 15, {_KC}",
             f"'CSharpMethod', 'csharpmethod:' || {_KI} || '.known', 17, 17, {_KI}"))
def csharp_nodes(spark, sf):
    """E7, E9, E11, E17 (C#): usings, namespace, types, members."""
    n = csharp.nodes(csharp.decorate(b.cs_src(spark, sf)))
    return n.select("kind", "entity_id", "start_line", "end_line", "parent_id")


@query(facts(_C, "type, source_id, target_id, weight",
             f"'CSHARP_USING', 'file:' || {_KP}, 'usingdirective:' || {_KP} || ':system:1', 5",
             f"'CSHARP_USING', 'file:' || {_KP}, 'usingdirective:' || {_KP} || ':system.math:2', 5",
             f"'CSHARP_USING', 'file:' || {_KP}, 'usingdirective:' || {_KP} || ':system.text:3', 5",
             f"'DECLARES_NAMESPACE', 'file:' || {_KP}, {_NS}, 9", f"'DEFINES_CLASS', {_NS}, {_KC}, 9",
             f"'DEFINES_INTERFACE', {_NS}, {_KI}, 9", f"'DEFINES_STRUCT', {_NS}, {_KS}, 9",
             f"'HAS_FIELD', {_KC}, 'field:' || {_KC} || '.nation', 7", f"'HAS_FIELD', {_KC}, 'field:' || {_KC} || '.region', 7",
             f"'HAS_FIELD', {_KS}, 'field:' || {_KS} || '.x', 7", f"'HAS_PROPERTY', {_KC}, 'property:' || {_KC} || '.name', 7",
             f"'HAS_METHOD', {_KC}, 'csharpmethod:' || {_KC} || '.customer' || k, 8",
             f"'HAS_METHOD', {_KC}, 'csharpmethod:' || {_KC} || '.nation' || k, 8",
             f"'HAS_METHOD', {_KI}, 'csharpmethod:' || {_KI} || '.known', 8"))
def csharp_edges(spark, sf):
    """E7, E9, E11, E17 (C#): edges with weights."""
    return csharp.edges(csharp.decorate(b.cs_src(spark, sf))).select("type", "source_id", "target_id", "weight")


_XP, _XC = "'/cpp/p' || k || '.cpp'", "'cppclass:/cpp/p' || k || '.cpp:part' || k"
_H = "(SELECT DISTINCT lower(replace(p_brand, '#', '')) AS brand FROM part WHERE NOT p_brand LIKE '%1')"
_HP = "'/cpp/' || brand || '.h'"


@query(facts(_P, "kind, entity_id, start_line, end_line, parent_id",
             f"'IncludeDirective', 'includedirective:' || {_XP} || ':_' || brand || '.h_:1', 1, 1, NULL",
             f"'IncludeDirective', 'includedirective:' || {_XP} || ':_vector_:2', 2, 2, NULL",
             f"'MacroDefinition', 'macrodefinition:' || {_XP} || ':size' || k || ':3', 3, 3, NULL", f"'CppClass', {_XC}, 5, 12, NULL",
             f"'CppMethod', 'cppmethod:' || {_XP} || ':price:7', 7, 7, {_XC}", f"'CppMethod', 'cppmethod:' || {_XP} || ':part' || k || ':8', 8, 8, {_XC}",
             f"'CppMethod', 'cppmethod:' || {_XP} || ':twice:9', 9, 9, {_XC}",
             f"'CFunction', 'cfunction:' || {_XP} || ':make' || k || ':14', 14, 17, NULL")
       + "\nUNION ALL " + facts(_H, "a, b, c, d, e", f"'MacroDefinition', 'macrodefinition:' || {_HP} || ':' || brand || ':1', 1, 1, NULL",
                                f"'CFunction', 'cfunction:' || {_HP} || ':' || brand || '_id:2', 2, 2, NULL"))
def cpp_nodes(spark, sf):
    """E8–E11 (C, C++): includes, macros, classes, methods with owners, free functions."""
    n = cfamily.nodes(cfamily.decorate(b.cpp_src(spark, sf)))
    return n.select("kind", "entity_id", "start_line", "end_line", "parent_id")


@query(facts(_P, "source_id, target_id, is_placeholder",
             f"'file:' || {_XP}, CASE WHEN brand LIKE '%1' THEN 'file:' || brand || '.h' ELSE 'file:/cpp/' || brand || '.h' END, CASE WHEN brand LIKE '%1' THEN 'true' ELSE 'false' END",
             f"'file:' || {_XP}, 'file:vector', 'true'"))
def cpp_includes(spark, sf):
    """Includes resolved to files of the corpus."""
    src = b.cpp_src(spark, sf)
    rows = resolve.include_rows(cfamily.nodes(cfamily.decorate(src)))
    e = resolve.resolve_includes(rows, src.select("path"))
    return e.select("source_id", "target_id", F.element_at("properties", "isPlaceholder").alias("is_placeholder"))


@query(facts(_P, "source_id, target_id", f"{_XC}, 'unresolved:base'", f"{_XC}, 'unresolved:item'"))
def cpp_heritage(spark, sf):
    """E30, J10 (C++): base classes."""
    d = written(cfamily.decorate(b.cpp_src(spark, sf)), "cpp")
    decls = resolve.declared(cfamily.nodes(d), kinds=["CppClass"])
    return resolve.resolve_heritage(cfamily.heritage_rows(d), decls, None).select("source_id", "target_id")


_YP, _PYC = "'/py/c' || k || '.py'", "'pythonclass:/py/c' || k || '.py:Customer' || k"
_INIT, _VISIT = "'pythonmethod:/py/c' || k || '.py:Customer' || k || '.__init__'", "'pythonmethod:/py/c' || k || '.py:Customer' || k || '.visit'"
_HELP = "'pythonfunction:/py/c' || k || '.py:helper' || k"


@query(facts(_C, "kind, entity_id, start_line, end_line, parent_id",
             "'PythonModule', 'pythonmodule:os', 1, 1, NULL", "'PythonModule', 'pythonmodule:sys', 1, 1, NULL",
             "'PythonModule', 'pythonmodule:shop.' || seg, 2, 2, NULL",
             f"'PythonVariable', 'pythonvariable:' || {_YP} || ':LIMIT' || k || ':3', 3, 3, 'file:' || {_YP}",
             f"'PythonVariable', 'pythonvariable:' || {_YP} || ':kind:6', 6, 6, {_PYC}",
             f"'PythonVariable', 'pythonvariable:' || {_YP} || ':label:10', 10, 10, {_INIT}",
             f"'PythonVariable', 'pythonvariable:' || {_YP} || ':total:17', 17, 17, {_HELP}",
             f"'PythonClass', {_PYC}, 5, 13, NULL", f"'PythonMethod', {_INIT}, 8, 10, {_PYC}", f"'PythonMethod', {_VISIT}, 12, 13, {_PYC}",
             f"'PythonFunction', {_HELP}, 16, 18, NULL",
             f"'PythonParameter', 'pythonparameter:' || {_YP} || ':self:8', 8, 8, {_INIT}", f"'PythonParameter', 'pythonparameter:' || {_YP} || ':name:8', 8, 8, {_INIT}",
             f"'PythonParameter', 'pythonparameter:' || {_YP} || ':self:12', 12, 12, {_VISIT}", f"'PythonParameter', 'pythonparameter:' || {_YP} || ':place:12', 12, 12, {_VISIT}",
             f"'PythonParameter', 'pythonparameter:' || {_YP} || ':x:16', 16, 16, {_HELP}", f"'PythonParameter', 'pythonparameter:' || {_YP} || ':y:16', 16, 16, {_HELP}"))
def python_nodes(spark, sf):
    """E4, E9–E12, E17, E28 (Python): all declarations with their scope."""
    n = python.nodes(python.decorate(b.py_src(spark, sf)))
    return n.select("kind", "entity_id", "start_line", "end_line", "parent_id")


@query(facts(_C, "type, source_id, target_id",
             f"'PYTHON_IMPORTS', 'file:' || {_YP}, 'pythonmodule:os'", f"'PYTHON_IMPORTS', 'file:' || {_YP}, 'pythonmodule:sys'",
             f"'PYTHON_IMPORTS', 'file:' || {_YP}, 'pythonmodule:shop.' || seg",
             f"'PYTHON_DEFINES_CLASS', 'file:' || {_YP}, {_PYC}", f"'PYTHON_DEFINES_FUNCTION', 'file:' || {_YP}, {_HELP}",
             f"'PYTHON_HAS_METHOD', {_PYC}, {_INIT}", f"'PYTHON_HAS_METHOD', {_PYC}, {_VISIT}",
             f"'PYTHON_HAS_PARAMETER', {_INIT}, 'pythonparameter:' || {_YP} || ':self:8'", f"'PYTHON_HAS_PARAMETER', {_INIT}, 'pythonparameter:' || {_YP} || ':name:8'",
             f"'PYTHON_HAS_PARAMETER', {_VISIT}, 'pythonparameter:' || {_YP} || ':self:12'", f"'PYTHON_HAS_PARAMETER', {_VISIT}, 'pythonparameter:' || {_YP} || ':place:12'",
             f"'PYTHON_HAS_PARAMETER', {_HELP}, 'pythonparameter:' || {_YP} || ':x:16'", f"'PYTHON_HAS_PARAMETER', {_HELP}, 'pythonparameter:' || {_YP} || ':y:16'"))
def python_edges(spark, sf):
    """E4, E9–E12, E28 (Python): edges within files."""
    return python.edges(python.decorate(b.py_src(spark, sf))).select("type", "source_id", "target_id")


@query(facts(_C, "source_id, target_id, line, is_placeholder",
             f"{_INIT}, {_HELP}, 10, 'false'", f"{_VISIT}, 'pythonfunction:' || {_YP} || ':home', 13, 'true'",
             f"{_HELP}, 'pythonfunction:' || {_YP} || ':print', 18, 'true'", f"'file:' || {_YP}, {_HELP}, 21, 'false'"))
def python_calls(spark, sf):
    """E23, J12 (Python): calls by name within the file."""
    d = written(python.decorate(b.py_src(spark, sf)), "py")
    sites = python.call_sites(d)
    e = resolve.py_calls(sites, python.nodes(d))
    called = F.element_at("properties", "calledName").alias("name")
    e = e.select("source_id", "target_id", called, F.element_at("properties", "isPlaceholder").alias("is_placeholder"))
    first = sites.groupBy("source_id", "name").agg(F.min("line").alias("line"))
    return e.join(first, ["source_id", "name"]).drop("name")


_LP = "'/sql/p' || k || '.sql'"
_TAB, _VW = "'sqltable:shop.part' || k", "'sqlview:shop.view' || k"


@query(facts(_P, "kind, entity_id, name, start_line, end_line",
             f"'SQLTable', {_TAB}, 'part' || k, 2, 7", f"'SQLView', {_VW}, 'view' || k, 8, 8",
             f"'SQLInsertStatement', 'sqlinsertstatement:' || {_LP} || ':9:0', 'SQLInsertStatement_9', 9, 9",
             f"'SQLSelectStatement', 'sqlselectstatement:' || {_LP} || ':10:0', 'SQLSelectStatement_10', 10, 10",
             f"'SQLUpdateStatement', 'sqlupdatestatement:' || {_LP} || ':11:0', 'SQLUpdateStatement_11', 11, 11",
             f"'SQLDeleteStatement', 'sqldeletestatement:' || {_LP} || ':12:0', 'SQLDeleteStatement_12', 12, 12"))
def sql_objects(spark, sf):
    """Tables, views and statements."""
    n = sql.nodes(sql.decorate(b.sql_src(spark, sf))).where("kind <> 'SQLColumn'")
    return n.select("kind", "entity_id", "name", "start_line", "end_line")


@query(facts(_P, "source_id, target_id, data_type", f"{_TAB}, 'sqlcolumn:' || {_TAB} || '.id', 'INT'",
             f"{_TAB}, 'sqlcolumn:' || {_TAB} || '.price', 'DECIMAL(10, ' || size || ')'", f"{_TAB}, 'sqlcolumn:' || {_TAB} || '.label', 'VARCHAR(20)'"))
def sql_columns(spark, sf):
    """Columns with types; constraints are none."""
    d = sql.decorate(b.sql_src(spark, sf))
    return sql.columns(d).select(F.col("table_id").alias("source_id"), F.col("entity_id").alias("target_id"), "data_type")


@query(facts(_P, "type, source_id, target_id, is_placeholder",
             f"'REFERENCES_TABLE', {_VW}, {_TAB}, 'false'", f"'REFERENCES_TABLE', 'sqlinsertstatement:' || {_LP} || ':9:0', {_TAB}, 'false'",
             f"'REFERENCES_VIEW', 'sqlselectstatement:' || {_LP} || ':10:0', {_VW}, 'false'",
             f"'REFERENCES_TABLE', 'sqlselectstatement:' || {_LP} || ':10:0', 'sqltable:missing' || size, 'true'",
             f"'REFERENCES_TABLE', 'sqlupdatestatement:' || {_LP} || ':11:0', {_TAB}, 'false'",
             f"'REFERENCES_TABLE', 'sqldeletestatement:' || {_LP} || ':12:0', {_TAB}, 'false'"))
def sql_references(spark, sf):
    """What views and statements refer to."""
    d = written(sql.decorate(b.sql_src(spark, sf)), "sql")
    e = resolve.sql_references(sql.reference_rows(d), sql.nodes(d))
    return e.select("type", "source_id", "target_id", F.element_at("properties", "isPlaceholder").alias("is_placeholder"))


_PRICE, _FILL, _LOG = "'sqlfunction:shop.price' || k", "'sqlprocedure:shop.fill' || k", "'sqlprocedure:shop.log' || k"
_STOCK, _RP = "'sqltable:shop.stock' || k", "'/sql/r' || k || '.sql'"
_SELECT, _BASE = f"'sqlselectstatement:' || {_RP} || ':18:0'", "'sqlfunction:shop.base' || size"


@query(facts(_P, "kind, entity_id, name, start_line, end_line",
             f"'SQLFunction', {_PRICE}, 'price' || k, 2, 9", f"'SQLProcedure', {_FILL}, 'fill' || k, 10, 16", f"'SQLProcedure', {_LOG}, 'log' || k, 17, 17")
       + f"\nUNION ALL SELECT DISTINCT 'SQLFunction', {_BASE}, 'base' || size, 1, 1 FROM {_P}")
def sql_routines(spark, sf):
    """Functions and procedures whose bodies hold semicolons, quotes and nested blocks."""
    n = sql.nodes(sql.decorate(b.routine_src(spark, sf))).where("kind in ('SQLFunction', 'SQLProcedure')")
    return n.select("kind", "entity_id", "name", "start_line", "end_line")


@query(facts(_P, "type, source_id, target_id, is_placeholder",
             f"'CALLS_FUNCTION', {_PRICE}, {_BASE}, 'false'", f"'REFERENCES_TABLE', {_PRICE}, {_STOCK}, 'false'",
             f"'CALLS_FUNCTION', {_FILL}, {_PRICE}, 'false'", f"'CALLS_PROCEDURE', {_FILL}, {_LOG}, 'false'", f"'REFERENCES_TABLE', {_FILL}, {_STOCK}, 'false'",
             f"'CALLS_PROCEDURE', {_LOG}, {_FILL}, 'false'", f"'REFERENCES_TABLE', {_LOG}, {_STOCK}, 'false'",
             f"'CALLS_FUNCTION', {_SELECT}, {_PRICE}, 'false'", f"'REFERENCES_TABLE', {_SELECT}, {_STOCK}, 'false'"))
def sql_calls(spark, sf):
    """Calls of functions and procedures by routines and statements, and the tables that they use."""
    d = written(sql.decorate(b.routine_src(spark, sf)), "routines")
    e = resolve.sql_references(sql.reference_rows(d), sql.nodes(d))
    return e.select("type", "source_id", "target_id", F.element_at("properties", "isPlaceholder").alias("is_placeholder"))


@query(facts(_C, "path, what, name, line", f"{_YP}, 'import', 'os', 1", f"{_YP}, 'import', 'sys', 1", f"{_YP}, 'from', 'shop.' || seg, 2",
             f"{_YP}, 'assign', 'LIMIT' || k, 3", f"{_YP}, 'class', 'Customer' || k, 5", f"{_YP}, 'assign', 'kind', 6",
             f"{_YP}, 'function', '__init__', 8", f"{_YP}, 'parameter', 'self', 8", f"{_YP}, 'parameter', 'name', 8",
             f"{_YP}, 'assign', 'label', 10", f"{_YP}, 'call', 'helper' || k, 10", f"{_YP}, 'function', 'visit', 12",
             f"{_YP}, 'parameter', 'self', 12", f"{_YP}, 'parameter', 'place', 12", f"{_YP}, 'call', 'home', 13",
             f"{_YP}, 'function', 'helper' || k, 16", f"{_YP}, 'parameter', 'x', 16", f"{_YP}, 'parameter', 'y', 16",
             f"{_YP}, 'assign', 'total', 17", f"{_YP}, 'call', 'print', 18", f"{_YP}, 'call', 'helper' || k, 21"))
def python_facts_sql(spark, sf):
    """The Python extractor as a SQL table function."""
    python.register_python_facts(spark)
    b.py_src(spark, sf).createOrReplaceTempView("strata_py_src")
    return spark.sql("SELECT path, f.what, f.name, f.line FROM strata_py_src, LATERAL python_facts(text) AS f")


_COUNTS = {
    "File": "s + n + r + 2 * c + g + 2 * p + h", "Function": "3 * s + n + c + g", "Import": "3 * s + c", "Class": "s + n",
    "Interface": "n + r", "TypeAlias": "n", "Variable": "2 * s", "Method": "2 * s + 2 * n + r", "Parameter": "9 * s + 2 * n + c + g",
    "Component": "c + g", "JSXElement": "2 * c + g", "JSXAttribute": "5 * c + g", "TailwindClass": "cn + 2",
    "IncludeDirective": "2 * p", "MacroDefinition": "p + h", "CppClass": "p", "CppMethod": "3 * p", "CFunction": "p + h",
    "PythonClass": "c", "PythonMethod": "2 * c", "PythonFunction": "c", "PythonVariable": "4 * c", "PythonParameter": "6 * c",
    "PythonModule": "2 + g", "SQLTable": "p", "SQLView": "p", "SQLColumn": "3 * p", "SQLSelectStatement": "p",
    "SQLInsertStatement": "p", "SQLUpdateStatement": "p", "SQLDeleteStatement": "p", "Directory": "10",
}


@query("""
WITH t AS (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r,
  (SELECT count(*) FROM customer) AS c, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS g, (SELECT count(DISTINCT c_nationkey) FROM customer) AS cn,
  (SELECT count(*) FROM part) AS p, (SELECT count(DISTINCT p_brand) FROM part WHERE NOT p_brand LIKE '%1') AS h)
""" + "\nUNION ALL ".join(f"SELECT '{k}' AS kind, CAST({v} AS BIGINT) AS n FROM t" for k, v in _COUNTS.items()))
def analyze_kinds(spark, sf):
    """The whole analysis over a corpus in five languages: nodes per kind, placeholders aside."""
    keep = ["path", "name", "extension", "language", "text"]
    src = [f(spark, sf).select(keep) for f in (b.ts_src, b.tsx_src, b.cpp_src, b.py_src, b.sql_src)]
    graph = analyze(union_facts(*src))
    return count_by(graph.nodes.where("kind <> 'Placeholder'"), "kind")
