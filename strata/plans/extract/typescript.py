"""TypeScript and JavaScript facts from tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.ids import TS_FAMILY, entity_id
from strata.functions.text import callback_name, doc_description, doc_tags, doc_text, name_or, type_or_any, visibility
from strata.model import edges_like, nodes_like
from strata.plans.extract.common import (
    strip, ARGS, BRACES, GENERIC, edge, explode_edges, file_id, group, keyword, nested, path_id, props, split_args)
from strata.plans.extract.lexical import Grammar, newlines, scan, tail
from strata.plans.extract.tslex import DECLARATORS, MARKS

_NAME = r"[A-Za-z_$][\w$]*"
_RET = r"(?:\s*:\s*[\w$.<>\[\]|&, \t'\"?]+?)?"
_EXPORT = rf"(?:{keyword('export')}\s+)?(?:\bdefault\s+)?(?:\bdeclare\s+)?"
_FROM = r"""\s*from\s*(?:'[^'\n]*'|"[^"\n]*")"""
_ARROW_ARGS = rf"(?:\basync\s+)?(?:{GENERIC}{ARGS}{_RET}|{_NAME})\s*=>\s*\{{?"
_FUNC_EXPR = rf"(?:\basync\s+)?\bfunction\b\s*\*?\s*(?:{_NAME})?\s*{GENERIC}{ARGS}{_RET}\s*\{{"
# A declared name, after its keyword or after the mark of a further declarator.
_DECL = rf"(?:{_EXPORT}{keyword(['const', 'let', 'var'])}\s+|[{MARKS}]\s*)"
_TYPE_PARTS = "|".join([nested("<", ">", "(){};"), ARGS, BRACES, nested(r"\[", r"\]"), "=>"])
_DECL_TYPE = rf"(?::(?:[^=;,<>(){{}}\[\]{MARKS}]|{_TYPE_PARTS})+?)?"
_NOT_WORDS = r"(?!(?:if|for|while|switch|catch|function|return|new|typeof|await|do|else|case|import|super)\b)"
_MEMBER_MODS = r"(?:\b(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*"

TOKENS = [
    ("doc", r"/\*\*(?!/).*?\*/(?:\s*/\*\*(?!/).*?\*/)*"),
    ("import", rf"""{keyword('import')}\s*(?:(?:type\s+)?[^'";()]*?{_FROM}|(?:'[^'\n]*'|"[^"\n]*"))"""),
    ("reexport", rf"{keyword('export')}\s*(?:type\s+)?(?:\*(?:\s*as\s+{_NAME})?|\{{[^{{}}]*\}}){_FROM}"),
    ("exports", rf"{keyword('export')}\s*(?:type\s+)?\{{[^{{}}]*\}}"),
    ("class", rf"{_EXPORT}(?:\babstract\s+)?{keyword('class')}(?:\s+(?!extends\b){_NAME})?[^{{;()=]*\{{"),
    ("interface", rf"{_EXPORT}{keyword('interface')}\s+{_NAME}[^{{;()=]*\{{"),
    ("alias", rf"{_EXPORT}{keyword('type')}\s+{_NAME}\s*{GENERIC}\s*=", r"(?![=>])"),
    ("function", rf"{_EXPORT}(?:\basync\s+)?{keyword('function')}\s*\*?\s*(?:{_NAME})?\s*{GENERIC}{ARGS}{_RET}\s*\{{"),
    ("skip", rf"{_EXPORT}(?:\basync\s+)?{keyword('function')}\s+{_NAME}\s*{GENERIC}{ARGS}"),
    ("arrow", rf"{_DECL}{_NAME}\s*{_DECL_TYPE}=\s*(?:{_ARROW_ARGS}|{_FUNC_EXPR})"),
    ("variable", rf"{_DECL}{_NAME}\s*{_DECL_TYPE}(?:\s*=)?", rf"(?=\s*(?:;|,|[{MARKS}]|\n|\bof\b|\bin\b)|(?<==)(?![=>]))"),
    ("export_default", rf"{keyword('export')}\s+default\s+{_NAME}", r"(?=\s*;|\s*\n|\s*\z)"),
    ("catch", rf"{keyword('catch')}\s*(?:\([^()]*\))?\s*\{{"),
    ("callback", rf"(?<![\w$.]){_NOT_WORDS}{_NAME}(?:\s*\??\.\s*{_NAME})*\s*\([^(){{}};=]*?(?:{_ARROW_ARGS}|{_FUNC_EXPR})"),
    ("lambda", rf"{_ARROW_ARGS}|{_FUNC_EXPR}"),
    ("branch", keyword(["if", "for", "while"])),
    ("other_branch", keyword(["else", "switch", "do"])),
    ("case", keyword("case")),
    ("operator", r"&&|\|\||\?\?"),
    ("ternary", r"\?", r"(?![.:?)=,;])"),
    ("abstract_method", rf"{keyword('abstract')}\s+{_MEMBER_MODS}{_NAME}\s*{GENERIC}{ARGS}"),
    ("signature", rf"{_NAME}\s*\??\s*{GENERIC}{ARGS}\s*:\s*[^;{{}}()=\n]+", r"(?=\s*[;,}])", r"(?<=[;{}\n][ \t]{0,80})"),
    ("method", rf"(?<![\w$.]){_MEMBER_MODS}(?:\*\s*)?{_NOT_WORDS}[#\w$]+\s*\??\s*{GENERIC}{ARGS}{_RET}\s*\{{"),
    ("new", rf"{keyword('new')}\s+{_NAME}(?:\.{_NAME})*\s*{GENERIC}\s*\("),
    ("word", rf"{keyword(['return', 'typeof', 'function', 'super', 'import', 'delete', 'void', 'in', 'of', 'throw'])}\s*\("),
    ("call", rf"(?:\bawait\s+)?(?<![\w$.]){_NAME}(?:\s*\??\.\s*{_NAME})*\s*(?:\?\.)?{GENERIC}\("),
    ("assign", rf"(?<![\w$.]){_NAME}(?:\s*\??\.\s*{_NAME})*(?:\[[^\[\]]*\])?\s*=", r"(?![=>])"),
    ("open", r"\{"), ("close", r"\}"), ("semi", ";"),
]

GRAMMAR = Grammar(
    tokens=TOKENS,
    decls=["class", "interface", "function", "arrow", "callback", "lambda", "method"],
    owners=["class", "interface", "function", "arrow", "method"],
    marks=["doc", "operator", "ternary"], either=["lambda", "method", "arrow", "variable"], mark_chars=rf"/&|?(<*#{{}};{MARKS}",
    conditional=["branch", "other_branch", "ternary"],
    decisions=["branch", "case", "catch", "operator", "ternary"],
    style="ts", keep_docs=True, semicolon_for=True)

_FUNCTIONS = ["function", "arrow", "callback", "lambda"]
_TOP_NAMES = {
    "class": rf"\bclass\s+(?!extends\b)({_NAME})", "interface": rf"\binterface\s+({_NAME})",
    "alias": rf"\btype\s+({_NAME})", "function": rf"\bfunction\b\s*\*?\s*({_NAME})",
    "arrow": rf"(?:\b(?:const|let|var)\s+|^[{MARKS}]\s*)({_NAME})", "variable": rf"(?:\b(?:const|let|var)\s+|^[{MARKS}]\s*)({_NAME})",
}
_METHOD_NAME = rf"([#\w$]+)\s*\??\s*{GENERIC}\("
_CALLEE = rf"({_NAME}(?:\s*\??\.\s*{_NAME})*)\s*(?:\?\.)?{GENERIC}\("


# The equals sign of a markup attribute: between a name and a quote or brace, without blanks.
_ATTRIBUTE_EQUALS = r"""(?<=\s[\w:.-]{1,60})(?<!\b(?:const|let|var)\s{1,3}[\w$]{1,60})=(?=["'{`])"""


def _no_attributes(code: Column) -> Column:
    """In JSX files an attribute is no assignment."""
    return F.when(F.col("language") == "TSX", F.regexp_replace(code, _ATTRIBUTE_EQUALS, " ")).otherwise(code)


def tokens(sources: DataFrame) -> DataFrame:
    return scan(sources.where(F.col("language").isin(TS_FAMILY)), GRAMMAR, _no_attributes)


def _declared_name(cls: Column, tok: Column) -> Column:
    out = None
    for name, rx in _TOP_NAMES.items():
        hit = group(tok, rx)
        out = F.when(cls == name, hit) if out is None else out.when(cls == name, hit)
    return out


def _args(cls: Column, tok: Column) -> Column:
    """Text of the parameter list of a function-like token."""
    listed = F.when(cls.isin("function", "method", "signature", "abstract_method"),
                    F.regexp_extract(tok, rf"^[^(]*?({ARGS})", 1)) \
        .otherwise(F.regexp_extract(tok, rf"({ARGS}){_RET}\s*(?:=>\s*\{{?|\{{)$", 1))
    bare = F.regexp_extract(tok, rf"(?:^|[\s(,=])({_NAME})\s*=>\s*\{{?$", 1)
    return F.when(listed != "", F.substring(listed, F.lit(2), F.length(listed) - 2)).otherwise(bare)


def decorate(toks: DataFrame) -> DataFrame:
    """Names, kinds and ids of declarations; NULL kind for tokens that declare nothing."""
    # A further declarator begins at its name, not at the mark before it.
    further = F.substring("tok", 1, 1).isin(*DECLARATORS.values())
    lead = F.when(further, F.regexp_extract("tok", rf"^[{MARKS}]\s*", 0)).otherwise("")
    toks = toks.withColumns({
        "col": F.when(newlines(lead) > 0, tail(lead)).otherwise(F.col("col") + F.length(lead)).cast("int"),
        "line": (F.col("line") + newlines(lead)).cast("int")})
    cls, tok = F.col("cls"), F.col("tok")
    # Patterns run only on the classes that need them.
    callee = F.when(cls.isin("call", "callback"), group("tok", _CALLEE))
    in_type = F.col("direct") & F.col("owner_cls").isin("class", "interface")
    member = F.regexp_extract(tok, _METHOD_NAME, 1)
    accessor = tok.rlike(rf"^\s*{_MEMBER_MODS}(?<=\bget|\bset)") | tok.rlike(r"\b(?:get|set)\s+[#\w$]+\s*\(")
    is_method = in_type & (
        ((cls == "method") & (F.col("owner_cls") == "class") & (member != "constructor") & ~accessor)
        | ((cls == "abstract_method") & (F.col("owner_cls") == "class"))
        | ((F.col("owner_cls") == "interface") & cls.isin("call", "method", "signature")))
    in_header = F.coalesce(F.col("prev_tok").rlike(r"^(?:for|await\s*\()$"), F.lit(False))  # of a loop
    top_level = F.col("owner_cls").isNull() & (F.col("level") == 0)
    kind = (F.when(cls == "import", "Import").when(cls == "class", "Class").when(cls == "interface", "Interface")
            .when(cls == "alias", "TypeAlias").when(cls.isin(_FUNCTIONS), "Function")
            .when(is_method, "Method").when((cls == "variable") & top_level & ~in_header, "Variable"))
    module = F.when(cls.isin("import", "reexport"), F.regexp_extract(tok, r"""['"]([^'"]*)['"]$""", 1))
    arg_no = F.length(F.regexp_replace(F.regexp_extract(
        tok, rf"^[^(]*\(([^(){{}};=]*?)(?:{_ARROW_ARGS}|{_FUNC_EXPR})$", 1), "[^,]", ""))
    name = (F.when(cls == "import", F.concat_ws(":", module, F.col("line").cast("string")))
            .when(cls == "callback", callback_name(F.regexp_replace(callee, r"\s", ""), arg_no))
            .when(cls == "lambda", "anonymousLambda")
            .when(is_method, member)
            .when(cls == "class", name_or(_declared_name(cls, tok), "AnonymousClass"))
            .when(cls == "function", name_or(_declared_name(cls, tok), "anonymousFuncDecl"))
            .otherwise(_declared_name(cls, tok)))
    owner_name = F.when(F.col("owner_cls").isin("class", "interface"), name_or(
        _declared_name(F.col("owner_cls"), F.col("owner_tok")), "AnonymousClass"))
    line = F.col("line").cast("string")
    out = toks.withColumns({"kind": kind, "name": name, "owner_name": owner_name, "module": module,
                            "callee": F.regexp_replace(callee, r"\s|\?", "")})
    eid = (F.when(F.col("kind").isin("Function", "Variable"), path_id(F.lower("kind"), F.col("name"), line))
           .when(F.col("kind") == "Method",
                 path_id("method", F.concat_ws(".", "owner_name", "name")))
           .when(F.col("kind").isNotNull(), path_id(F.lower("kind"), F.col("name"))))
    owner_id = F.when(F.col("owner_cls") == "class", path_id("class", F.col("owner_name"))) \
        .when(F.col("owner_cls") == "interface", path_id("interface", F.col("owner_name")))
    head = F.regexp_extract(tok, r"^([^({=<]*)", 1)
    for words, mark in DECLARATORS.items():
        head = F.when(tok.startswith(mark), F.lit(words)).otherwise(head)
    return out.withColumns({
        "entity_id": eid, "owner_id": owner_id,
        "head": F.when(F.col("kind").isNotNull(), head), "args": F.when(F.col("kind").isin("Function", "Method"), _args(cls, tok)),
        "seq": F.col("idx").cast("bigint")})


def _param(a: Column) -> Column:
    """Parameter struct from one argument text."""
    named = F.regexp_extract(a, rf"^(?:\.\.\.)?\s*(?:(?:public|private|protected|readonly)\s+)*({_NAME})", 1)
    rest = a.startswith("...")
    optional = rest | a.rlike(rf"^(?:(?:public|private|protected|readonly)\s+)*{_NAME}\s*\?") | a.rlike(r"=(?![>=])")
    type_ = strip(F.regexp_extract(a, r"^[^:=]*:\s*([^=]+)", 1))
    return F.struct(
        F.when(named != "", named).otherwise(F.coalesce(F.nullif(a, F.lit("")), F.lit("anonymousParam"))).alias("name"),
        type_or_any(type_).alias("type"), optional.alias("optional"), rest.alias("rest"))


def params(decls: DataFrame) -> DataFrame:
    """(owner entity id, name, type, optional, rest, place); the first of a name per owner."""
    from strata.operators.dedup import dedup_first
    rows = decls.where("args is not null").select(
        "path", "language", "entity_id", "line", "col", "seq",
        F.posexplode(F.transform(split_args(F.col("args")), _param)).alias("place", "p"))
    rows = rows.select("path", "language", F.col("entity_id").alias("owner_id"), "line", "col", "seq", "place", "p.*")
    rows = rows.withColumn("entity_id", entity_id("parameter", F.concat_ws(":", "owner_id", "name")))
    return dedup_first(rows, ["path", "entity_id"], ["seq", "place"])


def import_parts(tok: Column):
    """(default, namespace, named as array of 'name as alias') of an import clause."""
    clause = strip(F.regexp_extract(tok, r"""(?s)^import\s*(?:type\s+)?(.*?)\s*(?:from\s*)?['"][^'"]*['"]$""", 1))
    braces = F.regexp_extract(clause, r"\{([^{}]*)\}", 1)
    named = F.filter(F.transform(F.split(braces, ","), lambda x: strip(F.regexp_replace(x, r"^\s*type\s+", ""))),
                     lambda x: x != "")
    return group(clause, rf"^({_NAME})"), group(clause, rf"\*\s*as\s+({_NAME})"), named


def nodes(decls: DataFrame) -> DataFrame:
    d = decls.where("kind is not null")
    default, namespace, named = import_parts(F.col("tok"))
    words = F.filter(F.split(strip("head"), r"\s+"), lambda w: w.isin(
        "export", "default", "declare", "abstract", "async", "public", "private", "protected",
        "static", "readonly", "override", "const", "let", "var"))
    mods = F.when(F.col("kind").isin("Function", "Class", "Variable", "Method"), words)
    is_type = F.col("kind").isin("Class", "Interface", "Function", "Variable", "TypeAlias")
    docs = F.when(F.col("doc").isNotNull(), F.col("doc"))
    named_only = F.transform(named, lambda x: F.regexp_replace(x, r"\s+as\s+.*$", ""))
    bag = (F.when(F.col("kind") == "Import", props(
                moduleSpecifier="module", defaultImport=default, namespaceImport=namespace,
                namedImports=F.nullif(F.array_join(named_only, ","), F.lit("")),
                isTypeOnly=F.col("tok").rlike(r"^import\s+type\b")))
           .when(F.col("kind") == "Function", props(isCallback=F.col("cls") == "callback"))
           .when((F.col("kind") == "Method") & (F.col("owner_cls") == "interface"),
                 props(isSignature=F.lit(True), parentId="owner_id"))
           .when(F.col("kind") == "Method", props(parentId="owner_id")))
    body_end = F.col("kind").isin("Class", "Interface", "Function", "Method")
    impl = F.regexp_extract("tok", r"\bimplements\s+([^{]+)", 1)
    base = d.select(
        "entity_id", "kind", "name", F.col("path").alias("file_path"), F.lit("TypeScript").alias("language"),
        F.col("line").alias("start_line"),
        F.when(body_end, F.col("end_line")).otherwise(F.col("stop_line")).alias("end_line"),
        F.col("col").alias("start_col"),
        F.when(body_end, F.col("end_col")).otherwise(F.col("stop_col")).alias("end_col"),
        (F.when(body_end, F.col("end_line")).otherwise(F.col("stop_line")) - F.col("line") + 1).alias("loc"),
        F.when(F.col("kind") == "Variable", type_or_any(group("tok", r"(?s)^[^:]*:\s*(.+?)\s*=?$"))).alias("type"),
        F.when(F.col("kind").isin("Function", "Method"),
               type_or_any(strip(F.regexp_extract("tok", r"\)\s*:\s*([^(){}]+?)\s*(?:=>\s*)?\{?$", 1)))).alias("return_type"),
        F.when(F.col("kind").isin("Function", "Method"), F.col("complexity")).alias("complexity"),
        F.when(F.col("kind") == "Method", visibility(words)).alias("visibility"),
        F.when(is_type, F.array_contains(words, "export") & ~F.col("cls").isin("callback", "lambda")).alias("is_exported"),
        F.when(is_type, F.array_contains(words, "default")).alias("is_default_export"),
        F.when(F.col("kind") == "Class", F.array_contains(words, "abstract")).alias("is_abstract"),
        F.when(F.col("kind").isin("Function", "Method"),
               F.col("tok").rlike(r"^[^(]*\basync\b") | F.col("tok").rlike(r"\basync\s*(?:\(|function|[A-Za-z_$])[^;]*$")).alias("is_async"),
        F.when(F.col("kind") == "Method", F.array_contains(words, "static")).alias("is_static"),
        F.when(F.col("kind") == "Function", F.col("tok").rlike(r"\bfunction\s*\*")).alias("is_generator"),
        F.when(F.col("kind") == "Variable", F.array_contains(words, "const")).alias("is_constant"),
        F.when((F.col("kind") == "Class") & (impl != ""),
               F.transform(F.split(impl, ","), lambda x: strip(x))).alias("implements"),
        mods.alias("modifiers"),
        F.when(docs.isNotNull(), doc_tags(docs)).alias("tags"),
        F.nullif(F.when(F.col("kind") == "Import", doc_description(docs)).otherwise(doc_text(docs)), F.lit("")).alias("documentation"),
        F.when(F.col("kind") == "Method", F.col("owner_id")).alias("parent_id"),
        bag.alias("properties"), "seq")
    p = params(decls).select(
        "entity_id", F.lit("Parameter").alias("kind"), "name", F.col("path").alias("file_path"),
        F.lit("TypeScript").alias("language"), F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        F.lit(1).alias("loc"), "type", F.col("optional").alias("is_optional"), F.col("rest").alias("is_rest"),
        F.col("owner_id").alias("parent_id"), props(parentId="owner_id").alias("properties"), "seq")
    return nodes_like(base).unionByName(nodes_like(p))


def edges(decls: DataFrame) -> DataFrame:
    """Edges inside one file: imports, members, parameters."""
    d = decls.where("kind in ('Import', 'Method')")
    kind = F.col("kind")
    own = explode_edges(
        d,
        F.when(kind == "Import", edge("IMPORTS", file_id(), F.col("entity_id"), 1)),
        F.when(kind == "Method", edge("HAS_METHOD", F.col("owner_id"), F.col("entity_id"), 10)))
    p = explode_edges(params(decls), edge("HAS_PARAMETER", F.col("owner_id"), F.col("entity_id"), 8))
    return own.unionByName(p)


def _sites(decls: DataFrame) -> DataFrame:
    """Tokens inside a function or method, with the id of that declaration."""
    bodies = decls.where("cls in ('function', 'arrow', 'method') and kind in ('Function', 'Method')").select(
        "path", F.col("start").alias("owner_start"), F.col("entity_id").alias("source_id"),
        F.col("owner_name").alias("source_class"))
    return decls.join(bodies, ["path", "owner_start"])


def call_sites(decls: DataFrame) -> DataFrame:
    """(path, source_id, callee, name, receiver, line, col, awaited, conditional)."""
    s = _sites(decls.where("cls in ('call', 'callback', 'function', 'arrow', 'method')"))
    s = s.where("cls in ('call', 'callback')")
    return s.select(
        "path", "source_id", "source_class", "callee",
        F.substring_index("callee", ".", -1).alias("name"),
        group("callee", r"^(.*)\.[^.]*$").alias("receiver"), "line", "col",
        F.col("tok").rlike(r"^await\b").alias("is_awaited"), F.col("in_cond").alias("is_conditional"), "seq")


def assignments(decls: DataFrame) -> DataFrame:
    """(path, source_id, target, name, line, col): plain ``=`` outside declarations."""
    s = _sites(decls.where("cls in ('assign', 'function', 'arrow', 'method')")).where("cls = 'assign'")
    target = strip(F.regexp_replace("tok", r"(?s)\s*=$", ""))
    target = F.regexp_replace(target, r"\s|\?", "")
    bare = F.regexp_replace(target, r"\[.*$", "")
    return s.select("path", "source_id", target.alias("target"), F.substring_index(bare, ".", -1).alias("name"),
                    "line", "col", "seq")


def handlers(decls: DataFrame) -> DataFrame:
    """HANDLES_ERROR edges: a catch parameter, or an anonymous handler without one."""
    s = _sites(decls.where("cls in ('catch', 'function', 'arrow', 'method')")).where("cls = 'catch'")
    bound = group("tok", rf"\(\s*({_NAME})")
    line = F.col("line").cast("string")
    target = F.when(bound.isNotNull(), entity_id("parameter", F.concat_ws(":", "source_id", F.lit("catch"), bound, line))) \
        .otherwise(entity_id("error_handler", F.concat_ws(":", "source_id", F.lit("handler"), line)))
    return explode_edges(s, edge("HANDLES_ERROR", F.col("source_id"), target, 5, props(
        catchStartLine="line", catchColumn="col",
        targetName=F.coalesce(bound, F.lit("anonymousCatch")))))


def import_rows(decls: DataFrame) -> DataFrame:
    """(path, import_id, module, type_only, symbols, imported): one row per import statement;
    ``imported`` lists (local, name, form)."""
    default, namespace, named = import_parts(F.col("tok"))
    local = lambda x: F.regexp_replace(x, r"^.*\s+as\s+", "")
    origin = lambda x: F.regexp_replace(x, r"\s+as\s+.*$", "")
    items = F.concat(
        F.transform(named, lambda x: F.struct(local(x).alias("local"), origin(x).alias("name"), F.lit("named").alias("form"))),
        F.when(default.isNotNull(), F.array(F.struct(default.alias("local"), F.lit("default").alias("name"),
                                                     F.lit("default").alias("form"))))
        .otherwise(F.array().cast("array<struct<local:string,name:string,form:string>>")),
        F.when(namespace.isNotNull(), F.array(F.struct(namespace.alias("local"), F.lit("*").alias("name"),
                                                       F.lit("namespace").alias("form"))))
        .otherwise(F.array().cast("array<struct<local:string,name:string,form:string>>")))
    return decls.where("cls = 'import'").select(
        "path", F.col("entity_id").alias("import_id"), "module",
        F.col("tok").rlike(r"^import\s+type\b").alias("type_only"),
        F.array_join(F.transform(items, lambda i: i["local"]), ",").alias("symbols"),
        items.alias("imported"), "line", "seq")


def export_rows(decls: DataFrame) -> DataFrame:
    """(path, form, module, exported): re-exports, local export lists, default assignments."""
    d = decls.where("cls in ('reexport', 'exports', 'export_default')")
    listed = F.filter(F.transform(F.split(F.regexp_extract("tok", r"\{([^{}]*)\}", 1), ","),
                                  lambda x: F.regexp_replace(strip(x), r"\s+as\s+.*$", "")), lambda x: x != "")
    return d.select(
        "path", F.col("cls").alias("form"), F.when(F.col("cls") == "reexport", F.col("module")).alias("module"),
        F.when(F.col("cls") == "export_default", F.array(F.regexp_extract("tok", r"([\w$]+)$", 1)))
        .otherwise(listed).alias("exported"), "line", "seq")


def heritage_rows(decls: DataFrame) -> DataFrame:
    """(path, source_id, relation, name): extends and implements clauses."""
    d = decls.where("kind in ('Class', 'Interface')")
    flat = F.regexp_replace(F.regexp_replace("tok", r"<[^<>]*>", ""), r"<[^<>]*>", "")
    names = lambda rx: F.filter(F.transform(F.split(F.regexp_extract(flat, rx, 1), ","), lambda x: strip(x)),
                                lambda x: x != "")
    ext = names(r"\bextends\s+([^{]+?)\s*(?:\bimplements\b|\{)")
    imp = names(r"\bimplements\s+([^{]+?)\s*\{")
    tag = lambda xs, t: F.transform(xs, lambda x: F.struct(F.lit(t).alias("relation"), x.alias("name")))
    return d.select("path", F.col("entity_id").alias("source_id"), F.col("kind").alias("source_kind"),
                    F.posexplode(F.concat(tag(ext, "EXTENDS"), tag(imp, "IMPLEMENTS"))).alias("place", "h"),
                    "seq").select("path", "source_id", "source_kind", "place", "h.*", "seq")
