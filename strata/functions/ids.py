"""Path, identity and import-path helpers; every helper maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.operators.ordered import number_rows

# Extensions scanned by default, in lookup order.
EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".py", ".c", ".h", ".cpp", ".hpp", ".cc", ".hh",
    ".java", ".cs", ".go", ".sql",
]

# Language by extension.
LANGUAGE_BY_EXTENSION = {
    ".ts": "TypeScript", ".tsx": "TSX", ".js": "TypeScript", ".jsx": "TSX",
    ".mjs": "TypeScript", ".cjs": "TypeScript", ".py": "Python",
    ".c": "C", ".h": "C", ".cpp": "C++", ".hpp": "C++", ".cc": "C++", ".hh": "C++",
    ".java": "Java", ".cs": "C#", ".go": "Go", ".sql": "SQL",
}

TS_FAMILY = ["TypeScript", "TSX"]


def as_col(c) -> Column:
    """Plain strings name a column."""
    return F.col(c) if isinstance(c, str) else c


def norm_path(c) -> Column:
    return F.replace(as_col(c), F.lit("\\"), F.lit("/"))


def base_name(c) -> Column:
    return F.substring_index(as_col(c), "/", -1)


def ext_name(c) -> Column:
    """Lower-cased extension with its dot; a leading dot alone is no extension."""
    base = base_name(c)
    return F.when(base == "..", "").otherwise(
        F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)))


def dir_name(c) -> Column:
    return F.regexp_replace(as_col(c), "/[^/]*$", "")


def sanitise(c) -> Column:
    return F.regexp_replace(norm_path(c), "[^a-zA-Z0-9_.:/-]", "_")


def entity_id(kind, qname, stamp: str = "0") -> Column:
    """``kind:qname`` folded to lower case and a safe alphabet. With an empty part the id is
    ``unknown``-filled, unsanitised and ends with ``stamp`` (the run's clock value)."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    qname = as_col(qname)
    k, q = F.nullif(kind, F.lit("")), F.nullif(qname, F.lit(""))
    folded = F.regexp_replace(F.lower(norm_path(qname)), "[^a-z0-9_.:/-]", "_")
    return F.when(
        k.isNull() | q.isNull(),
        F.concat_ws(":", F.coalesce(k, F.lit("unknown")), F.coalesce(q, F.lit("unknown")), F.lit(stamp)),
    ).otherwise(F.concat(F.lower(kind), F.lit(":"), folded))


def edge_id(type_, source_id, target_id, suffix=None) -> Column:
    parts = [as_col(source_id), as_col(target_id)] + ([suffix] if suffix is not None else [])
    return entity_id(type_, F.concat_ws(":", *parts))


def instance_id(df: DataFrame, prefix, ident, file, order, line=None, col=None,
                out: str = "instance_id") -> DataFrame:
    """``prefix:ident[:Lline][:Ccol]:counter`` with a counter running over each file."""
    numbered = number_rows(df, [file], order, "_n")
    bits = [prefix if isinstance(prefix, Column) else F.lit(prefix), sanitise(ident)]
    if line is not None:
        bits.append(F.concat(F.lit("L"), as_col(line).cast("string")))
    if col is not None:
        bits.append(F.concat(F.lit("C"), as_col(col).cast("string")))
    bits.append(F.col("_n").cast("string"))
    return numbered.withColumn(out, F.concat_ws(":", *bits)).drop("_n")


def py_entity_id(kind, path, qname, line) -> Column:
    """Python declarations keep case; only variables and parameters carry their line."""
    kind, line = as_col(kind), as_col(line)
    lined = F.lower(kind).isin("pythonvariable", "pythonparameter") & line.isNotNull()
    return F.concat(F.lower(kind), F.lit(":"), as_col(path), F.lit(":"), as_col(qname),
                    F.when(lined, F.concat(F.lit(":"), line.cast("string"))).otherwise(F.lit("")))


def strip_js(c) -> Column:
    return F.regexp_replace(as_col(c), r"(?i)\.jsx?$", "")


def fold_dots(c) -> Column:
    """Absolute path with ``.``, ``..`` and empty parts folded away."""
    parts = F.split(as_col(c), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve_rel(src, imp) -> Column:
    """A relative import against the folder of ``src``; anything else passes through."""
    imp = as_col(imp)
    joined = F.concat(dir_name(src), F.lit("/"), strip_js(imp))
    return F.when(imp.startswith("."), fold_dots(joined)).otherwise(imp)


def qualify(scope, name) -> Column:
    return F.concat_ws(".", F.nullif(as_col(scope), F.lit("")), as_col(name))


def loc(start, end) -> Column:
    return as_col(end) - as_col(start) + 1


def line_count(text) -> Column:
    """Number of the last line: newlines plus one."""
    t = as_col(text)
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1


def language(ext) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv]
    return F.create_map(*pairs)[F.lower(as_col(ext))]


def split_qualified(c, default_schema: str | None = None):
    """(schema, object) of ``schema.object``; the default schema when unqualified."""
    c = as_col(c)
    parts = F.split(c, r"\.")
    qualified = F.contains(c, F.lit("."))
    schema = F.when(qualified, parts[0]).otherwise(F.lit(default_schema))
    return schema, F.when(qualified, parts[1]).otherwise(c)
