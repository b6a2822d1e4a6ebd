"""Node and edge schemas, and the catalog of kinds and edge types."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Node kinds of the declared catalog.
DECLARED_KINDS = [
    "File", "Directory", "Class", "Interface", "Function", "Method",
    "Variable", "Parameter", "TypeAlias", "Import", "Export",
    "Component", "JSXElement", "JSXAttribute", "TailwindClass",
    "PythonModule", "PythonFunction", "PythonClass", "PythonMethod",
    "PythonParameter", "PythonVariable",
    "CFunction", "CppClass", "CppMethod", "IncludeDirective", "MacroDefinition",
    "JavaClass", "JavaInterface", "JavaMethod", "JavaField",
    "PackageDeclaration", "ImportDeclaration",
    "CSharpClass", "CSharpInterface", "CSharpStruct", "CSharpMethod",
    "Property", "Field", "NamespaceDeclaration", "UsingDirective",
    "GoFunction", "GoMethod", "GoStruct", "GoInterface", "PackageClause", "ImportSpec",
    "SQLSchema", "SQLTable", "SQLView", "SQLColumn", "SQLSelectStatement",
    "SQLInsertStatement", "SQLUpdateStatement", "SQLDeleteStatement",
    "SQLFunction", "SQLProcedure",
]

# Edge types of the declared catalog.
DECLARED_TYPES = [
    "CONTAINS", "IMPORTS", "EXPORTS", "CALLS", "EXTENDS", "IMPLEMENTS",
    "HAS_METHOD", "HAS_PARAMETER", "MUTATES_STATE", "HANDLES_ERROR",
    "DEFINES_COMPONENT", "RENDERS_ELEMENT", "USES_COMPONENT", "HAS_PROP",
    "USES_TAILWIND_CLASS", "PYTHON_IMPORTS", "PYTHON_CALLS",
    "PYTHON_DEFINES_FUNCTION", "PYTHON_DEFINES_CLASS", "PYTHON_HAS_METHOD",
    "PYTHON_HAS_PARAMETER", "INCLUDES", "DECLARES_PACKAGE", "JAVA_IMPORTS",
    "HAS_FIELD", "DECLARES_NAMESPACE", "USES_NAMESPACE", "HAS_PROPERTY",
    "GO_IMPORTS", "DEFINES_TABLE", "DEFINES_VIEW", "HAS_COLUMN",
    "REFERENCES_TABLE", "REFERENCES_VIEW", "CALLS_FUNCTION", "CALLS_PROCEDURE",
]

# Kinds and types that extraction emits beyond the declared catalog.
EMITTED_KINDS = ["JavaEnum", "Placeholder"]
EMITTED_TYPES = [
    "RESOLVES_IMPORT", "DEFINES_CLASS", "DEFINES_INTERFACE", "DEFINES_STRUCT",
    "DEFINES_ENUM", "DEFINES_FUNCTION", "CSHARP_USING",
]

# Edge types that may cross a file boundary.
CROSS_FILE_TYPES = [
    "IMPORTS", "EXPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "MUTATES_STATE",
    "INCLUDES", "JAVA_IMPORTS", "USES_NAMESPACE", "GO_IMPORTS",
    "REFERENCES_TABLE", "REFERENCES_VIEW", "CALLS_FUNCTION", "CALLS_PROCEDURE",
]

KINDS = DECLARED_KINDS + EMITTED_KINDS
EDGE_TYPES = DECLARED_TYPES + EMITTED_TYPES

NODE_SCHEMA = T.StructType(
    [T.StructField("entity_id", T.StringType(), False), T.StructField("kind", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("name", "file_path", "language")]
    + [T.StructField(c, T.IntegerType()) for c in ("start_line", "end_line", "start_col", "end_col", "loc")]
    + [T.StructField(c, T.StringType()) for c in ("type", "return_type")]
    + [T.StructField("complexity", T.IntegerType()), T.StructField("visibility", T.StringType())]
    + [T.StructField(c, T.BooleanType()) for c in (
        "is_exported", "is_default_export", "is_abstract", "is_async", "is_optional",
        "is_static", "is_generator", "is_rest", "is_constant")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("implements", "modifiers", "tags")]
    + [T.StructField("documentation", T.StringType()), T.StructField("parent_id", T.StringType()),
       T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
       T.StructField("created_at", T.TimestampType()), T.StructField("seq", T.LongType())]
)

EDGE_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("source_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("weight", T.IntegerType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("pass", T.IntegerType()),
    T.StructField("seq", T.LongType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring ``df`` to ``schema``: cast known columns, fill missing ones with NULL."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def nodes_like(df: DataFrame) -> DataFrame:
    return conform(df, NODE_SCHEMA)


def edges_like(df: DataFrame) -> DataFrame:
    return conform(df, EDGE_SCHEMA)
