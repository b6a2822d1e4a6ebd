"""Shapes shared by the extractors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.ids import edge_id, entity_id
from strata.functions.props import drop_nulls, to_map
from strata.model import edges_like, nodes_like

# Levels of brackets that the patterns below follow. Each level adds a few characters to a pattern and
# nothing to the work on texts that do not use it.
DEPTH = 64


def nested(left: str, right: str, but: str = "", depth: int = DEPTH) -> str:
    """Pattern of a bracketed stretch with brackets of its kind in it. ``but`` lists characters that end it."""
    plain = rf"[^{left}{right}{but}]*+"
    out = rf"{left}{plain}{right}"
    for _ in range(depth - 1):
        out = rf"{left}{plain}(?:{out}{plain})*+{right}"
    return out


# A list of arguments.
ARGS = nested(r"\(", r"\)")
BRACES = nested(r"\{", r"\}")
# Type arguments.
GENERIC = rf"(?:{nested('<', '>', '(){};')})?"


def keyword(words) -> str:
    """A word of the language, not part of a name, path or string."""
    words = words if isinstance(words, str) else "|".join(words)
    return rf"""(?<![\w$.'"`/@:-])(?:{words})\b(?!['"`])"""


def group(c, rx: str, i: int = 1) -> Column:
    """Capture group or NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, rx, i), F.lit(""))


def strip(c) -> Column:
    """Text without white space at its ends, line breaks included."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def path_id(prefix, *parts) -> Column:
    """``prefix:path:part:…``"""
    return entity_id(prefix, F.concat_ws(":", F.col("path"), *parts))


def file_id() -> Column:
    return entity_id("file", "path")


def props(**cols) -> Column:
    return drop_nulls(to_map(**cols))


def edge(type_, source: Column, target: Column, weight: int, properties: Column | None = None) -> Column:
    """Edge struct; NULL when an end is missing."""
    type_col = type_ if isinstance(type_, Column) else F.lit(type_)
    bag = properties if properties is not None else F.create_map().cast("map<string,string>")
    return F.when(source.isNotNull() & target.isNotNull() & type_col.isNotNull(), F.struct(
        edge_id(type_col, source, target).alias("entity_id"), type_col.alias("type"),
        source.alias("source_id"), target.alias("target_id"), F.lit(weight).alias("weight"),
        bag.alias("properties")))


def explode_edges(df: DataFrame, *edges: Column, seq="seq") -> DataFrame:
    """All edge structs of a row; ``seq`` orders them by row, then by place in the list."""
    listed = F.filter(F.array(*edges), lambda e: e.isNotNull())
    rows = df.select(F.col(seq).alias("_seq"), F.posexplode(listed).alias("_i", "_e"))
    return edges_like(rows.select("_e.*", (F.col("_seq") * 16 + F.col("_i")).alias("seq")))


def file_nodes(sources: DataFrame) -> DataFrame:
    """A File node per source with its line count."""
    from strata.functions.ids import base_name, line_count
    n = line_count("text").cast("int")
    return nodes_like(sources.select(
        file_id().alias("entity_id"), F.lit("File").alias("kind"), base_name("path").alias("name"),
        F.col("path").alias("file_path"), "language", F.lit(1).alias("start_line"), n.alias("end_line"),
        F.lit(0).alias("start_col"), F.lit(0).alias("end_col"), n.alias("loc"), F.lit(0).alias("seq")))


def lines(sources: DataFrame) -> DataFrame:
    """(path, line, text) with 1-based line numbers."""
    return sources.select("path", F.posexplode(F.split("text", "\n")).alias("_p", "text")).select(
        "path", (F.col("_p") + 1).alias("line"), "text")


def split_args(args: Column) -> Column:
    """Arguments of a list without its parentheses, cut at commas outside brackets."""
    part = (r"(?:[^,(){}\[\]<>]++|=>|" + "|".join([ARGS, BRACES, nested(r"\[", r"\]"), nested("<", ">", "(){};")]) + r"|[<>])++")
    return F.filter(F.transform(F.regexp_extract_all(args, F.lit(part), F.lit(0)), strip),
                    lambda a: a != "")


def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
