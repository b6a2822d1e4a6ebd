"""Scalar helpers on tokens and snippets of source text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strata.functions.ids import as_col

# Decision points counted by cyclomatic complexity.
DECISION_WORDS = ["if", "for", "while", "case", "catch"]
DECISION_OPERATORS = ["&&", "||", "??"]


def include_path(c) -> Column:
    """Include text without its delimiters."""
    c = as_col(c)
    return F.substring(c, F.lit(2), F.length(c) - 2)


def is_system_include(c) -> Column:
    return as_col(c).startswith("<") & as_col(c).endswith(">")


def is_on_demand(c) -> Column:
    return as_col(c).rlike(r"\.\*;?$")


def class_tokens(c) -> Column:
    return F.filter(F.split(as_col(c), r"\s+"), lambda x: x != "")


def callback_name(callee, i) -> Column:
    safe = F.substring(F.regexp_replace(as_col(callee), "[^a-zA-Z0-9_]", "_"), 1, 30)
    i = i if isinstance(i, Column) else F.lit(i)
    return F.concat(F.lit("callback_"), safe, F.lit("_arg"), i.cast("string"))


def attr_value(c) -> Column:
    """Attribute value from the text after ``=``: quotes dropped, ``{expr}`` kept in braces,
    ``true`` for a bare attribute."""
    c = as_col(c)
    quoted = c.rlike("""^(?:"[^"]*"|'[^']*')$""")
    braced = c.rlike(r"(?s)^\{.*\}$")
    inner = F.trim(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(" \n\t\r"))
    return (F.when(c.isNull() | (c == ""), "true")
            .when(quoted, F.substring(c, F.lit(2), F.length(c) - 2))
            .when(braced & (inner == ""), "{expression}")
            .when(braced, F.concat(F.lit("{"), inner, F.lit("}")))
            .otherwise(c))


def is_component_name(c) -> Column:
    return as_col(c).rlike("^[A-Z]")


def unquote(c) -> Column:
    return F.replace(as_col(c), F.lit('"'), F.lit(""))


def visibility(mods) -> Column:
    mods = as_col(mods)
    return (F.when(F.array_contains(mods, "private"), "private")
            .when(F.array_contains(mods, "protected"), "protected")
            .otherwise("public"))


def doc_blocks(c) -> Column:
    """Bodies of the ``/** … */`` blocks in ``c``, comment stars removed."""
    raw = F.regexp_extract_all(as_col(c), F.lit(r"(?s)/\*\*(.*?)\*/"), F.lit(1))
    return F.transform(raw, lambda b: F.trim(F.regexp_replace(b, r"(?m)^[ \t]*\*?[ \t]?", "")))


def _prose(block: Column) -> Column:
    """Block text before its first tag line."""
    return F.trim(F.regexp_replace(block, r"(?s)(?:^|\n)\s*@\w.*$", ""), F.lit(" \n\t\r"))


def doc_text(c) -> Column:
    return F.trim(F.array_join(F.transform(doc_blocks(c), _prose), "\n"), F.lit(" \n\t\r"))


def doc_description(c) -> Column:
    return F.nullif(_prose(F.get(doc_blocks(c), F.lit(0))), F.lit(""))


def doc_tags(c) -> Column:
    """Tag names of the last block."""
    blocks = doc_blocks(c)
    last = F.get(blocks, F.size(blocks) - 1)
    return F.regexp_extract_all(F.coalesce(last, F.lit("")), F.lit(r"(?m)^\s*@(\w+)"), F.lit(1))


def name_or(c, default: str) -> Column:
    return F.coalesce(F.nullif(as_col(c), F.lit("")), F.lit(default))


def type_or_any(c) -> Column:
    return name_or(c, "any")


def var_modifiers(mods, keyword) -> Column:
    return F.array_append(F.coalesce(as_col(mods), F.array().cast("array<string>")), as_col(keyword))


def complexity(c, words: list[str] | None = None, operators: list[str] | None = None) -> Column:
    """1 + decision points found in ``c``; ``for … in/of`` counts once, ``do`` through its
    ``while``."""
    words = DECISION_WORDS if words is None else words
    operators = DECISION_OPERATORS if operators is None else operators
    alternatives = [rf"\b(?:{'|'.join(words)})\b"] if words else []
    alternatives += ["".join("\\" + ch for ch in op) for op in operators]
    if operators:
        alternatives.append(r"\?[^.?:]")
    pattern = "(" + "|".join(alternatives) + ")"
    return F.lit(1) + F.regexp_count(as_col(c), F.lit(pattern))
