"""Ignore and extension lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from strata.functions.ids import EXTENSIONS, as_col, norm_path

# Paths ignored by default.
IGNORE = [
    "**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**",
    "**/.next/**", "**/.svelte-kit/**", "**/.venv/**", "**/venv/**", "**/env/**",
    "**/__pycache__/**", "**/*.pyc", "**/bin/**", "**/obj/**", "**/*.class", "**/target/**",
    "**/*.log", "**/*.lock", "**/*.test.ts", "**/*.spec.ts", "**/*.test.tsx",
    "**/*.spec.tsx", "**/*.test.js", "**/*.spec.js", "**/playwright-report/**",
    "**/public/**", ".DS_Store",
]


def union_lists(*lists) -> list[str]:
    """Union without repeats, first occurrence first."""
    return list(dict.fromkeys(x for xs in lists for x in xs))


def dotted(exts) -> list[str]:
    return [e if e.startswith(".") else f".{e}" for e in exts]


def ignore_patterns(user=()) -> list[str]:
    """Default and user patterns."""
    return union_lists(IGNORE, user)


def glob_regex(glob: str) -> str:
    """Regex for paths a glob matches, and for everything below a matched folder. ``*`` and
    ``**`` do not step into names that start with a dot."""
    steps = [("**/", r"/?(?:[^./][^/]*/)*"), ("/**", r""), ("**", r"[^/]*"),
             ("*", r"(?!\.)[^/]*"), ("?", r"[^/]"), ("{", "(?:"), ("}", ")"), (",", "|")]
    out, rest, fresh = "", glob, True
    while rest:
        if rest.startswith("/**/"):
            out, rest = out + r"/(?:[^./][^/]*/)*", rest[4:]
            continue
        for lead, regex in steps:
            if rest.startswith(lead) and not (lead == "/**" and rest != "/**"):
                out += r"[^/]*" if lead == "*" and not fresh else regex
                rest = rest[len(lead):]
                fresh = lead == "**/"
                break
        else:
            fresh = rest[0] == "/"
            out, rest = out + re.escape(rest[0]), rest[1:]
    return f"^{out}(?:/.*)?$"


def ignore_regex(globs) -> str:
    return "|".join(f"(?:{glob_regex(g)})" for g in globs)


def filter_extensions(df: DataFrame, exts=EXTENSIONS, col: str = "extension") -> DataFrame:
    return df.where(F.lower(as_col(col)).isin([e for e in dotted(exts)]))


def filter_ignored(df: DataFrame, globs, path: str = "path") -> DataFrame:
    globs = list(globs)
    return df.where(~norm_path(path).rlike(ignore_regex(globs))) if globs else df
