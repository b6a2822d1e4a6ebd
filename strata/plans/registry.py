"""Extractors by language family and resolvers by name; ``register`` adds to both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from strata.functions.ids import EXTENSIONS, LANGUAGE_BY_EXTENSION
from strata.plans.extract import cfamily, csharp, golang, java, python, sql, typescript


@dataclass(frozen=True)
class Extractor:
    """``decorate`` turns sources into rows of constructs; the others read those rows."""

    languages: tuple[str, ...]
    decorate: Callable[[DataFrame], DataFrame]
    nodes: Callable[[DataFrame], DataFrame]
    edges: Callable[[DataFrame], DataFrame]


EXTRACTORS: dict[str, Extractor] = {
    "typescript": Extractor(("TypeScript", "TSX"), lambda s: typescript.decorate(typescript.tokens(s)),
                            typescript.nodes, typescript.edges),
    "python": Extractor(("Python",), python.decorate, python.nodes, python.edges),
    "java": Extractor(("Java",), java.decorate, java.nodes, java.edges),
    "csharp": Extractor(("C#",), csharp.decorate, csharp.nodes, csharp.edges),
    "go": Extractor(("Go",), golang.decorate, golang.nodes, golang.edges),
    "c": Extractor(("C", "C++"), cfamily.decorate, cfamily.nodes, cfamily.edges),
    "sql": Extractor(("SQL",), sql.decorate, sql.nodes, sql.edges),
}


# What a family adds across files: (facts, nodes of the first pass) to a list of edge frames. The built-in ones
# are added by ``plans.analyze``.
Resolver = Callable[["object", DataFrame], list[DataFrame]]
RESOLVERS: dict[str, Resolver] = {}


def register(name: str, extractor: Extractor, resolver: Resolver | None = None, extensions: dict[str, str] | None = None) -> None:
    """Add or replace a language family. ``extensions`` maps file extensions (with their dot, lower case) to
    languages of the family; ``resolver`` gives its edges across files."""
    EXTRACTORS[name] = extractor
    if resolver:
        RESOLVERS[name] = resolver
    LANGUAGE_BY_EXTENSION.update(extensions or {})
    EXTENSIONS.extend(e for e in extensions or {} if e not in EXTENSIONS)
