"""Queries over the given tables, each with the SQL that must give the same rows."""

from strata.checks import code, feeds, graphs, pages, relations, scalars  # noqa: F401
from strata.checks.registry import ORACLES, QUERIES  # noqa: F401
