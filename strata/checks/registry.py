"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; without SQL only its rows are checked."""
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def eid(kind: str, q: str) -> str:
    """SQL of an entity id; both arguments are SQL."""
    return f"lower({kind}) || ':' || regexp_replace(lower(replace({q}, '\\', '/')), '[^a-z0-9_.:/-]', '_', 'g')"


def kid(kind: str, key: str) -> str:
    """SQL of a business row's id."""
    return f"'{kind}:' || CAST({key} AS VARCHAR)"


PAGE_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

REL_NODES = f"""
SELECT {kid('region', 'r_regionkey')} AS entity_id, 'region' AS kind, r_name AS name, NULL AS parent_id FROM region
UNION ALL SELECT {kid('nation', 'n_nationkey')}, 'nation', n_name, {kid('region', 'n_regionkey')} FROM nation
UNION ALL SELECT {kid('customer', 'c_custkey')}, 'customer', c_name, {kid('nation', 'c_nationkey')} FROM customer
UNION ALL SELECT {kid('supplier', 's_suppkey')}, 'supplier', s_name, {kid('nation', 's_nationkey')} FROM supplier
UNION ALL SELECT {kid('part', 'p_partkey')}, 'part', p_name, NULL FROM part
UNION ALL SELECT {kid('orders', 'o_orderkey')}, 'orders', o_orderpriority, {kid('customer', 'o_custkey')} FROM orders"""

_EDGES = {
    "CONTAINS": [("nation", "region", "n_regionkey", "nation", "n_nationkey"),
                 ("customer", "nation", "c_nationkey", "customer", "c_custkey"),
                 ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey")],
    "PLACED": [("orders", "customer", "o_custkey", "orders", "o_orderkey")],
    "CALLS": [("lineitem", "orders", "l_orderkey", "supplier", "l_suppkey")],
    "USES": [("lineitem", "orders", "l_orderkey", "part", "l_partkey")],
}


def rel_edges_sql(*types: str) -> str:
    """SQL of (type, source_id, target_id) edges."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS type, {kid(a, x)} AS source_id, {kid(b, y)} AS target_id FROM {table}"
        for t in (types or _EDGES) for table, a, x, b, y in _EDGES[t])
