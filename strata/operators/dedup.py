"""First-wins and last-wins dedup, unions, and their reports.

Winners are picked by ``min`` / ``max`` over structs (``min_by`` / ``max_by`` with maps): partial aggregation leaves one row per key and
task before the shuffle, so a key with many copies costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _cols(cs) -> list[Column]:
    cs = [cs] if isinstance(cs, (str, Column)) else list(cs)
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _pick(df: DataFrame, key, seq, last: bool) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    order = [seq] if isinstance(seq, (str, Column)) else list(seq)
    named = all(isinstance(c, str) for c in order)
    if named and not any("map<" in t or t == "variant" for _, t in df.dtypes):
        # Order columns lead one struct that is both place and row; the other columns settle ties.
        first = [c for c in dict.fromkeys(order) if c not in keys]
        whole = F.struct(*first, *[c for c in rest if c not in first])
        best = F.max(whole) if last else F.min(whole)
    else:
        place = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(_cols(order))])
        best = (F.max_by if last else F.min_by)(F.struct(*rest), place)
    return df.groupBy(*keys).agg(best.alias("_w")).select(*keys, "_w.*").select(df.columns)


def dedup_last(df: DataFrame, key, seq) -> DataFrame:
    """One row per key: the one latest in ``seq``."""
    return _pick(df, key, seq, last=True)


def dedup_first(df: DataFrame, key, seq) -> DataFrame:
    """One row per key: the one earliest in ``seq``."""
    return _pick(df, key, seq, last=False)


def intern(df: DataFrame, key, seq) -> DataFrame:
    """One global row per distinct value, from its first use."""
    return dedup_first(df, key, seq)


def union_facts(*dfs: DataFrame) -> DataFrame:
    """Union of branches whose columns differ; missing ones become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def merge_passes(first: DataFrame, second: DataFrame, key="entity_id", seq="seq") -> DataFrame:
    """Edges of both passes; the second pass beats the first."""
    both = union_facts(first.withColumn("pass", F.lit(1)), second.withColumn("pass", F.lit(2)))
    return dedup_last(both, key, [F.col("pass"), *_cols(seq)])


def duplicate_report(df: DataFrame, file, key) -> DataFrame:
    """Per file: rows, distinct keys and surplus rows. Counting (file, key) first keeps a hot
    file spread over tasks."""
    per_key = df.groupBy(file, key).agg(F.count(F.lit(1)).alias("c"))
    return per_key.groupBy(file).agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
        (F.sum("c") - F.count(F.lit(1))).alias("n_duplicates"))


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals per node kind and edge type, and overall."""
    n = nodes.rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("node").alias("what"), F.coalesce("kind", F.lit("*")).alias("label"), "n")
    e = edges.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("edge").alias("what"), F.coalesce("type", F.lit("*")).alias("label"), "n")
    return n.unionByName(e)


def language_rollup(nodes: DataFrame) -> DataFrame:
    """Node counts by (language, kind), by language, and in all (level 0, 1, 3)."""
    return nodes.rollup("language", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


def joined_symbols(symbols: Column, sep: str = ",") -> Column:
    """Symbol list of one declaration as sorted text. The list comes from one statement, so
    it is as long as that statement and no longer."""
    return F.array_join(F.array_sort(symbols), sep)


def array_union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)
