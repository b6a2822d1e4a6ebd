"""Joins between facts and nodes.

Keys such as a hot callee name or a hub node may hold a large share of one side. ``skew_join``
finds them with one map-side-combined count and splits only their rows. Broadcasts are left to
Spark, which checks sizes before and, with AQE, while running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.session import group_limit, is_small

MAX_HOT = 1000
CLASSES = 1 << 16  # of keys; only keys of classes beyond the limit are counted


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> list[int]:
    """Hashes of the keys with more rows than one task should own, at most MAX_HOT of the
    largest (any further one holds under 1/MAX_HOT of the rows, which AQE splits). Rows are counted
    by classes of keys first, so that without hot keys next to nothing is shuffled; ``df`` itself is computed
    for it, so give it the rows before any costly step."""
    if limit is None and is_small(df):
        return []
    limit = limit or group_limit(df.sparkSession)
    classes = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(CLASSES)).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    full = [r["_c"] for r in classes.where(F.col("_n") > limit).select("_c").collect()]
    if not full:
        return []
    counts = df.where(F.pmod(F.xxhash64(*keys), F.lit(CLASSES)).isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    top = counts.orderBy(F.desc("_n")).limit(MAX_HOT).select(F.xxhash64(*keys).alias("_h"))
    return [r["_h"] for r in top.collect()]


def skew_join(left: DataFrame, right: DataFrame, keys, how: str = "left",
              limit: int | None = None, salts: int = 64, hot: list[int] | None = None) -> DataFrame:
    """Equi-join on columns both sides share, for a right side with few rows per key. Rows of
    hot left keys spread over ``salts`` parts; only the matching right rows are repeated.
    ``hot`` takes the hashes of an earlier ``hot_keys`` on the same left side."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = hot_keys(left, keys, limit) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    spread = [c for c in left.columns if c not in keys
              and not dict(left.dtypes)[c].startswith("map")] or keys
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    l = left.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.withColumn("_salt", F.explode(copies))
    return l.join(r, [*keys, "_salt"], how).drop("_salt")


def attach(edges: DataFrame, nodes: DataFrame, on: str, prefix: str, cols=("kind", "name", "file_path"),
           limit: int | None = None, hot: list[int] | None = None) -> DataFrame:
    """Left-join node columns (renamed ``prefix_…``) by the id in ``on``; ``prefix_found``
    tells whether the node exists. ``hot`` as in ``skew_join``."""
    side = nodes.select(F.col("entity_id").alias(on), *[F.col(c).alias(f"{prefix}_{c}") for c in cols],
                        F.lit(True).alias(f"{prefix}_found"))
    joined = skew_join(edges, side, on, "left", limit, hot=hot)
    return joined.withColumn(f"{prefix}_found", F.coalesce(F.col(f"{prefix}_found"), F.lit(False)))


def placeholder(edges: DataFrame, nodes: DataFrame, on: str = "target_id",
                limit: int | None = None) -> DataFrame:
    """``is_placeholder``: the target is absent from the nodes."""
    known = nodes.select(F.col("entity_id").alias(on), F.lit(True).alias("_known"))
    joined = skew_join(edges, known, on, "left", limit)
    return joined.withColumn("is_placeholder", F.col("_known").isNull()).drop("_known")


def restrict(df: DataFrame, targets: DataFrame, on) -> DataFrame:
    """Rows whose key is in the target set."""
    return df.join(targets, on, "left_semi")


def placeholders(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node for each endpoint that no node has. Endpoints are made distinct before the
    anti-join, so hubs do not weigh on it."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct()
    missing = ends.join(nodes.select("entity_id"), "entity_id", "left_anti")
    return missing.select("entity_id", F.lit("Placeholder").alias("kind"))
