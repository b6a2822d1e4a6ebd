"""Property bags: flattening, packing, defaults, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.ids import as_col
from strata.model import CROSS_FILE_TYPES


def merge_maps(base, top) -> Column:
    """Union of two maps; keys of ``top`` win (independent of the map dedup policy)."""
    base, top = as_col(base), as_col(top)
    empty = F.create_map().cast("map<string,string>")
    base, top = F.coalesce(base, empty), F.coalesce(top, empty)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k)), top)


def drop_nulls(m) -> Column:
    return F.map_filter(as_col(m), lambda k, v: v.isNotNull())


def clean_props(m, mode: str) -> Column:
    """``node``: keys without a value vanish; ``edge``: they stay as NULL."""
    if mode not in ("node", "edge"):
        raise ValueError(mode)
    return drop_nulls(m) if mode == "node" else as_col(m)


def to_map(**cols) -> Column:
    """``map<string,string>`` from named columns."""
    items = []
    for k, v in cols.items():
        items += [F.lit(k), as_col(v).cast("string")]
    return F.create_map(*items)


def flatten_props(df: DataFrame, out: str = "bag") -> DataFrame:
    """Core columns and ``properties`` in one bag: nested keys override core ones, kind is
    dropped, the id always stays."""
    core = [c for c, t in df.dtypes
            if c not in ("kind", "properties", "entity_id") and not t.startswith(("map", "struct", "array"))]
    bag = merge_maps(to_map(**{c: F.col(f"`{c}`") for c in core}), F.col("properties"))
    return df.withColumn(out, drop_nulls(merge_maps(bag, to_map(entity_id="entity_id"))))


def pack_edge(df: DataFrame) -> DataFrame:
    """Edge core as columns, its properties as one struct field."""
    return df.select(
        "entity_id", "source_id", "target_id", "type",
        coalesce_weight("weight", 0).alias("weight"), "created_at",
        clean_props("properties", "edge").alias("properties"))


def coalesce_weight(c, default: int) -> Column:
    return F.coalesce(as_col(c), F.lit(default))


def stamp(df: DataFrame, ts) -> DataFrame:
    """One creation time for the whole run."""
    return df.withColumn("created_at", F.lit(ts).cast("timestamp"))


def cross_file(source_file, target_file) -> Column:
    """False when the target is unresolved."""
    return F.coalesce(as_col(source_file) != as_col(target_file), F.lit(False))


def call_weight(is_cross) -> Column:
    return F.when(as_col(is_cross), 6).otherwise(7)


def cross_file_type(type_) -> Column:
    """Prefixed name of a type that may leave its file, else NULL."""
    t = as_col(type_)
    return F.when(t.isin(CROSS_FILE_TYPES), F.concat(F.lit("CROSS_FILE_"), t))
