"""Order-sensitive operators that stay parallel when one group holds much of the data.

Every operator first looks at the largest group (one aggregate with map-side combine, left out
where Spark estimates the whole input as small). Up to the limit a window over the group is safe, since one task can hold it. Beyond it the rows are
range-partitioned by group and order, each range is scanned on its own, and the state entering
each range comes from one summary row per range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strata.session import group_limit, is_small, materialise

_RANGE = "_range"
_TIE = "_tie"


def _order(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def largest_group(df: DataFrame, keys) -> tuple[int, int]:
    """(rows of the largest group, rows in all)."""
    row = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
           .agg(F.max("n").alias("top"), F.sum("n").alias("total")).first())
    return int(row["top"] or 0), int(row["total"] or 0)


def _ranges(df: DataFrame, keys, order, total: int, limit: int) -> DataFrame:
    """Rows with a frozen range number; ranges follow (keys, order). The last tie-break is a
    row number of this one materialised layout, so equal rows may still be split."""
    n = max(2, -(-total // max(1, limit // 2)))
    tied = df.withColumn(_TIE, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *[F.col(k) for k in keys], *_order(order), F.col(_TIE))
    return materialise(ranged.withColumn(_RANGE, F.spark_partition_id()))


def _same(a: str, b: str, keys) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _with_entry_state(ranged: DataFrame, keys, summary: Column, carry: Column) -> DataFrame:
    """Join to each row ``_entry``: the state carried in from earlier ranges of its group.
    The summary has one row per group and range, so at most one per range boundary more than
    there are groups."""
    before = W.partitionBy(*keys).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    per_range = ranged.groupBy(*keys, _RANGE).agg(summary.alias("_s"))
    entry = per_range.select(*keys, _RANGE, carry.over(before).alias("_entry"))
    r, e = ranged.alias("r"), entry.alias("e")
    return r.join(e, _same("r", "e", [*keys, _RANGE]), "left").select("r.*", "e._entry")


def _scan(df: DataFrame, keys, order, out: str, local, summary: Column, carry: Column,
          combine, limit: int | None) -> DataFrame:
    keys = list(keys)
    whole = W.partitionBy(*keys).orderBy(*_order(order))
    if limit is None and is_small(df):
        return df.withColumn(out, local(whole))
    limit = limit or group_limit(df.sparkSession)
    top, total = largest_group(df, keys)
    if top <= limit:
        return df.withColumn(out, local(whole))
    ranged = _ranges(df, keys, order, total, limit)
    part = W.partitionBy(*keys, _RANGE).orderBy(*_order(order), F.col(_TIE))
    entered = _with_entry_state(ranged, keys, summary, carry)
    return entered.withColumn(out, combine(local(part), F.col("_entry"))).drop("_entry", _RANGE, _TIE)


def number_rows(df: DataFrame, keys, order, out: str = "n", limit: int | None = None) -> DataFrame:
    """Running counter 1, 2, … per group."""
    return _scan(
        df, keys, order, out,
        local=lambda w: F.row_number().over(w).cast("bigint"),
        summary=F.count(F.lit(1)), carry=F.sum("_s"),
        combine=lambda here, entry: here + F.coalesce(entry, F.lit(0)), limit=limit)


def running_sum(df: DataFrame, keys, order, value, out: str = "s", limit: int | None = None) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return _scan(
        df, keys, order, out,
        local=lambda w: F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)),
        summary=F.sum(value), carry=F.sum("_s"),
        combine=lambda here, entry: F.coalesce(here, F.lit(0)) + F.coalesce(entry, F.lit(0)), limit=limit)


def carry_forward(df: DataFrame, keys, order, value, out: str = "v", limit: int | None = None) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its group."""
    value = F.col(value) if isinstance(value, str) else value
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(_order(order))])
    return _scan(
        df, keys, order, out,
        local=lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        summary=F.max_by(value, F.when(value.isNotNull(), place)),
        carry=F.last("_s", ignorenulls=True),
        combine=lambda here, entry: F.coalesce(here, entry), limit=limit)


def document_order(df: DataFrame, path: str, line, col, end_line, end_col, ties=(), out: str = "ord",
                   limit: int | None = None) -> DataFrame:
    """Pre-order position of facts in a file: by start, then the longer span first."""
    order = [F.col(line), F.col(col), F.col(end_line).desc(), F.col(end_col).desc(), *_order(ties)]
    return number_rows(df, [path], order, out, limit)


def best_by_rank(df: DataFrame, keys, rank, keep) -> DataFrame:
    """Per key the ``keep`` columns of the candidate with the lowest rank: a grouped
    aggregate, so a hot key is combined before the shuffle. ``rank`` must order candidates
    totally for a repeatable choice."""
    order = F.struct(*[o.alias(f"r{i}") for i, o in enumerate(_order(rank))])
    best = F.min_by(F.struct(*keep), order)
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
