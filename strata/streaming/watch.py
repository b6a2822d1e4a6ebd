"""Keeping the graph current: file streams, change logs, incremental upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.functions.ids import EXTENSIONS
from strata.operators.dedup import dedup_last
from strata.sources.corpus import as_sources
from strata.sources.files import with_options
from strata.sources.globs import dotted, ignore_patterns, ignore_regex
from strata.sources.store import GraphStore


def watch_files(spark: SparkSession, root: str, exts=EXTENSIONS, ignore=(), rewrites: bool = False, settle_ms: int = 0) -> DataFrame:
    """New source files below ``root`` as a stream of sources, whatever their names; with ``rewrites`` also those
    written again. Without, the paths seen are kept as state."""
    stream = with_options(spark, spark.readStream, root, [e.lower() for e in dotted(exts)], ignore_regex(ignore_patterns(ignore)),
                          settleMs=settle_ms).load()
    good = as_sources(stream.where("error is null").select("path", "text", "mtime"))
    return good if rewrites else good.dropDuplicates(["path"])


def manifest(sources: DataFrame) -> DataFrame:
    """(path, hash, mtime) of a listing."""
    mtime = F.col("mtime") if "mtime" in sources.columns else F.lit(None).cast("timestamp")
    return sources.select("path", F.sha2("text", 256).alias("hash"), mtime.alias("mtime"))


def changes(before: DataFrame, after: DataFrame, version: int) -> DataFrame:
    """(path, operation, hash, version): what differs between two manifests. The stream of new
    files reports neither rewrites nor deletions, so those come from here."""
    b = before.select("path", F.col("hash").alias("_old"))
    a = after.select("path", F.col("hash").alias("_new"))
    op = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
          .when(F.col("_old") != F.col("_new"), "changed"))
    return b.join(a, "path", "full").select("path", op.alias("operation"), F.col("_new").alias("hash"),
                                            F.lit(version).cast("bigint").alias("version")).where("operation is not null")


def append_changes(spark: SparkSession, sources: DataFrame, folder: str) -> int:
    """Compare a listing with the last manifest under ``folder``, append the difference to the
    change log and keep the new manifest. Returns the version."""
    store = GraphStore(spark, folder)
    old = store.version()
    version = old + 1
    current = manifest(sources)
    current.write.mode("overwrite").parquet(f"{folder}/manifest/{version}")
    current = spark.read.parquet(f"{folder}/manifest/{version}")
    before = spark.read.parquet(f"{folder}/manifest/{old}") if old else current.limit(0)
    # One folder per version: a rerun after a crash replaces its own output only.
    changes(before, current, version).write.mode("overwrite").parquet(f"{folder}/log/run={version}")
    store.commit(version)
    return version


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The change log as a stream."""
    return (spark.readStream.schema("path string, operation string, hash string, version long")
            .option("recursiveFileLookup", True).parquet(f"{folder}/log"))


def retract(facts: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """Facts without those of changed or deleted files."""
    gone = changed.where("operation in ('changed', 'deleted')").select(F.col("path").alias(path)).distinct()
    return facts.join(gone, path, "left_anti")


def refresh(facts: DataFrame, changed: DataFrame, fresh: DataFrame, path: str = "file_path") -> DataFrame:
    """Retract, then append the new facts of added and changed files."""
    return retract(facts, changed, path).unionByName(fresh, allowMissingColumns=True)


def apply_events(current: DataFrame, batch: DataFrame, key: str, seq) -> DataFrame:
    """Latest row per key over the current table and a batch. Idempotent: a replayed batch
    changes nothing, and late rows lose to newer ones."""
    return dedup_last(current.unionByName(batch), key, seq)


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, key: str, seq,
                  prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Fold a stream into a table, one version folder per micro-batch. A batch writes the folder
    of its own id from that of the batch before, so a retried batch gives the same folder."""
    spark = stream.sparkSession

    def fold(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows = dedup_last(rows, key, seq)
        if batch_id > 0:
            rows = apply_events(spark.read.parquet(f"{folder}/{batch_id - 1}"), rows, key, seq)
        rows.write.mode("overwrite").parquet(f"{folder}/{batch_id}")

    return (stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_updates(stream: DataFrame, key: str, ts: str, seq: list[str], *values: str, watermark: str, width: str) -> DataFrame:
    """For update mode: (key, ts, seq, values), a key's newest values within a stretch of ``width`` whenever they change.
    ``latest`` over the updates gives the newest of all. State is one row per key and stretch, combined before the
    shuffle, and goes when the watermark has passed the stretch; rows later than that are dropped, as are null times."""
    order = list(dict.fromkeys([ts, *seq]))
    best = F.max_by(F.struct(*dict.fromkeys([*order, *values])), F.struct(*order))
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("_w"), key).agg(best.alias("_v")).select(key, "_v.*")


def append_stream(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Updates as Parquet, one folder per micro-batch; a retried batch replaces its own folder only."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return (updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest(df: DataFrame, key: str, seq: Column | str, *values: str) -> DataFrame:
    """Newest values per key; the same aggregation serves a batch, a stream's updates and, in complete mode, a stream
    with rows out of order."""
    at = F.struct(*[F.col(s) if isinstance(s, str) else s for s in (seq if isinstance(seq, (list, tuple)) else [seq])])
    best = F.max_by(F.struct(*values), at)
    return df.groupBy(key).agg(best.alias("_v")).select(key, "_v.*")


def change_counts(df: DataFrame, ts: str, width: str, slide: str | None = None, watermark: str | None = None,
                  by: str = "event_type") -> DataFrame:
    """Changes per tumbling or sliding window and kind."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def change_sessions(df: DataFrame, ts: str, gap: str, key: str, watermark: str | None = None) -> DataFrame:
    """Bursts of changes per key, apart by at least ``gap``."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
