"""Streams and change feeds: final states equal their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.checks.registry import query
from strata.session import scratch
from strata.sources.bindings import change_feed, doc_files, doc_src, load
from strata.streaming import watch

_EVENTS = "event_id bigint, ts timestamp, entity_id string, user_id bigint, operation string, value double, props string"


def _event_files(spark, sf):
    """The feed as several files, so a stream takes it in several batches out of time order."""
    folder = scratch(spark, "feed")
    change_feed(spark, sf).repartition(4, "event_id").write.parquet(folder)
    return folder


def _event_stream(spark, sf):
    return spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 1).parquet(_event_files(spark, sf))


_LATEST = """
SELECT entity_id, operation, event_id, value FROM (
  SELECT 'user:' || CAST(user_id AS VARCHAR) AS entity_id, event_type AS operation, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""


@query(_LATEST)
def stream_upsert_events(spark, sf):
    """Micro-batches folded into a table; the last state."""
    folder = scratch(spark, "state")
    q = watch.upsert_stream(_event_stream(spark, sf), folder, scratch(spark, "offsets"), "entity_id", ["ts", "event_id"])
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/{q.lastProgress['batchId']}").select("entity_id", "operation", "event_id", "value")


@query(_LATEST)
def stream_latest_final(spark, sf):
    """Newest version per entity from a stream's updates, rows arriving out of order by up to the watermark."""
    folder, values = scratch(spark, "latest"), ("operation", "event_id", "value")
    updates = watch.latest_updates(_event_stream(spark, sf), "entity_id", "ts", ["event_id"], *values, watermark="60 days", width="7 days")
    watch.append_stream(updates, folder, scratch(spark, "offsets")).awaitTermination()
    return watch.latest(spark.read.parquet(folder), "entity_id", ["ts", "event_id"], *values)


@query("SELECT source, length(text) + 1 AS n FROM documents")
def stream_watch_docs(spark, sf):
    """Documents as one file each, picked up by the file stream."""
    root, folder = scratch(spark, "watched"), scratch(spark, "seen")
    doc_files(spark, sf, root, "source")
    stream = watch.watch_files(spark, root, exts=[".txt"])
    q = (stream.select(F.regexp_extract("path", r"/source=(\w+)/", 1).alias("source"), F.length("text").alias("n"))
         .writeStream.format("parquet").option("path", folder).option("checkpointLocation", scratch(spark, "offsets"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(folder)


def _versions(spark, sf):
    """Documents twice: the second time some are gone, some rewritten, some new."""
    d = doc_src(spark, sf)
    m = F.col("doc_id") % 10
    before = d.where(m != 3)
    after = d.where(m != 1).withColumn("text", F.when(m == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return before, after


_CHANGED = """
SELECT '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
       CASE CAST(doc_id % 10 AS INT) WHEN 1 THEN 'deleted' WHEN 2 THEN 'changed' ELSE 'added' END AS operation, doc_id FROM documents WHERE doc_id % 10 IN (1, 2, 3)"""


@query(f"SELECT path, operation FROM ({_CHANGED})")
def change_log_docs(spark, sf):
    """Rewritten, new and deleted files, through manifests and a streamed change log."""
    folder, seen = scratch(spark, "changes"), scratch(spark, "seen")
    before, after = _versions(spark, sf)
    watch.append_changes(spark, before, folder)
    watch.append_changes(spark, after, folder)
    q = (watch.change_stream(spark, folder).writeStream.format("parquet").option("path", seen)
         .option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(seen).where("version = 2").select("path", "operation")


@query("""
SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN length(text) + 1 ELSE length(text) END AS n FROM documents WHERE doc_id % 10 <> 1""")
def retract_docs(spark, sf):
    """T4: facts of changed and deleted files go, fresh ones come in."""
    before, after = _versions(spark, sf)
    fact = lambda d: d.select(F.col("path").alias("file_path"), "doc_id", F.length("text").alias("n"))
    changed = watch.changes(watch.manifest(before), watch.manifest(after), 2)
    touched = changed.where("operation <> 'deleted'").select(F.col("path").alias("file_path"))
    fresh = fact(after).join(touched, "file_path", "left_semi")
    return watch.refresh(fact(before), changed, fresh).select("doc_id", "n")


@query("""
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR AS window_end,
       event_type, count(*) AS n FROM events GROUP BY ALL""")
def change_windows_events(spark, sf):
    """T5: changes per tumbling window."""
    return watch.change_counts(load(spark, sf, "events"), "ts", "6 hours")


@query("""
WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01'),
                                      time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 3 HOUR]) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n FROM s GROUP BY ALL""")
def change_sliding_events(spark, sf):
    """T5: changes per sliding window."""
    return watch.change_counts(load(spark, sf, "events"), "ts", "6 hours", "3 hours")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS b FROM events),
     s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 4 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def change_sessions_events(spark, sf):
    """T5: bursts of changes per entity."""
    return watch.change_sessions(load(spark, sf, "events"), "ts", "4 hours", "user_id")
