"""Graph store: upserts as DataFrame functions, versions as Parquet folders."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.functions.props import clean_props, coalesce_weight, merge_maps
from strata.model import EDGE_SCHEMA, EDGE_TYPES, KINDS, NODE_SCHEMA, edges_like, nodes_like
from strata.operators.dedup import count_by, dedup_last


def upsert_nodes(current: DataFrame, batch: DataFrame, seq="seq") -> DataFrame:
    """Batch rows replace current ones by entity id, properties and label included."""
    fresh = dedup_last(batch, "entity_id", seq)
    kept = current.join(fresh.select("entity_id"), "entity_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_edges(current: DataFrame, batch: DataFrame, seq="seq") -> DataFrame:
    """New edges are inserted whole. On an existing edge only the batch's property keys change;
    weight and creation time stay."""
    key = ["entity_id", "type", "source_id", "target_id"]
    rest = [c for c in current.columns if c not in key]
    fresh = dedup_last(batch, key, seq)
    c = current.select(*key, F.struct(*rest).alias("c"))
    b = fresh.select(*key, F.struct(*[F.col(x) if x in fresh.columns else F.lit(None).alias(x) for x in rest]).alias("b"))
    both = c.join(b, key, "full")
    out = []
    for col in rest:
        if col == "properties":
            out.append(merge_maps("c.properties", clean_props("b.properties", "edge")).alias(col))
        elif col == "weight":
            out.append(F.when(F.col("c").isNotNull(), F.col("c.weight"))
                       .otherwise(coalesce_weight("b.weight", 0)).alias(col))
        else:
            out.append(F.when(F.col("c").isNotNull(), F.col(f"c.{col}")).otherwise(F.col(f"b.{col}")).alias(col))
    return both.select(*key, *out)


def patch_nodes(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the given property keys on existing nodes; other keys stay."""
    u = updates.select("entity_id", F.col("properties").alias("_patch"))
    return nodes.join(u, "entity_id", "left").withColumn(
        "properties", F.when(F.col("_patch").isNull(), F.col("properties"))
        .otherwise(merge_maps("properties", "_patch"))).drop("_patch")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Entity ids that occur more than once within a label."""
    return count_by(nodes, "kind", "entity_id").where("n > 1")


def unknown_labels(nodes: DataFrame, edges: DataFrame, kinds=None, types=None) -> DataFrame:
    """Node kinds and edge types outside the catalog, with counts."""
    n = count_by(nodes, "kind").where(~F.col("kind").isin(kinds or KINDS))
    e = count_by(edges, "type").where(~F.col("type").isin(types or EDGE_TYPES))
    return n.select(F.lit("node").alias("what"), F.col("kind").alias("label"), "n").unionByName(
        e.select(F.lit("edge").alias("what"), F.col("type").alias("label"), "n"))


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    dup = duplicate_ids(nodes).select(
        F.lit("duplicate").alias("problem"), F.concat_ws(" ", "kind", "entity_id").alias("subject"), "n")
    unk = unknown_labels(nodes, edges).select(
        F.lit("unknown").alias("problem"), F.concat_ws(" ", "what", "label").alias("subject"), "n")
    return dup.unionByName(unk)


def lookup(nodes: DataFrame, kind: str, name: str | None = None, file_path: str | None = None) -> DataFrame:
    """Nodes of one label by name or file; on a stored graph the label prunes partitions and
    the rest is pushed to the Parquet scan."""
    hit = nodes.where(F.col("kind") == kind)
    if name is not None:
        hit = hit.where(F.col("name") == name)
    if file_path is not None:
        hit = hit.where(F.col("file_path") == file_path)
    return hit


class GraphStore:
    """Versions of the graph under one folder. A write makes a new version folder and then its
    commit marker; readers take the latest committed version, so a job lost half-way leaves the
    graph as it was."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _p(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """Latest committed version, 0 when none."""
        fs, commits = self._fs(), self._p("commits")
        if not fs.exists(commits):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(commits)), default=0)

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        v = self.version() if version is None else version
        if v == 0:
            empty = self.spark.createDataFrame
            return empty([], NODE_SCHEMA), empty([], EDGE_SCHEMA)
        base = f"{self.path}/v{v}"
        return (nodes_like(self.spark.read.schema(NODE_SCHEMA).parquet(f"{base}/nodes")),
                edges_like(self.spark.read.schema(EDGE_SCHEMA).parquet(f"{base}/edges")))

    def write(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Commit a version: nodes by kind, edges by type, each sorted for its lookups. Rows are
        spread by id within a label, so a label with most of the rows is written by many tasks."""
        v = self._stage(nodes, edges)
        self.commit(v)
        return v

    def _stage(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Write a version that no reader sees yet."""
        v = self._claim()
        base = f"{self.path}/v{v}"
        write_nodes(nodes_like(nodes), f"{base}/nodes")
        write_edges(edges_like(edges), f"{base}/edges")
        return v

    def _claim(self) -> int:
        """A version that no other writer has: its claim is created by one of them only. A writer that dies
        leaves a claim without a commit, which readers never see."""
        fs = self._fs()
        fs.mkdirs(self._p("claims"))
        v = self.version() + 1
        while True:
            if not fs.exists(self._p("claims", str(v))):
                try:
                    fs.create(self._p("claims", str(v)), False).close()
                    return v
                except Py4JJavaError:
                    if not fs.exists(self._p("claims", str(v))):
                        raise
            v += 1

    def commit(self, version: int) -> None:
        self._fs().mkdirs(self._p("commits"))
        self._fs().create(self._p("commits", str(version)), True).close()

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Upsert into the latest version. If another writer commits meanwhile, the batch is applied again to
        that version, so neither is lost; only commits within the moment between look and commit can cross."""
        while True:
            base = self.version()
            n, e = self.read(base)
            v = self._stage(upsert_nodes(n, nodes_like(nodes)), upsert_edges(e, edges_like(edges)))
            if self.version() == base:
                self.commit(v)
                return v

    def reset(self) -> int:
        """Empty graph as the newest version."""
        empty = self.spark.createDataFrame
        return self.write(empty([], NODE_SCHEMA), empty([], EDGE_SCHEMA))


def write_nodes(nodes: DataFrame, path: str) -> None:
    (nodes.repartition("kind", F.pmod(F.xxhash64("entity_id"), F.lit(_fan(nodes))))
     .sortWithinPartitions("kind", "file_path", "name")
     .write.mode("overwrite").partitionBy("kind").parquet(path))


def write_edges(edges: DataFrame, path: str) -> None:
    (edges.repartition("type", F.pmod(F.xxhash64("entity_id"), F.lit(_fan(edges))))
     .sortWithinPartitions("type", "source_id")
     .write.mode("overwrite").partitionBy("type").parquet(path))


def _fan(df: DataFrame) -> int:
    """Files per label at most: as many as shuffle tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
