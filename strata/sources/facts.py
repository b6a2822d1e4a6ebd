"""Per-file fact documents: JSON in, JSON or Parquet out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions.ids import norm_path

_NODE = ("kind:string, name:string, filePath:string, entityId:string, language:string, startLine:int, "
         "endLine:int, startColumn:int, endColumn:int, parentId:string, properties:map<string,string>")
_EDGE = ("type:string, sourceId:string, targetId:string, entityId:string, weight:int, "
         "properties:map<string,string>")
FACT_SCHEMA = (f"filePath string, nodes array<struct<{_NODE}>>, relationships array<struct<{_EDGE}>>, "
               "_corrupt_record string")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per fact file; a broken file keeps its text in ``_corrupt_record``."""
    return spark.read.schema(FACT_SCHEMA).option("multiLine", True).json(folder)


def parse_documents(df: DataFrame, json: str = "value") -> DataFrame:
    """The same from a text column."""
    parsed = F.from_json(F.col(json), FACT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return df.withColumn("_d", parsed).select(*[c for c in df.columns if c != json], "_d.*")


def valid_facts(df: DataFrame) -> DataFrame:
    """Documents that have a path, nodes and relationships."""
    return df.where(F.col("_corrupt_record").isNull() & (F.coalesce(F.col("filePath"), F.lit("")) != "")
                    & F.col("nodes").isNotNull() & F.col("relationships").isNotNull())


def fact_nodes(docs: DataFrame) -> DataFrame:
    n = docs.select("filePath", F.posexplode("nodes").alias("seq", "n"))
    return n.select(
        F.col("n.entityId").alias("entity_id"), "n.kind", "n.name",
        F.coalesce("n.filePath", "filePath").alias("file_path"), "n.language",
        F.col("n.startLine").alias("start_line"), F.col("n.endLine").alias("end_line"),
        F.col("n.startColumn").alias("start_col"), F.col("n.endColumn").alias("end_col"),
        F.col("n.parentId").alias("parent_id"), "n.properties", F.col("seq").cast("bigint").alias("seq"))


def fact_edges(docs: DataFrame) -> DataFrame:
    e = docs.select("filePath", F.posexplode("relationships").alias("seq", "e"))
    return e.select(
        F.col("e.entityId").alias("entity_id"), "e.type", F.col("e.sourceId").alias("source_id"),
        F.col("e.targetId").alias("target_id"), "e.weight", "e.properties",
        F.col("filePath").alias("file_path"), F.col("seq").cast("bigint").alias("seq"))


def read_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = valid_facts(read_documents(spark, folder))
    return fact_nodes(docs), fact_edges(docs)


def path_key(path) -> Column:
    return F.sha2(norm_path(path), 256)


def write_facts(df: DataFrame, folder: str, path: str = "file_path", fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Facts with the hash of their source path, so one file's facts can be found and replaced."""
    df.withColumn("path_key", path_key(path)).write.mode(mode).format(fmt).save(folder)
