"""Session settings and reliable materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Group size (rows) up to which one task may own a whole group; see operators.ordered.
GROUP_LIMIT = "strata.group.maxRows"
GROUP_LIMIT_DEFAULT = 2_000_000


def build(app: str = "strata", cores: str = "*", **conf) -> SparkSession:
    """Session for local work; on a cluster use spark-submit and its own settings."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false"))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for materialised tables: ``spark.checkpoint.dir``, else the context's
    checkpoint folder; a temporary folder only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="strata-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written once under the shared folder and read back, for plans with several
    readers: unlike a checkpoint, each reader then scans only its columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# Inputs that Spark estimates below this many bytes cannot overload a task, whatever their keys.
SMALL_INPUT = 32 * 1024 * 1024


def is_small(df: DataFrame) -> bool:
    """Spark's own size estimate says the rows fit one task with room to spare. Where the group
    limit is set by hand, groups are always measured."""
    if df.sparkSession.conf.get(GROUP_LIMIT, None) is not None:
        return False
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_INPUT


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_LIMIT, str(GROUP_LIMIT_DEFAULT)))
