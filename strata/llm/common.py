"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strata.session import scratch

# ASCII white space separates words; everything else belongs to one.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, all other characters stay."""
    return F.translate(text, _UPPER, _UPPER.lower())


def utf8(text: Column | str) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def words(data: bytes) -> list[bytes]:
    """Words of UTF-8 text between ASCII white space (``bytes.split`` knows just that white space)."""
    return data.split()


def lower_words(data: bytes) -> list[bytes]:
    """The same after A-Z became a-z (``bytes.lower`` touches nothing else)."""
    return data.lower().split()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, rows: int = 512) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows. It yields dicts of column lists, so a task
    holds the results of one slice, whatever the size of Spark's batches."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for out in fn(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def labelled_sample(df: DataFrame, labels: DataFrame, id: str, columns: list[str], rows: int) -> DataFrame:
    """Rows of ``df`` with their label columns, for at most ``rows`` labelled ids: those whose hash is
    least, so the choice depends on the ids alone. ``rows`` bounds what is broadcast."""
    chosen = (labels.where(F.col(id).isNotNull()).groupBy(id).agg(*[F.max(c).alias(c) for c in columns])
              .orderBy(F.xxhash64(id), id).limit(rows))
    key, = fresh(df, "_key")
    chosen = F.broadcast(chosen.withColumnRenamed(id, key))
    return df.drop(*columns).join(chosen, F.col(id) == F.col(key)).drop(key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once under the shared folder and read back, packed more tightly than Spark's default;
    for texts and whatever else is large."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
