"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, ``(offset + j * skip) mod
size``, a permutation since the size is prime. Shards take turns: whoever is on turn claims the first
slot of its order that is still free, until all slots are taken. So shards hold equal numbers of slots
up to one, and when a shard comes or goes few other slots change hands. A weight gives a shard that
many turns a round.

The table depends on the shards' names alone and has a fixed number of rows (``SIZE``, a prime), which
bounds the broadcast. A row's slot is a hash of its key, so a row is placed in constant time without
a shuffle. Only DataFrame functions touch the data.

Edge cases: null keys are placed as empty texts; equal keys go to one shard, so ``place`` also takes
columns that tell rows of one hot key apart (``spread``); an empty table gives an empty table; columns
named as the result is are told apart by a leading underscore.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strata.llm.common import fresh

SIZE = 65537


def _number(name: str, use: str) -> int:
    return int.from_bytes(hashlib.md5(f"{use}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill(shards: dict[str, int] | list[str], size: int = SIZE) -> list[str]:
    """The shard of every slot. ``shards`` may give each a whole weight of one or more."""
    weights = dict.fromkeys(shards, 1) if not isinstance(shards, dict) else dict(shards)
    if not weights or any(w < 1 for w in weights.values()):
        raise ValueError("at least one shard, with weights of one or more")
    if not _is_prime(size) or size < sum(weights.values()):
        raise ValueError("the table's size must be a prime of at least one slot a turn")
    names = sorted(weights)
    nth = {s: _number(s, "offset") % size for s in names}
    skip = {s: _number(s, "skip") % (size - 1) + 1 for s in names}
    owner: list[str | None] = [None] * size
    left = size
    while True:
        for s in names:
            for _ in range(weights[s]):
                while owner[nth[s]] is not None:
                    nth[s] = (nth[s] + skip[s]) % size
                owner[nth[s]] = s
                left -= 1
                if not left:
                    return owner


def lookup(spark: SparkSession, shards, size: int = SIZE) -> DataFrame:
    """(slot, shard): the table, ``size`` rows."""
    rows = T.StructType([T.StructField("slot", T.LongType(), False), T.StructField("shard", T.StringType(), False)])
    return spark.createDataFrame(list(enumerate(fill(shards, size))), rows)


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % size


def place(df: DataFrame, key: str, table: DataFrame, size: int = SIZE, spread: list[str] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``. With ``spread``, the key and those columns choose the slot."""
    slot, shard, at = fresh(df, "slot", "shard", "_at")
    by = F.col(key) if not spread else F.concat_ws("\0", F.coalesce(F.col(key).cast("string"), F.lit("")), *[F.col(c).cast("string") for c in spread])
    known = F.broadcast(table.select(F.col("slot").alias(at), F.col("shard").alias(shard)))
    placed = df.withColumn(slot, slot_of(by, size))
    return placed.join(known, F.col(slot) == F.col(at)).drop(at)
