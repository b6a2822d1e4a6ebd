"""Near duplicates by SimHash, found through an embedding of segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two bits. The embedding maps it to the bit
counts of its segments, a point of a 32-dimensional grid. Each bit that differs moves one count
by at most one, so the Manhattan distance of two points is at most the Hamming distance of the
fingerprints. Counts are written in unary (0, 1, 2 as 00, 01, 11): then the Manhattan distance is
the number of bits in which two points differ, and both tests are one XOR and one bit count.

Range join: the 32 axes form seven groups. Two points at most four apart differ in at most four
groups, so they fall into one grid cell under at least one of the 35 choices of three groups.
Points meet in equal cells only; the Manhattan distance filters them, the Hamming distance decides.

Cells of more than ``cell_limit`` fingerprints are not paired up. Their members go to all points
within two bits of them instead (2,081 each): two fingerprints are at most four bits apart exactly
if they share such a point, and all that share one link to its smallest. So a group of any size
costs in proportion to its size, and no link between groups is lost.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts under four
words (``shingle``) are one shingle; repeated rows share a fingerprint; an empty table gives an
empty table; null ids never name a component unless it has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.common import lower_words, map_arrow, utf8
from strata.llm.components import components
from strata.session import written

GROUPS = (5, 5, 5, 5, 4, 4, 4)  # segments of each group of axes
BITS = 4  # so many bits may differ
CELL_LIMIT = 512
_SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(data: bytes, shingle: int) -> int:
    """64-bit fingerprint of a text: a bit is set if it is set in over half of the shingles' hashes."""
    words = lower_words(data)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first, last = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, _SEED)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):  # long texts in spans
        stop = min(n, at + (1 << 16))
        hashes = [digest(joined[a:b], _SEED) for a, b in zip(first[at:stop], last[at + shingle - 1:stop + shingle - 1])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row of ``docs``; ``fp`` holds the 64 bits as a signed long."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        fps = [_signed(simhash(t, shingle)) for t in batch.column(1).to_pylist()]
        yield {"id": batch.column(0), "fp": fps}
    return map_arrow(docs.select(F.col(id).alias("id"), utf8(text).alias("t")), run, f"id {kind}, fp bigint")


def _mask(groups) -> int:
    out, at = 0, 0
    for g, size in enumerate(GROUPS):
        if g in groups:
            out |= ((1 << 2 * size) - 1) << 2 * at
        at += size
    return _signed(out)


def embed(fp: Column) -> Column:
    """Bit counts of the 32 segments in unary."""
    even = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def cells(points: DataFrame, choices) -> DataFrame:
    """A row per point (columns fp, point) and choice of groups, with the cell of the grid it lies in."""
    masks = F.array(*[F.lit(_mask(c)) for c in choices])
    return (points.select("*", F.posexplode(masks).alias("choice", "mask"))
            .withColumn("cell", F.col("point").bitwiseAND(F.col("mask"))).drop("mask"))


def crowded_cells(cells: DataFrame, limit: int) -> DataFrame:
    """(choice, cell) of the cells with more than ``limit`` members; written once."""
    sizes = cells.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n"))
    return written(sizes.where(F.col("n") > limit).select("choice", "cell"), "crowded")


def links(distinct: DataFrame, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(a, b) pairs of different fingerprints at most four bits apart; ``distinct`` has each once, as
    ``fp``. Within crowded cells only as many pairs as keep them connected."""
    points = distinct.select("fp", embed(F.col("fp")).alias("point"))
    placed = cells(points, combinations(range(len(GROUPS)), 3))
    crowded = crowded_cells(placed, cell_limit)
    calm = placed.join(crowded, ["choice", "cell"], "left_anti")
    left = calm.select("choice", "cell", F.col("fp").alias("a"), F.col("point").alias("pa"))
    right = calm.select("choice", "cell", F.col("fp").alias("b"), F.col("point").alias("pb"))
    # Merged, not broadcast: Spark sizes both sides as before their points were repeated per choice or midpoint.
    pairs = left.join(right.hint("merge"), (left.choice == right.choice) & (left.cell == right.cell) & (F.col("a") < F.col("b"))
                      & (_differ("pa", "pb") <= BITS) & (_differ("a", "b") <= BITS)).select("a", "b")
    # Members of crowded cells meet at the points within two bits of both: flip two of 64 bits, where a
    # 65th stands for no flip, or none at all.
    bit = lambda i: F.when(F.col(i) < 64, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(i))).otherwise(F.lit(0).cast("bigint"))
    at = (placed.join(crowded, ["choice", "cell"], "left_semi").select("fp").distinct()
          .select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
          .select("fp", "i", F.explode(F.sequence(F.col("i"), F.lit(64))).alias("j"))
          .where("i < j or i = 64")
          .select("fp", F.when(F.col("i") == F.col("j"), F.col("fp"))
                  .otherwise(F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j"))).alias("middle")))
    first = at.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last")
    met = at.join(first.hint("merge"), "middle").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4,
                    cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id reachable over links."""
    prints = written(fingerprints(docs, id, text, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct.select("fp"), cell_limit))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    # Few components have several fingerprints; the others keep their own least id.
    merged = named.where("fp <> root").select("root").distinct()
    least = (named.join(merged, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component")))
    of = named.join(least, "root", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return prints.join(of, "fp", "left").select("id", "fp", "component")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
