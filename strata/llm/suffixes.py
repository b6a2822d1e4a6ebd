"""Removal of repeated byte strings with a logarithmic family of sampled suffix arrays.

Every byte goes that is covered by a string of ``length`` bytes which also starts anywhere else. Strings are
compared on the input, so of a repeat no occurrence stays.

Sampling. Of each window of ``length`` bytes the suffix is taken that starts at the place with the least hash of
its first ``GRAM`` bytes (rolling hash; the leftmost of equal ones). Equal windows choose the same place, and the
windows that choose one place are successive: a *run*. About one suffix in a hundred is taken.

Index. An entry is a suffix's first eight bytes, the hash of its first ``GRAM`` bytes, and the least and the
largest digest of the runs (their windows' bytes) seen with it. A batch's suffix array is a table of its entries in order of these
keys, bucketed by them. It is scanned in step with every level of the index (joins of
equally bucketed tables, without a shuffle), which yields each suffix met twice and whether its runs
are all alike. Then it becomes a level; levels of equal weight are merged, so an entry is rewritten
only as often as the index doubles.

Borders. Where all runs of a suffix are alike, all their windows are repeated. Else runs that are alike are
repeated, and the others are compared at their borders: their bytes are fetched, cut into pieces of
``PIECE`` windows, and only pieces that do not repeat, but of which the bytes common to all their windows do, are compared window by
window. Every step counts digests by aggregation; members of a group never meet each other, whatever the group's size.

Scale. Documents are read once for the samples, joined once with the places of border runs and once with
the spans to remove. All else is a few hundredths of the text. Key equality is on 128 bits throughout.

Edge cases: null counts as empty; texts under ``length`` bytes keep everything; rows equal in id and text are
documents of their own and repeat each other; texts of any size are sampled in chunks; null ids
are like any other; an empty table gives an empty table; other columns are kept, whatever their names, but for
``kept`` and ``removed``, which are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.common import fresh, map_arrow, stored, utf8

LENGTH = 400
GRAM = 200
PIECE = 16
BATCHES = 4
CHUNK = 1 << 19  # windows sampled at a time
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Sampler:
    """Runs of windows and the suffixes they choose."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)

    def runs(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, first window, last window) of each run, in order."""
        found = [self._chunk(data[a:a + CHUNK + self.length - 1], a) for a in range(0, len(data) - self.length + 1, CHUNK)]
        if not found:
            return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _chunk(self, data: bytes, base: int):
        n, gram = len(data), self.gram
        width, windows, places = self.length - gram + 1, n - self.length + 1, n - gram + 1
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * self.up[:n], out=total[1:])
        h = (total[gram:] - total[:places]) * self.down[:places]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        # The place is in the low bits, so that the leftmost of equal hashes is the least.
        rank = np.full(-(-places // width) * width, np.iinfo(np.uint64).max, np.uint64)
        rank[:places] = h & ~_PLACE | np.arange(places, dtype=np.uint64)
        blocks = rank.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(after[:windows], before[width - 1:width - 1 + windows]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:] - 1, windows - 1)
        return chosen[first] + base, h[chosen[first]], first + base, last + base


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def samples(docs: DataFrame, id: str, text: str, length: int, gram: int, batches: int) -> DataFrame:
    """(row, id, hash, batch, head, h, s): per document the lists of its suffixes' first bytes, hashes and runs' digests."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        sampler, heads, hashes, digests = Sampler(length, gram), [], [], []
        for data in batch.column("t"):
            data = data.as_py()
            place, h, first, last = sampler.runs(data)
            x = np.frombuffer(data, np.uint8)
            heads.append(x[place[:, None] + np.arange(8)].view(">i8").ravel().astype(np.int64) if len(place) else np.empty(0, np.int64))
            hashes.append(_signed(h))
            runs = [xxhash.xxh3_64_intdigest(data[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
            digests.append(_signed(np.array(runs, np.uint64)))
        yield {k: batch.column(k) for k in ("id", "hash")} | {"head": heads, "h": hashes, "s": digests}
    picked = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), utf8(text).alias("t"))
    schema = f"id {kind}, hash bigint, head array<bigint>, h array<bigint>, s array<bigint>"
    # Texts of fewer bytes have no window; their character count is no more than that.
    rows = map_arrow(picked.where(F.octet_length("t") >= length), run, schema, rows=128)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return stored(numbered.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")), "samples")


class Levels:
    """A logarithmic family of sampled suffix arrays. A level is a bucketed table (head, h, lo, hi, n)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.levels = spark, []  # (batches held, table), the largest first
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        (df.write.option("compression", "zstd").bucketBy(self.buckets, "head", "h").sortBy("head", "h").saveAsTable(name))
        return name

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Add a batch (head, h, s); returns (head, h, lo, hi) of its suffixes that occur twice in it or in it and
        a level. ``lo`` and ``hi`` differ if runs do."""
        entries = suffixes.groupBy("head", "h").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("n"))
        name, weight = self._write(entries), 1
        new = self.spark.table(name)
        met = [new.where("n > 1").select("head", "h", "lo", "hi")]
        for _, level in self.levels:
            old = self.spark.table(level).select("head", "h", F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
            met.append(new.join(old.hint("merge"), ["head", "h"]).select("head", "h", F.least("lo", "lo_").alias("lo"), F.greatest("hi", "hi_").alias("hi")))
        found = met[0]
        for m in met[1:]:
            found = found.unionByName(m)
        found = stored(found, "met")
        while self.levels and self.levels[-1][0] == weight:
            _, old = self.levels.pop()
            name, weight = self._merge(name, old), 2 * weight
        self.levels.append((weight, name))
        return found

    def _merge(self, a: str, b: str) -> str:
        x, y = (self.spark.table(t).select("head", "h", *[F.col(c).alias(f"{c}_{k}") for c in ("lo", "hi", "n")]) for k, t in enumerate((a, b)))
        both = x.join(y.hint("merge"), ["head", "h"], "full")
        zero = F.lit(0).cast("bigint")
        merged = both.select("head", "h", F.least("lo_0", "lo_1").alias("lo"), F.greatest("hi_0", "hi_1").alias("hi"),
                             (F.coalesce("n_0", zero) + F.coalesce("n_1", zero)).alias("n"))
        name = self._write(merged)
        for t in (a, b):
            self.spark.sql(f"DROP TABLE {t}")
        return name

    def drop(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def _exploded(lists: DataFrame, *columns: str) -> DataFrame:
    each = lists.select(*columns, F.posexplode(F.arrays_zip("head", "h", "s")).alias("k", "e"))
    return each.select(*columns, "k", "e.head", "e.h", "e.s")


def _border_runs(docs: DataFrame, wanted: DataFrame, id: str, text: str, length: int, gram: int) -> DataFrame:
    """(id, hash, h, s, place, first, data) of the wanted runs: ``data`` holds the bytes of their windows."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        sampler, out = Sampler(length, gram), {k: [] for k in ("id", "hash", "h", "s", "place", "first", "data")}
        for i, digest, data, ks in zip(*(batch.column(c) for c in ("id", "hash", "t", "ks"))):
            data, id_, digest = data.as_py(), i.as_py(), digest.as_py()
            place, h, first, last = sampler.runs(data)
            for k in ks.as_py():
                body = data[first[k]:last[k] + length]
                for c, v in (("id", id_), ("hash", digest), ("h", int(_signed(h[k:k + 1])[0])), ("place", int(place[k])), ("first", int(first[k])), ("data", body),
                             ("s", int(_signed(np.array([xxhash.xxh3_64_intdigest(body)], np.uint64))[0]))):
                    out[c].append(v)
        yield out
    lists = wanted.groupBy("id", "hash").agg(F.sort_array(F.collect_set("k")).alias("ks")).withColumnsRenamed({"id": "id_", "hash": "hash_"})
    lists = stored(lists, "wanted")
    own = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), utf8(text).alias("t"))
    joined = own.join(lists.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_"))).drop("id_", "hash_")
    schema = f"id {kind}, hash bigint, h bigint, s bigint, place bigint, first bigint, data binary"
    return stored(map_arrow(joined, run, schema, rows=128), "borders")


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cut(place: int, first: int, count: int) -> list[tuple[int, int, int]]:
    """(t, a, b): the windows a to b of a run whose distance from the place is t times PIECE or little more."""
    t = (place - first - np.arange(count)) // PIECE
    starts = np.flatnonzero(np.diff(t, prepend=t[0] + 1))
    return list(zip(t[starts].tolist(), (first + starts).tolist(), (first + np.append(starts[1:], count) - 1).tolist()))


def _pieces(runs: DataFrame, length: int, kind: str) -> DataFrame:
    """(h, t, core, d, id, hash, s, a, b, own) of all pieces of the runs: windows a to b with the digest of their bytes, and that of
    the bytes that every window has whose distance from the place gives the same t."""
    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("id", "hash", "h", "s", "t", "core", "d", "a", "b", "own")}
        for i, digest, h, s, place, first, data, own in zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "h", "s", "place", "first", "data", "own"))):
            for t, a, b in _cut(place, first, len(data) - length + 1):
                core = data[place - t * PIECE - first:place - (t + 1) * PIECE + 1 + length - first]
                values = (i, digest, h, s, t, _long(xxhash.xxh3_64_intdigest(core)), _long(xxhash.xxh3_64_intdigest(data[a - first:b + length - first])), a, b, own)
                for c, v in zip(out, values):
                    out[c].append(v)
        yield out
    return map_arrow(runs, run, f"id {kind}, hash bigint, h bigint, s bigint, t bigint, core bigint, d bigint, a bigint, b bigint, own boolean", rows=512)


def _windows(runs: DataFrame, length: int, kind: str) -> DataFrame:
    """(w, h, s, id, hash, a, own) of each window of the pieces listed in ``ts``."""
    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("id", "hash", "h", "s", "w", "a", "own")}
        for i, digest, h, s, place, first, data, own, ts in zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "h", "s", "place", "first", "data", "own", "ts"))):
            for t, a, b in _cut(place, first, len(data) - length + 1):
                for at in range(a, b + 1) if t in ts else ():
                    for c, v in zip(out, (i, digest, h, s, _long(xxhash.xxh3_64_intdigest(data[at - first:at - first + length])), at, own)):
                        out[c].append(v)
        yield out
    return map_arrow(runs, run, f"id {kind}, hash bigint, h bigint, s bigint, w bigint, a bigint, own boolean", rows=512)


def repeated_windows(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                     batches: int = BATCHES) -> DataFrame:
    """(id, hash, spans): per document with repeats (hash: xxhash64 of the text) the first and last of successive repeated windows."""
    spark, kind = docs.sparkSession, docs.schema[id].dataType.simpleString()
    lists = samples(docs, id, text, length, gram, batches)
    index, met = Levels(spark), []
    for batch in range(batches):
        met.append(index.add(_exploded(lists.where(F.col("batch") == batch)).select("head", "h", "s")))
    index.drop()
    twice = met[0]
    for m in met[1:]:
        twice = twice.unionByName(m)
    twice = twice.groupBy("head", "h").agg((F.min("lo") < F.max("hi")).alias("mixed"))
    hits = stored(_exploded(lists, "row").join(stored(twice, "twice").hint("merge"), ["head", "h"]), "hits")
    # Runs of mixed suffixes: alike ones are repeated, the others need a look at their borders.
    of_run = hits.where("mixed").groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "k")).alias("at"))
    of_run = stored(of_run, "runs")
    sure = hits.where("not mixed").select("row", "k").unionByName(
        hits.where("mixed").join(of_run.where("n > 1").select("h", "s").hint("merge"), ["h", "s"], "left_semi").select("row", "k"))
    of_row = lists.select("row", "id", "hash")
    wanted = of_run.select("h", "s", "at.row", "at.k", (F.col("n") == 1).alias("own"))
    runs = _border_runs(docs, wanted.join(of_row, "row").select("id", "hash", "k"), id, text, length, gram)
    runs = stored(runs.dropDuplicates(["h", "s"]).join(of_run.select("h", "s", (F.col("n") == 1).alias("own")), ["h", "s"]), "borders")
    pieces = stored(_pieces(runs, length, kind), "pieces")
    # Pieces are of different runs, so two alike are two occurrences.
    counted = pieces.groupBy("h", "t", "core", "d").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
    counted = stored(counted, "piece_counts")
    alike = pieces.where("own").join(counted.where("n > 1").select("h", "t", "core", "d").hint("merge"), ["h", "t", "core", "d"], "left_semi").select("id", "hash", "a", "b")
    # A window can be repeated only where its core is; one piece of each digest stands for all alike.
    shared = counted.groupBy("h", "t", "core").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h", "t", "core")
    opened = counted.join(shared.hint("merge"), ["h", "t", "core"], "left_semi").groupBy("h", "s").agg(F.collect_set("t").alias("ts"))
    windows = stored(_windows(runs.join(opened.hint("merge"), ["h", "s"]), length, kind), "windows")
    again = windows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w")
    single = windows.where("own").join(again.hint("merge"), ["h", "w"], "left_semi").select("id", "hash", "a", F.col("a").alias("b"))
    borders = alike.unionByName(single).groupBy("id", "hash").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    whole = sure.groupBy("row").agg(F.sort_array(F.collect_set("k")).alias("ks")).join(of_row, "row").groupBy("id", "hash").agg(F.first("ks").alias("ks"))
    borders = borders.withColumnsRenamed({"id": "id_", "hash": "hash_"})
    both = whole.join(borders, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")), "full")
    return stored(both.select(F.coalesce("id", "id_").alias("id"), F.coalesce("hash", "hash_").alias("hash"), "ks", "spans"), "spans")


def joined(windows: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Maximal byte spans [start, end) covered by windows given as (first, last)."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return out


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay, concatenated) and ``removed`` (array of byte spans start, end)."""
    own = docs.drop("kept", "removed")
    found = repeated_windows(docs, id, text, length, gram, batches)
    key, hash_, ks, spans, data = fresh(own, "_id", "_hash", "_ks", "_spans", "_data")
    found = found.select(F.col("id").alias(key), F.col("hash").alias(hash_), F.col("ks").alias(ks), F.col("spans").alias(spans))
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    both = own.join(found.hint("shuffle_hash"), own[id].eqNullSafe(F.col(key)) & (text_hash == F.col(hash_)), "left").withColumn(data, utf8(text))
    names = own.columns

    def run(batch: pa.RecordBatch):
        sampler, kept, removed = Sampler(length, gram), [], []
        for raw, whole, part in zip(batch.column(data), batch.column(ks).to_pylist(), batch.column(spans).to_pylist()):
            raw, windows = raw.as_py(), [(p["a"], p["b"]) for p in part or []]
            if whole:
                _, _, first, last = sampler.runs(raw)
                windows += [(int(first[k]), int(last[k])) for k in whole]
            gone, at, stay = joined(windows, length), 0, []
            for a, b in gone:
                stay.append(raw[at:a])
                at = b
            kept.append(b"".join([*stay, raw[at:]]))
            removed.append([{"start": a, "end": b} for a, b in gone])
        yield {n: batch.column(n) for n in names} | {"kept": kept, "removed": removed}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields), "kept binary", "removed array<struct<start:bigint,end:bigint>>"])
    return map_arrow(both.select(*[f"`{n}`" for n in names], data, ks, spans), run, schema, rows=128)
