"""Ranked lexical search with Block-Max MaxScore over a sharded inverted index.

Index. Documents are tokenised and packed into shards of at most ``SHARD_DOCS`` documents and about
``SHARD_TERMS`` terms. A shard's postings of a term are cut into blocks of ``BLOCK`` documents; a block holds
packed deltas of document places and frequencies, and apart from them its last place and its *impacts*: the pairs (frequency,
length) that no other of the block beats (a higher frequency in a shorter document), from which
its largest score follows once the corpus' statistics are known. The index is a table with a row per
shard and term.

Search. The queries' terms get their weights from document frequencies summed over shards. Each shard
keeps a heap per query. The documents are walked in windows of ``WINDOW``. In a window, lists are sorted by
their largest block score there; while the sum of the smallest stays below the heap's least score, those lists are
not essential: no document that only they hold can enter. The essential lists are scored; each non-essential one,
from the largest, is then asked only for the candidates whose score, with the maximum of the block they lie in
and those of the lists still to come, can reach the heap, and only their blocks are unpacked. Bounds are integers, and a candidate
goes only if its bound is *below* the heap's least score, so ties are kept and the result is exact. Shard
heaps (``k`` rows a query) are merged by rank, with a limit per task before the shuffle.

Scale. One task holds one shard's lists of the queries' terms, which is bounded by the shard; documents are read once
and only the index's rows of query terms are shuffled. Queries are taken in blocks of ``QUERY_BLOCK``; what reaches the driver and goes
out with the tasks is the terms of one block of queries.

Edge cases: null and empty texts have no terms and are never found; queries without terms find nothing;
rows of equal ids are documents of their own; of equal scores the lower id goes first, null ids last;
repeated queries are answered each; terms repeated in a query count as often; an empty corpus or query table
gives an empty table; only id and text columns are taken, so clashing names cannot arise.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strata.llm.common import map_arrow, stored, utf8

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK = 64
WINDOW = 1024
SHARD_DOCS = 8192
SHARD_TERMS = 4_000_000
QUERY_BLOCK = 2000
TOP = 20
_SCHEMA = "shard string, term binary, df int, last array<int>, size array<int>, impacts array<bigint>, n_impacts array<int>, data binary"


def terms(data: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all non-ASCII, A-Z lower-cased."""
    return _TERM.findall(data.lower())


def unpack(data: memoryview, at: int, count: int) -> tuple[np.ndarray, int]:
    width = data[at]
    end = at + 1 + width * count
    return np.frombuffer(data[at + 1:end], f"<u{width}").astype(np.int64), end


def _packed(numbers: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write each number to its place in ``out`` with its own count of bytes, lowest first."""
    for byte in range(4):
        there = np.flatnonzero(width > byte)
        out[at[there] + byte] = numbers[there] >> 8 * byte & 255


def term_rows(term: np.ndarray, place: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(terms, columns): the index rows of a shard's postings in order of (term, place). All terms are cut into blocks
    and packed at once. A block is a byte with the width of its gaps, the gaps, a byte with the width of its frequencies and these."""
    n = len(term)
    of_term = np.diff(term, prepend=-1) != 0
    start = np.flatnonzero(of_term)
    nth = np.arange(n) - start[np.cumsum(of_term) - 1]
    first = np.flatnonzero(nth % BLOCK == 0)  # of each block
    count = np.diff(np.append(first, n))
    block = np.repeat(np.arange(len(first)), count)
    gap = place - np.where(of_term, -1, np.append(-1, place[:-1])) - 1
    gaps, tfs = (np.array([1, 2, 4])[np.searchsorted([1 << 8, 1 << 16], np.maximum.reduceat(x, first), "right")] for x in (gap, tf))
    size = 2 + count * (gaps + tfs)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    middle = begin + 1 + count * gaps
    out[begin], out[middle] = gaps, tfs
    within = np.arange(n) - first[block]
    _packed(gap, gaps[block], begin[block] + 1 + within * gaps[block], out)
    _packed(tf, tfs[block], middle[block] + 1 + within * tfs[block], out)
    # Impacts: by falling frequency, then rising length, those shorter than all before them in the block.
    order = np.lexsort((length, -tf, block))
    falling = length[order] - (block[order] << 32)  # lower in every later block, so one running minimum serves all
    keep = order[falling < np.append(np.iinfo(np.int64).max, np.minimum.accumulate(falling)[:-1])]
    n_impacts = np.bincount(block[keep], minlength=len(first))
    pairs = np.stack([tf[keep], length[keep]], axis=1).ravel()
    bounds = np.append(np.searchsorted(first, start), len(first))  # blocks of each term
    offsets = lambda per_block: np.append(0, np.cumsum(per_block))[bounds].astype(np.int32)
    listed = lambda values, kind, at=bounds.astype(np.int32): pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
    data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets(size).tobytes()), pa.py_buffer(out.tobytes())])
    return term[start], {"df": pa.array(np.diff(np.append(start, n)), pa.int32()), "last": listed(place[first + count - 1], pa.int32()),
                         "size": listed(size, pa.int32()), "impacts": listed(pairs, pa.int64(), offsets(2 * n_impacts)),
                         "n_impacts": listed(n_impacts, pa.int32()), "data": data}


class _Shard:
    """Documents gathered by one task until they fill a shard."""

    def __init__(self, name: str):
        self.name, self.ids, self.vocabulary, self.tokens, self.lengths = name, [], {}, [], []
        self.n_terms = 0

    def add(self, id, data: bytes) -> None:
        found, known = terms(data), self.vocabulary
        self.ids.append(id)
        self.lengths.append(len(found))
        self.tokens.append(np.fromiter((known.setdefault(t, len(known)) for t in found), np.int64, len(found)))
        self.n_terms += len(found)

    def rows(self) -> dict[str, pa.Array]:
        """The columns of the term rows."""
        lengths = np.array(self.lengths, np.int64)
        key = np.concatenate(self.tokens) << 32 | np.repeat(np.arange(len(lengths)), lengths)
        key, tf = np.unique(key, return_counts=True)
        place = key & 0xFFFFFFFF
        numbers, columns = term_rows(key >> 32, place, tf, lengths[place])
        names = pa.array(list(self.vocabulary), pa.binary()).take(pa.array(numbers))
        return {"shard": pa.array([self.name] * len(names)), "term": names} | columns


def build(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, DataFrame]:
    """(postings, shards): the index's term rows and (shard, ids, lengths) of the shards' documents.

    Both lie in one table that is written once: a shard's documents are the row without a term."""
    kind = docs.schema[id].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{_SCHEMA}, ids array<{kind}>, lengths array<int>")
    arrow = to_arrow_schema(schema)

    def batch(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches):
        import uuid  # a name per shard, new if a task is run again

        def close(shard):
            rows = shard.rows()
            whole = batch(rows, len(rows["term"]))
            yield from (whole.slice(k, 10_000) for k in range(0, len(rows["term"]), 10_000))
            yield batch({"shard": [shard.name], "ids": [shard.ids], "lengths": [shard.lengths]}, 1)
        shard = _Shard(uuid.uuid4().hex)
        for b in batches:
            for i, data in zip(b.column(0), b.column(1)):
                raw = data.as_py()
                if not _TERM.search(raw):
                    continue
                shard.add(i.as_py(), raw)
                if len(shard.ids) >= shard_docs or shard.n_terms >= SHARD_TERMS:
                    yield from close(shard)
                    shard = _Shard(uuid.uuid4().hex)
        if shard.ids:
            yield from close(shard)
    rows = docs.select(F.col(id).alias("id"), utf8(text).alias("t")).mapInArrow(run, schema)
    index = stored(rows, "index")
    postings = index.where("term is not null").drop("ids", "lengths")
    return postings, index.where("term is null").select("shard", "ids", "lengths")


class _List:
    """A term's postings in one shard with the scores of its blocks."""

    def __init__(self, row: dict, weight: int, norm):
        self.last = np.array(row["last"], np.int64)
        ends = np.cumsum(row["size"])
        self.begin, self.data = ends - row["size"], memoryview(row["data"])
        pairs = np.array(row["impacts"], np.int64).reshape(-1, 2)
        of = np.repeat(np.arange(len(self.last)), row["n_impacts"])
        self.weight, self.df, self.norm = weight, row["df"], norm
        self.block_max = np.zeros(len(self.last), np.int64)
        np.maximum.at(self.block_max, of, self.score(pairs[:, 0], norm(pairs[:, 1])))
        self.open: dict[int, tuple] = {}
        self.unpacked = 0

    def score(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, frequencies) of a block, unpacked once."""
        if k not in self.open:
            count = min(BLOCK, self.df - k * BLOCK)
            gaps, at = unpack(self.data, int(self.begin[k]), count)
            tf, _ = unpack(self.data, at, count)
            self.open[k] = np.cumsum(gaps + 1) + (int(self.last[k - 1]) if k else -1), tf
            self.unpacked += 1
        return self.open[k]

    def between(self, a: int, b: int) -> tuple[int, int]:
        """The blocks that may hold places from a to b - 1."""
        first = int(np.searchsorted(self.last, a))
        return first, min(int(np.searchsorted(self.last, b - 1)) + 1, len(self.last))


def search_shard(lists: dict[int, _List], queries: list[dict[int, int]], m: np.ndarray, rank: np.ndarray, k: int):
    """Per query the (score, place) of its ``k`` best documents. ``queries``: times of each term; ``m``: the documents'
    length norms; ``rank``: the documents' order among equal scores."""
    n = len(m)
    for query in queries:
        own = [(times, lists[t]) for t, times in query.items() if t in lists]
        heap_score, heap_place = np.empty(0, np.int64), np.empty(0, np.int64)
        least = 1  # scores below cannot enter
        for a in range(0, n if own else 0, WINDOW):
            b = min(n, a + WINDOW)
            there = []
            for times, x in own:
                first, stop = x.between(a, b)
                if first < stop:
                    there.append((times * int(x.block_max[first:stop].max()), times, x, first, stop))
            there.sort(key=lambda e: e[0])
            bounds = np.cumsum([e[0] for e in there])
            split = int(np.searchsorted(bounds, least))  # lists before it cannot reach the heap by themselves
            if split == len(there):
                continue
            total = np.zeros(b - a, np.int64)
            for _, times, x, first, stop in there[split:]:
                for j in range(first, stop):
                    places, tf = x.block(j)
                    inside = (places >= a) & (places < b)
                    p = places[inside]
                    total[p - a] += times * x.score(tf[inside], m[p])
            can = np.flatnonzero(total)
            for e in range(split - 1, -1, -1):
                _, times, x, first, stop = there[e]
                rest = int(bounds[e - 1]) if e else 0
                can = can[total[can] + bounds[e] >= least]
                if not len(can):
                    break
                of = np.searchsorted(x.last, can + a)
                maxima = np.append(x.block_max, 0)[of] * times
                ask = total[can] + maxima + rest >= least
                # A rejected document keeps its score so far, which stays below the heap's least.
                can, of = can[ask], of[ask]
                for j in np.unique(of[of < stop]).tolist():
                    places, tf = x.block(j)
                    mine = can[of == j] + a
                    at = np.searchsorted(places, mine)
                    hit = (at < len(places)) & (places[np.minimum(at, len(places) - 1)] == mine)
                    p = mine[hit]
                    total[p - a] += times * x.score(tf[at[hit]], m[p])
            can = can[total[can] >= least]
            if len(can):
                heap_score, heap_place = np.append(heap_score, total[can]), np.append(heap_place, can + a)
                best = np.lexsort((rank[heap_place], -heap_score))[:k]
                heap_score, heap_place = heap_score[best], heap_place[best]
                if len(best) == k:
                    least = max(1, int(heap_score[-1]))
        yield heap_score, heap_place


def top_documents(postings: DataFrame, shards: DataFrame, queries: DataFrame, query_id: str = "item_id", text: str = "text",
                  k: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` best documents of each query."""
    spark = postings.sparkSession
    wanted = stored(queries.select(F.col(query_id).alias("query_id"), utf8(text).alias("t")).withColumn("query", F.monotonically_increasing_id()), "queries")
    stats = shards.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("l"))
    n_docs, n_terms = stats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    id_kind, query_kind = shards.schema["ids"].dataType.elementType.simpleString(), wanted.schema["query_id"].dataType.simpleString()
    schema = f"query bigint, query_id {query_kind}, id {id_kind}, score bigint"
    out = spark.createDataFrame([], schema)
    it, block, found = wanted.toLocalIterator(), [], []
    for row in it:
        block.append((row["query"], row["query_id"], Counter(terms(bytes(row["t"])))))
        if len(block) == query_block:
            found.append(_heaps(postings, shards, block, n_docs, n_terms, schema, k))
            block = []
    if block:
        found.append(_heaps(postings, shards, block, n_docs, n_terms, schema, k))
    for f in found:
        out = out.unionByName(f)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))


def _heaps(postings: DataFrame, shards: DataFrame, block: list[tuple], n_docs: int, n_terms: int, schema: str, k: int) -> DataFrame:
    """Every shard's best documents for a block of queries."""
    vocabulary = sorted({t for _, _, q in block for t in q})
    spark = postings.sparkSession
    known = spark.createDataFrame([(i, t) for i, t in enumerate(vocabulary)], "number int, term binary")
    mine = postings.join(F.broadcast(known), "term")  # bounded by the block of queries
    df = {r["number"]: r["df"] for r in mine.groupBy("number").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    number = {t: i for i, t in enumerate(vocabulary)}
    queries = [{number[t]: c for t, c in q.items()} for _, _, q in block]
    keys = [(q, i) for q, i, _ in block]
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(lists: pa.Table, docs: pa.Table) -> pa.Table:
        columns: dict[str, list] = {f.name: [] for f in arrow}
        if docs.num_rows and lists.num_rows:
            ids = docs.column("ids")[0].as_py()
            lengths = np.array(docs.column("lengths")[0].as_py(), np.int64)
            norm = lambda n: 75 + (25 * n * n_docs) // n_terms
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
            own = {r["number"]: _List(r, weight[r["number"]], norm) for r in lists.to_pylist()}
            for (q, query_id), (score, place) in zip(keys, search_shard(own, queries, norm(lengths), rank, k)):
                columns["query"] += [q] * len(score)
                columns["query_id"] += [query_id] * len(score)
                columns["id"] += [ids[p] for p in place.tolist()]
                columns["score"] += score.tolist()
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in arrow}, schema=arrow)
    docs = shards.select(F.col("shard").alias("of"), "ids", "lengths")
    return mine.drop("term").groupBy("shard").cogroup(docs.groupBy("of")).applyInArrow(run, schema)
