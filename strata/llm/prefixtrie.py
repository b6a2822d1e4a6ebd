"""Product quantisation of vectors, assigned over a lexicographic trie of distinct parts.

Components become integers (floor of ``scale`` times the value) and each vector is cut into ``parts``
equal parts. Every part position has a codebook, which starts as the parts of the ``entries`` vectors
of least id; each round assigns all parts to their nearest entry and replaces an entry by the floored
mean of its parts.

Assignment. Within an Arrow slice the parts of one position are reduced to distinct ones with their
weights and put in lexicographic order, so that they are the leaves of a trie, one level a dimension. A node holds
the vector of accumulated squared distances between its prefix and the prefixes of all entries. The
depth-first order of the leaves is the sorted order: it is walked in steps of ``STEP`` leaves, the nodes
of a step are computed level by level from those of their parents, each once however many leaves share
it, and the open path is carried into the next step. At the leaves the argmin (the lowest index on ties)
gives code and error, and weighted sums of components go to the codebook's update.

Scale. A round shuffles one row per task, position and entry (sums and counts); only the
``parts * entries`` sums reach the driver, and the codebooks go out with the tasks. Vectors are never
shuffled; errors are summed by label with map-side combining and joined back by Spark's own choice.

Edge cases: vectors that are null, empty or hold null or non-finite components go, and so do those whose length
is not that of the first remaining vector (least id, then vector) or no multiple of ``parts``; with fewer than
``entries`` vectors, codebooks have as many entries; repeated rows count each; null ids rank last; null labels are one
label; an empty table gives an empty table; columns other than id, vector and label are not taken.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.common import map_arrow, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
STEP = 2048  # leaves walked at a time: STEP x ENTRIES distances a level


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers; null if the vector is null or has a null or non-finite component."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(wide, lambda x: F.floor(x * scale)))


def assign(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of parts in lexicographic order (rows may repeat)."""
    n, dims = leaves.shape
    code, error = np.empty(n, np.int64), np.empty(n, np.int64)
    path: list[np.ndarray] = []  # accumulated vectors of the open path, one a level
    for at in range(0, n, STEP):
        step = leaves[at:at + STEP]
        # The level at which each leaf leaves the path of the one before.
        before = np.vstack([leaves[at - 1:at] if at else step[:1], step[:-1]])
        other = step != before
        depth = np.where(other.any(axis=1), other.argmax(axis=1), dims)
        if not at:
            depth[0] = 0
        above, of_above = np.zeros((1, len(book)), np.int64), np.zeros(len(step), np.int64)
        open_path = []
        for d in range(dims):
            new = depth <= d
            node = np.cumsum(new)  # 0 is the node carried over from the step before
            grown = above[of_above[new]] + (step[new, d][:, None] - book[None, :, d]) ** 2
            carried = path[d][None] if path else np.zeros((1, len(book)), np.int64)
            above, of_above = np.vstack([carried, grown]), node
            open_path.append(above[node[-1]])
        path = open_path
        best = above.argmin(axis=1)
        code[at:at + STEP] = best[of_above]
        error[at:at + STEP] = above[np.arange(len(above)), best][of_above]
    return code, error


def _slices(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1, dims)


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct parts in lexicographic order, leaf of each part, weight of each leaf)."""
    order = np.lexsort(parts.T[::-1])
    there = parts[order]
    new = np.concatenate([[True], (there[1:] != there[:-1]).any(axis=1)])
    leaf = np.empty(len(parts), np.int64)
    leaf[order] = np.cumsum(new) - 1
    return there[new], leaf, np.bincount(leaf)


def start(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks (part, entry, dimension) of the ``entries`` vectors with the least ids."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)


def improve(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of their parts; unused ones stay."""
    parts, entries, dims = books.shape

    def run(batch: pa.RecordBatch):
        cut = _slices(batch, dims)
        out: dict[str, list] = {k: [] for k in ("part", "entry", "n", "sums")}
        for p in range(parts):
            leaves, _, weight = _distinct(cut[:, p])
            code, _ = assign(leaves, books[p])
            n = np.zeros(entries, np.int64)
            sums = np.zeros((entries, dims), np.int64)
            np.add.at(n, code, weight)
            np.add.at(sums, code, leaves * weight[:, None])
            used = np.flatnonzero(n)
            out["part"] += [p] * len(used)
            out["entry"] += used.tolist()
            out["n"] += n[used].tolist()
            out["sums"] += sums[used].tolist()
        yield out
    rows = map_arrow(vectors.select("v"), run, "part int, entry int, n bigint, sums array<bigint>", rows=8192)
    total = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)])
    out = books.copy()
    for r in total.collect():  # at most parts x entries rows
        out[r["part"], r["entry"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return out


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vectors`` without v, with ``code`` (an entry per part) and ``error``."""
    parts, _, dims = books.shape
    kept = [f for f in vectors.schema.fields if f.name != "v"]

    def run(batch: pa.RecordBatch):
        cut = _slices(batch, dims)
        codes, errors = np.empty((batch.num_rows, parts), np.int32), np.zeros(batch.num_rows, np.int64)
        for p in range(parts):
            leaves, leaf, _ = _distinct(cut[:, p])
            code, error = assign(leaves, books[p])
            codes[:, p] = code[leaf]
            errors += error[leaf]
        yield {f.name: batch.column(f.name) for f in kept} | {"code": list(codes), "error": errors}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "code array<int>", "error bigint"])
    return map_arrow(vectors, run, schema, rows=8192)


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error), codebooks). ``code`` has an entry per part."""
    whole = df.select(F.col(id).alias("id"), F.col(label).alias("label"), integers(F.col(vector), scale).alias("v")).where("v is not null and size(v) > 0")
    whole = stored(whole.where(F.size("v") % parts == 0), "vectors")
    first = whole.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    if first:
        whole = whole.where(F.size("v") == first[0])
    books = start(whole, parts, entries)
    if books is None:
        books = np.zeros((parts, 1, 1), np.int64)
    else:
        for _ in range(rounds):
            books = improve(whole, books)
    coded = stored(encode(whole, books), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and dimension, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def as_hex(code: Column) -> Column:
    """Two lowercase hex digits a part."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
