import hashlib
import math
import random

import numpy as np
from strata.llm.prefixtrie import as_hex, assign, compress, digest
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The same by plain loops over all parts and entries."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if v and None not in v and all(map(math.isfinite, v)) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    dims = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * dims:(p + 1) * dims]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], {}
    for i, v, y in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(b[0] for b in best)
        by_label[y] = by_label.get(y, 0) + error
        out.append((i, "".join(f"{b[1]:02x}" for b in best), error, y))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[y]) for i, c, e, y in out), key=repr), sha


def found(spark, rows):
    coded, books = compress(spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(1)).withColumn("error", F.lit("x")))
    got = sorted(((r["id"], r["hex"], r["error"], r["label_error"]) for r in coded.withColumn("hex", as_hex(F.col("code"))).collect()), key=repr)
    return got, digest(books)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    grid = [-0.5, -0.25, 0.0, 0.1, 0.3]
    rows = [(i, [rng.choice(grid) if i % 2 else rng.uniform(-1, 1) for _ in range(32)], rng.choice([None, 0, 1])) for i in range(150)]
    rows += [rows[3], rows[3], (None, [0.2] * 32, 1)]
    bad = [(200, None, 0), (201, [], 0), (202, [None] + [0.1] * 31, 0), (203, [float("nan")] * 32, 1), (204, [float("inf")] * 32, 1),
           (205, [0.1] * 16, 0), (206, [0.1] * 33, 0)]
    assert found(spark, rows + bad) == brute(rows)


def test_few_and_none(spark):
    rows = [(5, [0.5] * 16, None), (4, [-0.001] * 16, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [])[0] == []


def test_path_is_carried_over_steps():
    rng = np.random.default_rng(1)
    leaves = rng.integers(-3, 3, (7000, 5))
    leaves = leaves[np.lexsort(leaves.T[::-1])]
    book = rng.integers(-3, 3, (9, 5))
    far = ((leaves[:, None] - book[None]) ** 2).sum(axis=2)
    code, error = assign(leaves, book)
    assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
