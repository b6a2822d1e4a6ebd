import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import docs
from strata.llm.slots import fill, lookup, place


def brute(names, size):
    """Each shard's whole preference list first, then the turns."""
    number = lambda s, use: int.from_bytes(hashlib.md5(f"{use}:{s}".encode()).digest()[:8], "big")
    wish = {s: [(number(s, "offset") % size + j * (number(s, "skip") % (size - 1) + 1)) % size for j in range(size)] for s in names}
    owner = {}
    while True:
        for s in sorted(names):
            owner[next(x for x in wish[s] if x not in owner)] = s
            if len(owner) == size:
                return [owner[x] for x in range(size)]


def test_fill():
    names = [f"s{i}" for i in range(7)]
    assert fill(names, 101) == brute(names, 101)
    whole = fill(names)
    assert max(map(whole.count, names)) - min(map(whole.count, names)) <= 1
    fewer = fill(names[:-1])
    moved = sum(a != b for a, b in zip(whole, fewer) if a != "s6")
    assert moved < 0.1 * len(whole)
    assert fill({"a": 3, "b": 1}, 101).count("a") > 70
    for wrong in ([], ["a"] * 1), 100:
        with pytest.raises(ValueError):
            fill(["a"], 100) if wrong == 100 else fill([], 101)


def test_place(spark):
    table = lookup(spark, ["x", "y"], 101)
    rows = place(docs(spark, *"abca", ids=[5, None, 7, 5]).withColumn("shard", F.lit(1)), "doc_id", table, 101).collect()
    owner = fill(["x", "y"], 101)
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["_shard"] == owner[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101]
    assert place(docs(spark), "doc_id", table, 101).count() == 0
    hot = docs(spark, *map(str, range(50)), ids=[1] * 50)
    assert place(hot, "doc_id", table, 101).select("shard").distinct().count() == 1
    assert place(hot, "doc_id", table, 101, spread=["text"]).select("shard").distinct().count() == 2


def test_clashing_columns(spark):
    df = docs(spark, "a", "b").withColumns({"_at": F.lit("x"), "slot": F.lit("y"), "Shard": F.lit("z")})
    got = place(df, "doc_id", lookup(spark, ["s", "t"], 101), 101)
    assert set(df.columns) < set(got.columns) and {tuple(r) for r in got.select("_at", "slot", "Shard").collect()} == {("x", "y", "z")} and got.count() == 2
