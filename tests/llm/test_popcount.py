import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import A, B, components, docs
from strata.llm.popcount import _signed, links, near_duplicates, simhash


def plain_simhash(text, k=4):
    w = text.encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [512, 3])
def test_links_keep_components(spark, limit):
    """With a small limit nearly all cells are crowded, and the midpoints must find what pairs do."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    near = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in base for _ in range(12)}
    chain = [base[0] ^ ((1 << 3 * k) - 1) for k in range(10)]
    prints = sorted(_signed(x) for x in {*near, *base, *chain})
    far = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    got = [(r["a"], r["b"]) for r in links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), limit).collect()]
    assert all(far(a, b) <= 4 for a, b in got)
    pairs = set(got)
    assert components(prints, lambda a, b: (a, b) in pairs) == components(prints, lambda a, b: far(a, b) <= 4)


def test_repeated_points_are_not_broadcast(spark):
    """Points are repeated 35 times for their cells and 2,081 times for their midpoints, which Spark's sizes do not count."""
    plan = links(spark.range(1000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin) \[.*?\], (\w+)", plan)
    assert joins.count(("SortMergeJoin", "Inner")) == 2
    assert {how for name, how in joins if name != "SortMergeJoin"} <= {"LeftAnti", "LeftSemi"}  # by the list of crowded cells


def test_near_duplicates(spark):
    texts = [A, A.upper(), B, None, "", " \n", "one two", A + " x", B, "w " * 90_000]
    ids = [4, 2, 9, None, 7, 8, 6, 3, 9, 5]
    frame = docs(spark, *texts, ids=ids).withColumn("fp", F.lit("clash"))
    got = sorted(((r["id"] is None, r["id"], r["fp"], r["component"]) for r in near_duplicates(frame).collect()), key=repr)
    fps = [simhash((t or "").encode(), 4) for t in texts]
    assert fps[:9] == [plain_simhash(t or "") for t in texts[:9]]
    of = components([*range(10)], lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    least = {n: min(i for i, r in zip(ids, of) if of[r] == of[n] and i is not None) for n in of}
    assert got == sorted(((i is None, i, _signed(f), least[n]) for n, (i, f) in enumerate(zip(ids, fps))), key=repr)
    assert near_duplicates(docs(spark)).count() == 0
