"""Order, joins and spans: the split forms equal the plain ones, brute force and any layout."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from strata.operators import dedup, joins, ordered
from strata.operators.enclosing import enclosing
from strata.plans import graph as g


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds well over a third of the rows; order values tie."""
    rnd = random.Random(1)
    data = [("hot" if i % 5 < 3 else f"k{i % 7}", rnd.randrange(60), i, rnd.choice([None, 1, -1, 2])) for i in range(600)]
    return spark.createDataFrame(data, "k string, o int, i int, v int")


@pytest.mark.parametrize("op", [
    lambda d, n: ordered.number_rows(d, ["k"], ["o", "i"], "x", n),
    lambda d, n: ordered.running_sum(d, ["k"], ["o", "i"], F.coalesce("v", F.lit(0)), "x", n),
    lambda d, n: ordered.carry_forward(d, ["k"], ["o", "i"], "v", "x", n)])
def test_split_groups_equal_whole_groups(skewed, op):
    assert rows(op(skewed, 40), "i", "x") == rows(op(skewed, 10**6), "i", "x")


def test_equal_rows_get_distinct_numbers_when_split(spark):
    d = spark.createDataFrame([("a", 1)] * 50, "k string, o int")
    got = ordered.number_rows(d, ["k"], ["o"], "x", 10)
    assert sorted(r["x"] for r in got.collect()) == list(range(1, 51))


def test_skew_join_equals_join(spark, skewed):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, w int")
    left = skewed.withColumn("k", F.when(F.col("i") % 50 != 0, F.col("k")))
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert rows(joins.skew_join(left, right, "k", how, limit=20), "i") == rows(left.join(right, "k", how), "i")


def test_enclosing_equals_brute_force(spark):
    rnd = random.Random(2)
    spans, points = [], []
    def nest(f, a, b, depth):
        spans.append((f, a, b, f"{f}:{a}-{b}-{depth}"))
        if b - a > 8 and depth < 5:
            mid = rnd.randrange(a + 2, b - 3)
            nest(f, a + 1, mid, depth + 1)
            nest(f, mid + 2, b - 1, depth + 1)
    for f in ("x", "y"):
        nest(f, 0, 120, 0)
    points = [(f, rnd.randrange(-5, 130), i) for i, f in enumerate(["x", "y"] * 80)]
    def best(f, p):
        hit = [(b - a, s) for (g_, a, b, s) in spans if g_ == f and a <= p <= b]
        return min(hit)[1] if hit else None
    want = sorted(((i, best(f, p)) for f, p, i in points), key=repr)
    s = spark.createDataFrame(spans, "f string, a int, b int, sid string")
    p = spark.createDataFrame(points, "f string, p int, pid int")
    for limit in (10**6, 50):
        assert rows(enclosing(p, s, "f", "p", "a", "b", "sid", "pid", limit=limit), "pid", "owner") == want


def test_dedup_is_idempotent_and_layout_free(spark, skewed):
    once = dedup.dedup_last(skewed, "k", ["o", "i"])
    want = rows(once, "k", "i")
    assert rows(dedup.dedup_last(once, "k", ["o", "i"]), "k", "i") == want
    assert rows(dedup.dedup_last(skewed.repartition(7, "i"), "k", ["o", "i"]), "k", "i") == want
    first = {r["k"]: r["i"] for r in dedup.dedup_first(skewed, "k", ["o", "i"]).collect()}
    assert first == {k: min((r["o"], r["i"]) for r in skewed.collect() if r["k"] == k)[1] for k in first}


def test_reach_and_path_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e")],
                              "source_id string, target_id string").withColumn("type", F.lit("CALLS"))
    n = spark.createDataFrame([(x,) for x in "abcde"], "entity_id string").withColumn("kind", F.lit("k"))
    graph = g.Graph(n, e)
    got = rows(g.reach(graph, n.where("entity_id = 'a'"), 9), "node", "hops")
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 3)]
    assert g.shortest_path(graph, "a", "e", 5).collect()[0].path == ["a", "b", "c", "e"]
    assert g.shortest_path(graph, "e", "a", 5).count() == 0
    assert g.shortest_path(graph, "a", "e", 2).count() == 0
    spark.conf.set("strata.group.maxRows", "1")
    try:
        assert rows(g.reach(graph, n.where("entity_id = 'a'"), 9), "node", "hops") == got
    finally:
        spark.conf.unset("strata.group.maxRows")
