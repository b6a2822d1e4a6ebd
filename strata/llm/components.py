"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge with the smallest node that it can reach.

    Each round links every node's larger neighbours to its smallest one, then the smaller ones
    (itself included) too. Each half of a round reads its edges several times, so what it reads is checkpointed:
    no plan holds another's, and the driver plans the same few joins in every round, whatever made ``edges``.
    Nothing is collected but two sums, and the number of edges never grows. Nulls, loops and repeated edges are
    ignored.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours go to the smallest of the node and its neighbours.
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .distinct())
        # Smaller neighbours and the node itself go to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links = materialise(small)
        found = links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.max("u")).first()
        if state == tuple(found):
            break
        state = tuple(found)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
