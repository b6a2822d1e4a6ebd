import numpy as np
from pyspark.sql import functions as F

from helpers import A, B, docs
from strata.llm.chain import Linear, best_threshold, predict, train


def labelled(spark, n=300):
    """Texts; every fifth insults, and half of the insulting ones threaten too."""
    texts = [f"{A if i % 2 else B} note{i % 17} thing{i % 23}" + (" utterly moronic" if i % 5 == 0 else "") + (" beware" if i % 10 == 0 else "")
             for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), int(i % 10 == 0)) for i in range(n)], "doc_id bigint, insult int, threat int")
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = labelled(spark)
    frame = docs(spark, *texts)
    chain = train(frame, labels.where("doc_id < 200"), ["insult", "threat"])
    rows = predict(frame, chain).where("doc_id >= 200").collect()
    assert all(r["is_insult"] == (r["doc_id"] % 5 == 0) and r["is_threat"] == (r["doc_id"] % 10 == 0) for r in rows)
    assert len(chain.models[1].weights) == len(chain.models[0].weights) + 1 + len(chain.words[1]) - len(chain.words[0])


def test_edges(spark):
    texts, labels = labelled(spark, 60)
    frame = docs(spark, *texts)
    nulls = labels.withColumn("insult", F.when(F.col("doc_id") % 3 > 0, F.col("insult"))).withColumn("threat", F.lit(0))
    chain = train(frame, nulls.unionByName(nulls), ["insult", "threat"])
    odd = docs(spark, None, "", A, A, "x " * 50_000, ids=[1, None, 2, 2, 3]).withColumn("p_insult", F.lit("clash"))
    rows = predict(odd, chain).collect()
    assert len(rows) == 5 and rows[0]["p_insult"] == rows[1]["p_insult"] and rows[2] == rows[3]
    assert all(0 <= r["p_threat"] < 0.1 for r in rows)  # one class only: its share
    assert predict(docs(spark), chain).count() == 0
    none = train(docs(spark), labels.limit(0), ["insult"])
    assert predict(frame, none).count() == 60


def test_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x @ [2, -1, 0] + 0.5 + rng.logistic(size=2000) > 0).astype(float)
    assert np.allclose(Linear.fit(x, y).weights, [0.5, 2, -1, 0], atol=0.25)
    assert 0.45 < best_threshold(np.array([2.0, 1.0, -1.0, -2.0]), np.array([1.0, 1.0, 0.0, 0.0])) < 0.55
