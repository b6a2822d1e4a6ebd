import re

from pyspark.sql import functions as F

from helpers import A, B, docs
from strata.llm.postings import Index, contamination, proximity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def items(spark, *texts):
    return spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "item_id string, text string")


def brute(doc, benchmark, window=13):
    words, hit, found = WORD.findall((doc or "").lower()), set(), set()
    for k, t in enumerate(benchmark):
        item = WORD.findall((t or "").lower())
        n = min(window, len(item))
        for s in range(len(item) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == item[s:s + n]:
                    hit |= set(range(at, at + n))
                    found.add(f"i{k}")
    return len(words), len(hit), sorted(found)


def test_contamination(spark):
    bench = [A, "short item", "one", None, "", "the the the the the the the the the the the the the the", A]
    a = A.split()
    texts = [A, A.upper().replace(" ", " -- "), " ".join(a[3:17]), " ".join(a[3:15]), None, "", B, f"{B} short, item {B}", "ONE two", "the " * 20,
             " ".join(a[:13]) + " x " + " ".join(a[4:]), "absent words only"]
    frame = docs(spark, *texts).withColumn("row", F.lit(1)).withColumn("item_id", F.lit(2))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(frame, items(spark, *bench)).collect()}
    assert got == {i: brute(t, bench) for i, t in enumerate(texts)}


def test_empty_and_repeated(spark):
    assert contamination(docs(spark), items(spark, A)).count() == 0
    rows = contamination(docs(spark, A, A, ids=[1, None]), items(spark)).collect()
    assert [(r["n_hit"], r["items"]) for r in rows] == [(0, [])] * 2
    assert [r["n_hit"] for r in contamination(docs(spark, A, A, ids=[1, 1]), items(spark, A)).collect()] == [len(A.split())] * 2


def test_proximity(spark):
    texts = ["alpha x beta y gamma", "gamma beta alpha", "alpha beta x x x x x x gamma", "alpha beta"]
    found = proximity(Index(docs(spark, *texts), items(spark, "alpha beta gamma")), 5)
    assert found.count() == 2
