import collections
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from helpers import A, docs
from strata.llm.decisions import COUNTS, Condition, DecisionList, judge, learn, measure, measures, train
from strata.session import written

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x0b\x1c 中", max_size=80))
def test_measures(text):
    assert measure(text.encode())[:5] == brute(text)


def test_learned_list_separates():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    rules = learn(x, bad).rules
    got = np.zeros(3000, bool)
    for r in rules:
        got |= np.logical_and.reduce([c.holds(x[c.feature]) for c in r])
    assert (got == bad).mean() > 0.97 and 1 < len(rules) <= 12


def test_expression(spark):
    frame = measures(docs(spark, "a " * 60, "a # " * 60, None, "", A * 9, ids=[1, 2, None, 4, 4]))
    rules = DecisionList([[Condition("symbol_share", True, 0.3), Condition("n_words", True, 10)], [Condition("distinct_share", False, 0.05)]])
    rows = {(r["doc_id"], r["n_words"]): r for r in judge(frame, rules).collect()}
    assert rows[2, 120]["rule"] == 1 and rows[1, 60]["rule"] == 2 and not rows[None, 0]["kept"] and rows[None, 0]["base_failed"]
    assert str(rules).splitlines()[0] == "symbol_share > 0.3 and n_words > 10"


def test_train_and_judge(spark):
    good = [f"{A} item {i} " * 1 + " ".join(f"w{i}x{k}" for k in range(60)) for i in range(60)]
    junk = [" ".join(f"v{i}x{k}###" for k in range(80)) for i in range(40)]
    frame = docs(spark, *good, *junk)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 100, 2)] + [(1, None)], "doc_id bigint, quality int")
    rules = train(frame, labels)
    rows = judge(measures(frame.withColumn("n_words", F.lit("clash"))), rules).collect()
    assert all(r["kept"] == (r["doc_id"] < 60) for r in rows)
    assert train(frame, labels.limit(0)).rules == [] and measures(docs(spark)).count() == 0
    assert set(COUNTS) <= set(rows[0].asDict())


def test_clashing_column(spark):
    got = measures(docs(spark, "one two", None).withColumn("_measured", F.lit("x"))).orderBy("doc_id").collect()
    assert [(r["_measured"], r["n_words"]) for r in got] == [("x", 2), ("x", 0)]


def test_every_labelled_row_counts(spark):
    """Texts to reject that are not among the 10,000 labelled ids of least hash."""
    n = F.row_number().over(Window.orderBy(F.xxhash64("doc_id")))
    rows = spark.range(10_600).withColumnRenamed("id", "doc_id").withColumn("poor", (n > 10_000) & (F.col("doc_id") % 2 == 0))
    word = F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("x"))
    words = F.transform(F.sequence(F.lit(1), F.lit(55)), lambda k: F.concat(word, k.cast("string"), F.when(F.col("poor"), "##").otherwise("")))
    frame = written(rows.select("doc_id", F.array_join(words, " ").alias("text"), (~F.col("poor")).cast("int").alias("quality")), "labelled")
    rules = train(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    got = judge(measures(frame), rules).where((F.col("quality") == 1) != F.col("kept")).count()
    assert rules.rules and got == 0
