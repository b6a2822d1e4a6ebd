import random

from helpers import docs
from pyspark.sql import functions as F
from strata.llm.suffixes import Levels, Sampler, remove_repeats


def brute(texts, length):
    """Removed spans of each text by counting every string of the length."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))))
    return out


def check(spark, texts, ids=None, **how):
    length = how.get("length", 400)
    table = docs(spark, *texts, ids=ids).withColumnRenamed("lang", "_ks").withColumnRenamed("source", "kept").withColumn("pos", F.monotonically_increasing_id())
    got = remove_repeats(table.repartition(3), **how).orderBy("pos").collect()
    want = brute([(t or "").encode() for t in texts], length)
    assert [(bytes(r["kept"]), sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"])) for r in got] == want
    return want


def test_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, short = text(120), text(40), text(12)
    texts = [base, base.replace("a", "b", 1), text(30) + passage + text(30), text(20) + passage + text(9) + passage[3:], passage[5:-5],
             None, "", short, text(25) + short + text(25), "ab" * 200, "x" * 300, "x" * 99, "x" * 101, base, base[:100], base[:99], text(300)]
    # Near copies with changes at every distance from each other, so that borders fall everywhere.
    texts += [base[:k] + "#" + base[k + 1:] for k in range(90, 400, 23)]
    texts += [base[:150] + text(5) + base[150:260] + text(7) + base[255:], base[100:201] + "!", "?" + base[100:201], base[100:200]]
    want = check(spark, texts, length=100, gram=40)
    assert sum(w[1] for w in want) > 3000 and any(0 < w[1] < len((t or "").encode()) for t, w in zip(texts, want))


def test_hot_template(spark):
    """A passage just over the length in many different surroundings, and one just under it."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    over, under = text(420), text(398)
    texts = [text(rng.randint(50, 300)) + (over if i % 3 else under) + text(rng.randint(0, 300)) for i in range(60)]
    check(spark, texts)


def test_repeated_rows_null_ids_and_empty(spark):
    t = "".join(random.Random(1).choice("abcdefgh ") for _ in range(900))
    check(spark, [t, t, t[:399], t[100:520] + "zz", "y" * 500], ids=[1, 1, None, None, 2])
    check(spark, ["y" * 500, "z" * 500, t], ids=[None, 3, 3])
    assert remove_repeats(docs(spark)).count() == 0


def test_long_texts(spark):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefghijkl ") for _ in range(300_000))
    u = "".join(rng.choice("abcdefghijkl ") for _ in range(1_200_000))
    got = {r["doc_id"]: r for r in remove_repeats(docs(spark, u + t, t + "end", u[:200_000])).collect()}
    assert [[tuple(s) for s in got[i]["removed"]] for i in range(3)] == [[(0, 200_000), (1_200_000, 1_500_000)], [(0, 300_000)], [(0, 200_000)]]


def test_equal_windows_choose_equal_places():
    rng = random.Random(9)
    shared = bytes(rng.randrange(256) for _ in range(1000))
    a, b = (bytes(rng.randrange(256) for _ in range(n)) + shared for n in (333, 57))
    sampler = Sampler()
    inside = []
    for data, at in ((a, 333), (b, 57)):
        place, h, first, last = sampler.runs(data)
        assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == len(data) - 400
        inside.append({(p - at, x) for p, x, l in zip(place.tolist(), h.tolist(), last.tolist()) if l >= at})
    assert inside[0] == inside[1]


def test_levels_grow_geometrically(spark):
    levels = Levels(spark, 4)
    sizes = []
    for k in range(6):
        batch = spark.range(10).select(F.col("id").alias("head"), (F.col("id") + 5 * k).alias("h"), F.lit(k).cast("bigint").alias("s"))
        met = levels.add(batch)
        sizes.append([w for w, _ in levels.levels])
        assert met.count() == 0
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    again = levels.add(spark.createDataFrame([(3, 3, 9), (3, 8, 1), (4, 4, 0), (7, 700, 1), (7, 700, 1)], "head bigint, h bigint, s bigint"))
    assert sorted((r["head"], r["h"], r["lo"] < r["hi"]) for r in again.collect()) == [(3, 3, True), (3, 8, False), (4, 4, False), (7, 700, False)]
    names = [n for _, n in levels.levels]
    levels.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)
