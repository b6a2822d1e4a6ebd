import numpy as np
from pyspark.sql import functions as F

from strata.llm.boosting import FEATURES, N_LEXICAL, Boosted, judge, lexical
from strata.llm.queries import URL_RULES


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.3)).astype(float)
    p = Boosted.fit(x[:3000], y[:3000]).predict(x[3000:])
    assert ((p > 0.5) == (y[3000:] > 0.5)).mean() > 0.97
    assert Boosted.fit(x, np.zeros(4000)).predict(x[:2]).max() < 0.01
    assert len(lexical("", "", "")) == N_LEXICAL == len(FEATURES) - 4


def test_judge(spark):
    good = [f"https://site{i % 9}.example.org/en/{i}" for i in range(120)]
    bad = [f"http://free-money-{i}.example.org/en/{i}?a={i}&b=1" for i in range(120)]
    labelled = spark.createDataFrame([(u, 0) for k, u in enumerate(good) if k % 4] + [(u, 1) for k, u in enumerate(bad) if k % 4] + [(None, 1), (good[0], None)], "url string, bad int")
    odd = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "https://a.net/es/1", "ftp://b.net/fr/", "http://c.com",
           "http://notexample.com/en/", "http://user@h.org:80/p", "x://y://z/a"]
    urls = good[::4] + bad[::4] + odd
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("verdict", F.lit("clash")).withColumn("bad", F.lit(9))
    rows = {r["page_id"]: r for r in judge(frame, labelled, URL_RULES).collect()}
    assert all(rows[i]["verdict"] == "allow" for i in range(30)) and all(rows[i]["verdict"] == "block" for i in range(30, 60))
    got = [(rows[60 + i]["host"], rows[60 + i]["path"], rows[60 + i]["rule"]) for i in range(len(odd))]
    assert got == [("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/x", "www.example.com/en/"), ("example.com", "/en/", "example.com/en/"),
                   ("a.net", "/es/1", "net/es/"), ("b.net", "/fr/", "net/fr/"), ("c.com", "", None), ("notexample.com", "/en/", "com/"),
                   ("user@h.org:80", "/p", None), ("y:", "//z/a", None)]
    assert rows[64]["verdict"] == "block" and rows[63]["verdict"] == "allow"
    assert judge(frame.limit(0), labelled, URL_RULES).count() == 0
    assert judge(frame, labelled.limit(0), URL_RULES).where("rule is null and verdict = 'block'").count() == 0
