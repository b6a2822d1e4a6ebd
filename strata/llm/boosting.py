"""URL filter: gradient-boosted trees on lexical features, behind a list of rules.

Rules name a host and the beginning of a path; a rule fits its host and all hosts below it, and the
longest fitting rule decides. Other URLs are judged by boosted regression trees on what can be read
off the URL: lengths, depth, shares of digits and signs, entropy of characters, parameters, and for
the host's last one and last two labels the share of bad ones among the labelled URLs.

Suffix statistics are counted over all labelled URLs in Spark and joined; in training, a URL gets those
of the other folds, so that they don't give its own label away. The trees are fitted on at most ``sample`` labelled URLs (by hash;
20,000 by default), with thresholds at quantiles; every URL is scored.

Edge cases: null and URLs without ``://`` have an empty host and path and are judged by the trees; a
port or a user name stays in the host; without labelled URLs the trees allow everything, and with those of
one kind they say that kind; equal
URLs get equal verdicts; an empty table gives an empty table; columns of the input named like the
results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.common import ascii_lower, map_arrow
from strata.session import written

SAMPLE = 20_000
FEATURES = ("length", "host_length", "path_length", "host_labels", "depth", "digit_share", "host_digit_share", "hyphens",
            "host_hyphens", "sign_share", "entropy", "host_entropy", "parameters", "longest_word", "secure", "extension",
            "fragment", "last_share", "last_count", "two_share", "two_count")
N_LEXICAL = 17
PRIOR = 20.0  # labelled URLs that a suffix's share of bad ones is smoothed with


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host and path) that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str, host: str, path: str) -> list[float]:
    n = len(url) or 1
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url)
    words = re.split(r"[\W_]+", url)
    return [len(url), len(host), len(path), host.count(".") + bool(host), sum(map(bool, path.split("/"))), digits / n,
            sum(c.isdigit() for c in host) / (len(host) or 1), url.count("-"), host.count("-"),
            sum(not c.isalnum() for c in url) / n, _entropy(url), _entropy(host), query.count("&") + bool(query),
            max(map(len, words)), float(url.startswith("https:")), float("." in path.rpartition("/")[2]), float("#" in url)]


@dataclass
class Boosted:
    """Log odds: a start value and trees, each a list of nodes (feature, cut, left, right, value); leaves have
    feature -1, and a row goes left where its value is at most the cut."""
    start: float
    trees: list[list[tuple[int, float, int, int, float]]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32,
            least: int = 10, ridge: float = 1.0):
        share = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(float(np.log(share / (1 - share))), [])
        if not len(y):
            return cls(-20.0, [])
        if y.min() == y.max():
            return model
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)  # bin b: value <= cuts[b]
        odds = np.full(len(y), model.start)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-odds))
            g, h = p - y, p * (1 - p)
            nodes: list = []

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(nodes)
                nodes.append(None)
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, 0)
                if level < depth and len(rows) >= 2 * least:
                    for f, edges in enumerate(cuts):
                        if not len(edges):
                            continue
                        b = binned[rows, f]
                        gl, hl, nl = (np.bincount(b, w, len(edges) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gl ** 2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs ** 2 / (hs + ridge)
                        gain[(nl < least) | (len(rows) - nl < least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], f, k)
                if best[1] < 0:
                    value = float(-rate * gs / (hs + ridge))
                    odds[rows] += value
                    nodes[at] = (-1, 0.0, -1, -1, value)
                else:
                    _, f, k = best
                    left = binned[rows, f] <= k
                    nodes[at] = (f, float(cuts[f][k]), grow(rows[left], level + 1), grow(rows[~left], level + 1), 0.0)
                return at
            grow(np.arange(len(y)), 0)
            model.trees.append(nodes)
        return model

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of being bad."""
        odds = np.full(len(x), self.start)
        for nodes in self.trees:
            def walk(at: int, rows: np.ndarray) -> None:
                f, cut, left, right, value = nodes[at]
                if f < 0:
                    odds[rows] += value
                elif len(rows):
                    low = x[rows, f] <= cut
                    walk(left, rows[low])
                    walk(right, rows[~low])
            walk(0, np.arange(len(x)))
        return 1 / (1 + np.exp(-odds))


def _with_features(df: DataFrame) -> DataFrame:
    """``df`` (url, host, path, share and the suffixes' counts n1, b1, n2, b2) with ``x``."""
    kept = df.schema.fields

    def run(batch: pa.RecordBatch):
        col = {f.name: batch.column(f.name).to_pylist() for f in kept}
        rows = []
        for k, url in enumerate(col["url"]):
            row = lexical(url or "", col["host"][k], col["path"][k])
            for n, b in (("n1", "b1"), ("n2", "b2")):
                count, bad = col[n][k] or 0, col[b][k] or 0
                row += [(bad + PRIOR * col["share"][k]) / (count + PRIOR), math.log1p(count)]
            rows.append(row)
        yield {f.name: batch.column(f.name) for f in kept} | {"x": rows}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "x array<double>"])
    return map_arrow(df, run, schema, rows=2048)


def _suffixes(host: Column) -> tuple[Column, Column]:
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def judge(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id: str = "page_id", url: str = "url",
          sample: int = SAMPLE) -> DataFrame:
    """(id, url, host, path, rule, p_bad, verdict) of every row of ``urls``. ``labelled``: (url, bad 0/1)."""
    def parsed(df: DataFrame, text: str, *more: Column) -> DataFrame:
        one, two = _suffixes(F.col("host"))
        return (df.select(*more, F.col(text).alias("url"), host_of(F.col(text)).alias("host"), path_of(F.col(text)).alias("path"))
                .withColumn("s1", one).withColumn("s2", two))
    known = written(parsed(labelled.where("bad is not null and url is not null"), "url", F.col("bad").cast("int").alias("bad"))
                    .withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(5)).cast("int")), "labelled")
    total = known.agg(F.count(F.lit(1)), F.sum("bad")).first()
    share = ((total[1] or 0) + 0.5) / (total[0] + 1)
    by_fold = [written(known.groupBy(s, "fold").agg(F.count(F.lit(1)).alias(n), F.sum("bad").alias(b)), s)
               for s, n, b in (("s1", "n1", "b1"), ("s2", "n2", "b2"))]
    totals = [d.groupBy(s).agg(F.sum(n).alias(n), F.sum(b).alias(b)) for d, s, n, b in zip(by_fold, ("s1", "s2"), ("n1", "n2"), ("b1", "b2"))]

    def counted(df: DataFrame) -> DataFrame:
        # Few rows a suffix on the right; Spark splits hot suffixes on the left.
        return df.join(totals[0], "s1", "left").join(totals[1], "s2", "left").withColumn("share", F.lit(share))
    chosen = counted(known.orderBy(F.xxhash64("url", "bad"), "url").limit(sample))
    for d, s, n, b in zip(by_fold, ("s1", "s2"), ("n1", "n2"), ("b1", "b2")):
        own = d.withColumnsRenamed({n: "own_n", b: "own_b"})
        chosen = (chosen.join(own, [s, "fold"], "left").withColumns({n: F.col(n) - F.col("own_n"), b: F.col(b) - F.col("own_b")})
                  .drop("own_n", "own_b"))
    rows = _with_features(chosen).select("x", "bad", "url").collect()
    rows.sort(key=lambda r: (r["url"], r["bad"]))
    model = Boosted.fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["bad"] for r in rows], float))
    shared = urls.sparkSession.sparkContext.broadcast(model)
    each = _with_features(counted(parsed(urls, url, F.col(id).alias("id"))))
    kind = urls.schema[id].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, len(FEATURES))
        yield {n: batch.column(n) for n in ("id", "url", "host", "path")} | {"p_bad": shared.value.predict(x).tolist()}
    scored = map_arrow(each.select("id", "url", "host", "path", "x"), run, f"id {kind}, url string, host string, path string, p_bad double", rows=2048)
    verdict_of = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdict_of = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdict_of)
    by_model = F.when(F.col("p_bad") >= 0.5, "block").otherwise("allow")
    return (scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
            .withColumn("verdict", F.coalesce(verdict_of, by_model)).withColumnRenamed("id", id))
