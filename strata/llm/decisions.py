"""Quality rules as a learned decision list.

Texts are measured whole: counts of words, characters, signs, repeated lines and windows, and shares
of them. A decision list is an ordered list of conjunctions of thresholds, such as ``symbol_share >
0.031 and n_words > 12``; the first one that holds rejects the text, and what none rejects is kept.

Sequential covering learns it from labelled rows: a rule grows on two thirds of the rows by adding
the threshold that gains most information about rejection, until no kept row is covered; it is
pruned from its end while that does not make it worse on the other third; it joins the list if it is
right there often enough, and the rows that it covers leave. Then the next rule is learnt from what
remains. The list becomes one Spark CASE expression.

The fit uses every labelled row. Spark counts them by feature and value (to ``1 << (52 - DROPPED)`` steps within a power of two,
with the least and greatest value of each step), which gives at most ``CUTS`` thresholds a feature; then each condition of a rule is
found in one count of rows by feature and threshold. The driver holds these counts, whose number does not depend on that of the
rows. A hash of a row's id decides whether it grows or prunes rules. Every row is measured and judged.

Edge cases: null and empty texts have no words; texts without words fail the base rules and go;
null labels do not count; without labels of both kinds the list is empty and only the base rules
decide; repeated rows get equal verdicts; an empty table gives an empty table; columns of the input
that are named like a measure are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.common import fresh, map_arrow
from strata.session import written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_capitals", "n_marks", "n_same_next", "n_lines", "n_distinct")
CUTS = 64
DROPPED = 42  # last bits of a value that do not part steps
LEAST_RIGHT = 0.9  # of the rows a rule covers when pruned
LEAST_COVERED = 3
SYMBOLS = b"#*$%&|<>"
_CAPITALS, _MARKS = bytes(range(65, 91)), b"!?"


def measure(data: bytes) -> tuple[int, ...]:
    """COUNTS and MORE of a text in UTF-8."""
    words = data.split()
    n = len(words)
    signs = len(data) - len(data.translate(None, SYMBOLS))
    # Every byte of a character but the first has the form 10xxxxxx; white space is never part of a word.
    chars = len(b"".join(words).translate(None, bytes(range(0x80, 0xC0))))
    seen: set[bytes] = set()
    repeats = lines = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            repeats += line in seen
            seen.add(line)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    again = 0
    if n > 3:
        # A pair's number is below the square of the words' count, a window's below its cube: in two steps.
        _, pair = np.unique(codes[:-1] * len(known) + codes[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(known) + codes[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[window] > 1)
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[at + k] = True
        again = int(hit.sum())
    same = int((codes[1:] == codes[:-1]).sum()) if n > 1 else 0
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    marks = len(data) - len(data.translate(None, _MARKS))
    return n, chars, signs, repeats, again, capitals, marks, same, lines, len(known)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns COUNTS and MORE (long)."""
    added = (*COUNTS, *MORE)
    kept = [f for f in df.schema.fields if f.name.lower() not in added]
    own, = fresh(df, "_measured")

    def run(batch: pa.RecordBatch):
        rows = [measure(t) for t in batch.column(own).to_pylist()]
        yield {f.name: batch.column(f.name) for f in kept} | dict(zip(added, map(list, zip(*rows))))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{a} bigint" for a in added)])
    bytes_ = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias(own)
    return map_arrow(df.select(*[f"`{f.name}`" for f in kept], bytes_), run, schema)


def features() -> dict[str, Column]:
    """The columns that thresholds are set on, as expressions of the measures."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"),
            "symbol_share": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"), "capital_share": per("n_capitals", "word_chars"),
            "mark_share": per("n_marks", "n_words"), "same_next_share": per("n_same_next", "n_words"),
            "distinct_share": per("n_distinct", "n_words"), "words_per_line": per("n_words", "n_lines")}


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat_words) > 50 * F.col(n_words))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.cut if self.above else x <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects."""
    rules: list[list[Condition]]

    def expression(self) -> Column:
        """Number of the rule that rejects a row, from 1 on; null for rows that stay."""
        columns, out = features(), F.lit(None).cast("int")
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            met = F.lit(True)
            for c in rule:
                met = met & (columns[c.feature] > c.cut if c.above else columns[c.feature] <= c.cut)
            out = F.when(met, F.lit(n)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def _covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def _steps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step, rows, least, greatest value) of values that are not negative."""
    v = np.sort(values)
    step, first, n = np.unique(v.view(np.int64) >> DROPPED, return_index=True, return_counts=True)
    return step, n, v[first], v[first + n - 1]


def _cuts(n: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """At most CUTS thresholds halfway between neighbouring steps, spread evenly over the rows."""
    middle = (greatest[:-1] + least[1:]) / 2
    if len(middle) > CUTS:
        place = np.linspace(0, n.sum() - 1, CUTS)
        middle = np.unique(middle[np.searchsorted(np.cumsum(n), place, side="right").clip(0, len(middle) - 1)])
    return middle


# Rows and rows to reject by the number of cuts below their value, of each feature.
Spread = dict[str, tuple[np.ndarray, np.ndarray]]


def _grow(cuts: dict[str, np.ndarray], spread: Callable[[list[Condition]], Spread]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < 5:
        inside = spread(rule)
        n0, p0 = (int(c.sum()) for c in next(iter(inside.values())))
        if p0 == n0:
            break
        best, gain = None, 1e-9
        for f, edges in cuts.items():
            n_below, p_below = (np.cumsum(c)[:-1] for c in inside[f])
            for above in (True, False):
                p, n = (p0 - p_below, n0 - n_below) if above else (p_below, n_below)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - np.log2(p0 / n0)), -1)
                k = int(g.argmax()) if len(g) else -1
                if k >= 0 and g[k] > gain:
                    best, gain = Condition(f, above, float(edges[k])), g[k]
        if best is None:
            break
        rule.append(best)
    return rule


def _cover(cuts: dict[str, np.ndarray], spread: Callable[[list[list[Condition]], list[Condition]], Spread],
           held: Callable[[list[list[Condition]], list[list[Condition]]], list[tuple[int, int]]], most_rules: int = 12) -> DecisionList:
    """Sequential covering. Of the rows that no rule of a list covers, ``spread`` gives those growing rules that a
    further rule covers, ``held`` the number of those pruning that each of some rules covers and of rows to reject among them."""
    rules: list[list[Condition]] = []
    while cuts and len(rules) < most_rules:
        start = spread(rules, [])
        n, p = (int(c.sum()) for c in next(iter(start.values())))
        (n_held, p_held), = held(rules, [[]])
        if not p or not p_held or p + p_held == n + n_held:
            break
        rule = _grow(cuts, lambda r: spread(rules, r) if r else start)
        if not rule:
            break
        covered = held(rules, [rule[:k] for k in range(1, len(rule) + 1)])
        worth = [(2 * p - n) / max(1, n) for n, p in covered]
        while len(rule) > 1 and worth[len(rule) - 2] >= worth[len(rule) - 1]:
            rule = rule[:-1]
        n, p = covered[len(rule) - 1]
        if n < LEAST_COVERED or p < LEAST_RIGHT * n:
            break
        rules.append(rule)
    return DecisionList(rules)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 1, most_rules: int = 12) -> DecisionList:
    """Sequential covering of rows at hand; ``bad`` marks the rows to reject."""
    cuts = {f: _cuts(*_steps(v)[1:]) for f, v in x.items()}
    bins = {f: np.searchsorted(cuts[f], v, side="left") for f, v in x.items()}
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3

    def left(rules):
        out = np.ones(len(bad), bool)
        for r in rules:
            out &= ~_covered(r, x, len(bad))
        return out

    def spread(rules, rule):
        at = left(rules) & part & _covered(rule, x, len(bad))
        return {f: tuple(np.bincount(b[rows], minlength=len(cuts[f]) + 1) for rows in (at, at & bad)) for f, b in bins.items()}

    def held(rules, some):
        at = left(rules) & ~part
        found = [at & _covered(r, x, len(bad)) for r in some]
        return [(int(c.sum()), int((c & bad).sum())) for c in found]
    return _cover(cuts, spread, held, most_rules)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DecisionList:
    """A list from all labelled rows; ``label`` 0 marks rows to reject. Rows that the base rules reject teach
    nothing new and are left out. Measures, not texts, meet the labels."""
    names = list(features())
    known = (labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("id is not null and label is not null")
             .groupBy("id").agg(F.max("label").alias("label")))
    measured = measures(docs.select(F.col(id).alias("id"), F.col(text).alias("text"))).where(~base_failed())
    measured = measured.select("id", *[c.alias(n) for n, c in features().items()])
    rows = written(measured.join(known, "id").select(*names, (F.col("label") == 0).alias("bad"),
                                                     (F.pmod(F.xxhash64("id", F.lit("grow")), F.lit(3)) < 2).alias("grow")), "labelled")

    def steps(batch: pa.RecordBatch):
        for f, name in enumerate(names):
            step, n, least, greatest = _steps(batch.column(name).to_numpy())
            yield {"f": np.full(len(step), f, np.int32), "step": step, "n": n, "least": least, "greatest": greatest}
    found = (map_arrow(rows.select(*names), steps, "f int, step bigint, n bigint, least double, greatest double", rows=1 << 16)
             .groupBy("f", "step").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")).toArrow())
    if not found.num_rows:
        return DecisionList([])
    found = found.sort_by([("f", "ascending"), ("step", "ascending")])
    f, *of = (found.column(c).to_numpy() for c in ("f", "n", "least", "greatest"))
    cuts = {name: _cuts(*(c[f == k] for c in of)) for k, name in enumerate(names)}

    def place(batch: pa.RecordBatch):
        yield ({n: np.searchsorted(cuts[n], batch.column(n).to_numpy(), side="left").astype(np.int32) for n in names}
               | {n: batch.column(n) for n in ("bad", "grow")})
    placed = written(map_arrow(rows, place, ", ".join([*(f"{n} int" for n in names), "bad boolean, grow boolean"]), rows=1 << 16), "placed")

    def holds(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            at = int(np.searchsorted(cuts[c.feature], c.cut))
            out = out & (F.col(c.feature) > at if c.above else F.col(c.feature) <= at)
        return out

    def left(rules: list[list[Condition]]) -> DataFrame:
        out = placed
        for r in rules:
            out = out.where(~holds(r))
        return out

    def spread(rules, rule):
        inside = left(rules).where(F.col("grow") & holds(rule)).select("bad", F.posexplode(F.array(*names)).alias("f", "bin"))
        out = {n: (np.zeros(len(cuts[n]) + 1, np.int64), np.zeros(len(cuts[n]) + 1, np.int64)) for n in names}
        for r in inside.groupBy("f", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("p")).collect():
            for counts, value in zip(out[names[r["f"]]], (r["n"], r["p"])):
                counts[r["bin"]] = value
        return out

    def held(rules, some):
        sums = [c for r in some for c in (F.count_if(holds(r)), F.count_if(holds(r) & F.col("bad")))]
        row = left(rules).where(~F.col("grow")).agg(*[c.alias(f"c{k}") for k, c in enumerate(sums)]).first()
        return list(zip(row[::2], row[1::2]))
    return _cover(cuts, spread, held)


def judge(measured: DataFrame, rules: DecisionList) -> DataFrame:
    """A measured frame with base_failed, rule (number of the rejecting rule or null) and kept."""
    out = measured.drop("base_failed", "rule", "kept").withColumn("base_failed", base_failed()).withColumn("rule", rules.expression())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
