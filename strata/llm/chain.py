"""Toxicity by a classifier chain of linear models.

Categories are label columns in the order of the chain. The model of a category is a logistic
regression on words and beginnings of words (present or not), on a few shares of the text's characters, and on the log
odds that the models before it give to their categories. In training those are out-of-fold
predictions: each row's comes from models that did not see its fold, so later models learn what
earlier predictions are worth on unseen texts. Words are chosen by how much more often they occur in
texts with the category than chance would have it.

The fit uses at most ``sample`` labelled rows (chosen by hash of their id; 10,000 by default) and
``WORDS`` words a category: both bound what reaches the driver. Every document is scored whole.

Edge cases: null and empty texts have no words and get the probability that the rest of the features
give; null labels do not count; an id with several labels has a category if any says so; a category
with one class only gets its share as constant probability; repeated rows get equal results; an empty
table gives an empty table; columns of ``docs`` stay, those named like the results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import labelled_sample, map_arrow
from strata.session import written

SAMPLE = 10_000
WORDS_KEPT = 200_000
WORDS = 256
STEMS = range(4, 9)
LEAST_TEXTS = 5  # a word in fewer sampled texts is not a feature
FOLDS = 5
RIDGE = 1.0
_WORD = re.compile(r"[^\W\d_]+")
_UPPER, _SIGNS, _DIGITS = (bytes(range(65, 91)), b"#*$%&|<>!?@^~_=+", b"0123456789")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(words) -> set[str]:
    """Distinct words, and beginnings of ``STEMS`` letters with a star behind them."""
    words = set(words)
    return words.union(*({f"{w[:n]}*" for w in words if len(w) >= n} for n in STEMS))


def shares(text: str, words: list[str]) -> list[float]:
    """Length (log), shares of capitals, signs and digits, mean word length (log), share of repeats."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data) or 1
    less = [(len(data) - len(data.translate(None, d))) / n for d in (_UPPER, _SIGNS, _DIGITS)]
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [np.log1p(len(words)) / 5, *less, np.log1p(sum(map(len, words)) / (len(words) or 1)), same / (len(words) or 1)]


N_SHARES = 6


@dataclass
class Linear:
    """Logistic regression: intercept, then weights."""
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 25):
        """Newton's method with a ridge on all but the intercept."""
        x = np.hstack([np.ones((len(x), 1)), x])
        w = np.zeros(x.shape[1])
        if len(y) == 0 or y.min() == y.max():
            w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
            return cls(w)
        ridge = np.full(len(w), RIDGE)
        ridge[0] = 1e-6

        def loss(w):
            z = x @ w
            return np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (w * w)
        best = loss(w)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - y) + ridge * w
            curve = (x * (p * (1 - p))[:, None]).T @ x
            curve[np.diag_indices_from(curve)] += ridge
            step, size = np.linalg.solve(curve, slope), 1.0
            while (new := loss(w - size * step)) > best and size > 1e-4:
                size /= 2
            if best - new < 1e-7 * best:
                break
            w, best = w - size * step, new
        return cls(w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)


@dataclass
class Chain:
    categories: list[str]
    words: list[dict[str, int]] = field(default_factory=list)
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)  # probabilities from which a category holds
    _of_word: dict | None = None

    def terms(self, words: list[str]) -> set[str]:
        """The terms of a text that some model knows; what a word gives is kept, as words recur."""
        if self._of_word is None:
            self._of_word, self._known = {}, set().union(*self.words)
        out: set[str] = set()
        for w in set(words):
            got = self._of_word.get(w)
            if got is None:
                if len(self._of_word) > WORDS_KEPT:
                    self._of_word.clear()
                got = self._of_word[w] = tuple(terms_of([w]) & self._known)
            out.update(got)
        return out

    def inputs(self, k: int, word_sets: list[set], dense: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Features of category ``k``; ``earlier`` has a column of log odds for each category before it."""
        out = np.zeros((len(word_sets), len(self.words[k])))
        for row, found in enumerate(word_sets):
            for w in self.words[k].keys() & found:
                out[row, self.words[k][w]] = 1
        return np.hstack([out, dense, earlier[:, :k] / 4])

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities, a column for each category."""
        words = [words_of(t) for t in texts]
        dense = np.array([shares(t, w) for t, w in zip(texts, words)]).reshape(len(texts), N_SHARES)
        sets, odds = [self.terms(w) for w in words], np.zeros((len(texts), len(self.categories)))
        for k, model in enumerate(self.models):
            odds[:, k] = model.logit(self.inputs(k, sets, dense, odds))
        return 1 / (1 + np.exp(-odds))


def best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Probability at which out-of-fold predictions reach the best F1; between 0.1 and 0.9."""
    order = np.argsort(-odds, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(y) + 1) + max(1.0, y.sum()))
    if not len(y) or not right[-1]:
        return 0.5
    at = int(f1.argmax())
    below = odds[order[at + 1]] if at + 1 < len(y) else odds[order[at]]
    return float(np.clip(1 / (1 + np.exp(-(odds[order[at]] + below) / 2)), 0.1, 0.9))


def _choose(texts: DataFrame, category: str) -> dict[str, int]:
    """The words that say most about a category, by the deviation from its share, in order."""
    has = F.col(category)
    total = texts.where(has.isNotNull()).agg(F.count(F.lit(1)), F.avg(has)).first()
    share = total[1] or 0.0
    if not 0 < share < 1:
        return {}
    each = (texts.where(has.isNotNull()).select(has.alias("y"), F.explode("terms").alias("w"))
            .where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).where(F.col("n") >= LEAST_TEXTS))
    z = F.abs((F.col("s") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share)))
    return {r["w"]: i for i, r in enumerate(each.select("w", z.alias("z")).orderBy(F.desc("z"), "w").limit(WORDS).collect())}


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> Chain:
    """``labels``: ids with a 0/1 column for each category."""
    plain = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = labelled_sample(plain, labels.select(F.col(id).alias("id"), *categories), "id", categories, sample)

    def terms(batch: pa.RecordBatch):
        yield {"terms": [sorted(terms_of(words_of(t))) for t in batch.column("text").to_pylist()]} | {
            c: batch.column(c) for c in ("id", "text", *categories)}
    fields = ", ".join(f"`{c}` double" for c in categories)
    kind = docs.schema[id].dataType.simpleString()
    doubles = [F.col(c).cast("double").alias(c) for c in categories]
    texts = written(map_arrow(texts.select("id", "text", *doubles), terms, f"id {kind}, text string, terms array<string>, {fields}"), "sample")
    chain = Chain(list(categories))
    chain.words = [_choose(texts, c) for c in categories]
    wanted = set().union(*chain.words)

    def run(batch: pa.RecordBatch):
        texts_, found = batch.column("text").to_pylist(), batch.column("terms").to_pylist()
        yield {"dense": [shares(t, words_of(t)) for t in texts_], "words": [sorted(wanted.intersection(w)) for w in found]} | {
            c: batch.column(c) for c in ("fold", *categories)}
    schema = f"dense array<double>, words array<string>, fold int, {fields}"
    picked = texts.select("text", "terms", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), *categories)
    rows = map_arrow(picked, run, schema).collect()
    # The same order at every run: sums of floating point numbers depend on it.
    rows.sort(key=lambda r: (r["fold"], r["dense"], r["words"]))
    sets = [set(r["words"]) for r in rows]
    dense = np.array([r["dense"] for r in rows]).reshape(len(rows), N_SHARES)
    fold, odds = np.array([r["fold"] for r in rows], int), np.zeros((len(rows), len(categories)))
    for k, c in enumerate(categories):
        y = np.array([np.nan if r[c] is None else r[c] for r in rows], float)
        x, known = chain.inputs(k, sets, dense, odds), ~np.isnan(y)
        for f in range(FOLDS):  # later models learn from out-of-fold predictions
            odds[fold == f, k] = Linear.fit(x[known & (fold != f)], y[known & (fold != f)]).logit(x[fold == f])
        chain.thresholds.append(best_threshold(odds[known, k], y[known]))
        chain.models.append(Linear.fit(x[known], y[known]))
    return chain


def predict(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` and a verdict ``is_<category>`` for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"{x}_{c}" for c in chain.categories for x in ("p", "is")]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in added}]

    def run(batch: pa.RecordBatch):
        p = shared.value.predict([t or "" for t in batch.column(text).to_pylist()])
        out = {f.name: batch.column(f.name) for f in kept}
        for k, c in enumerate(chain.categories):
            out |= {f"p_{c}": p[:, k].tolist(), f"is_{c}": (p[:, k] >= chain.thresholds[k]).tolist()}
        yield out
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{a}` {'double' if a.startswith('p_') else 'boolean'}" for a in added)])
    return map_arrow(docs.select(*[f"`{f.name}`" for f in kept]), run, schema, rows=256)
