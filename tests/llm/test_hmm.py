import collections
import math

import numpy as np
from pyspark.sql import functions as F

from helpers import A, B, docs
from strata.llm import hmm


def plain_forward(m, x):
    emit = m.emit * np.exp(m.log_top)[:, None]
    state, log_p, out = m.start * emit[x[0]], 0.0, []
    for t, o in enumerate(x):
        if t:
            state = (state @ m.move) * emit[o]
        log_p += np.log(state.sum())
        state = state / state.sum()
        out.append(state)
    return out, log_p


def test_recursions(monkeypatch):
    """Segments give what the plain recursions over whole texts give."""
    monkeypatch.setattr(hmm, "SEGMENT", 5)
    rng = np.random.default_rng(0)
    m = hmm.Model.first(rng.integers(1, 50, hmm.SYMBOLS + 1).astype(float), 3)
    texts = [np.append(rng.integers(0, hmm.SYMBOLS, n), hmm.END) for n in (0, 1, 4, 5, 9, 10, 23, 57)]
    starts, moves, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.SYMBOLS + 1, 3)), 0.0
    e = m.emit * np.exp(m.log_top)[:, None]
    for x in texts:
        forward, log_p = plain_forward(m, x)
        total += log_p
        back = np.ones(3)
        for t in range(len(x) - 1, -1, -1):
            g = forward[t] * back
            emit[x[t]] += g / g.sum()
            if t:
                xi = forward[t - 1][:, None] * m.move * (e[x[t]] * back)[None]
                moves += xi / xi.sum()
                back = m.move @ (e[x[t]] * back)
                back /= back.sum()
            else:
                starts += g / g.sum()
    s, v, em, like = hmm.expected_counts(m, texts)
    assert np.allclose(s, starts, atol=1e-4) and np.allclose(v, moves, atol=1e-3) and np.allclose(em, emit, atol=1e-4) and math.isclose(like, total, rel_tol=1e-6)
    assert np.allclose(hmm.log_likelihood(m, texts), [plain_forward(m, x)[1] for x in texts])


def test_scores(spark):
    texts = [f"{A} {A}", B, None, "", A.upper(), B, "unseen zzz", A] * 6
    held = [i % 5 == 0 for i in range(len(texts))]
    frame = docs(spark, *texts).withColumn("score", F.lit("clash"))
    rows = {r["id"]: r for r in hmm.scores(frame, F.col("doc_id") % 5 == 0, states=2, rounds=2).collect()}
    words = [(t or "").encode().lower().split() + [None] for t in texts]
    c = collections.Counter(w for t, h in zip(words, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(words):
        r = rows[i]
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, held[i])
        assert r["score"] < 0
    assert rows[2]["score"] == rows[3]["score"]  # null and empty
    assert hmm.scores(docs(spark), F.lit(False), states=2, rounds=1).count() == 0


def test_probabilities_sum_to_one():
    """Over all symbol strings of two symbols the model is a distribution."""
    rng = np.random.default_rng(1)
    m = hmm.Model.first(rng.integers(1, 9, hmm.SYMBOLS + 1).astype(float), 3)
    ones = np.exp(hmm.log_likelihood(m, [np.array([s, hmm.END]) for s in range(0, hmm.SYMBOLS, 97)]))
    assert 0 < ones.sum() < 1
    e = m.emit * np.exp(m.log_top)[:, None]
    assert np.allclose(e.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)


def test_training_raises_likelihood(spark):
    found = hmm.blocks(docs(spark, *([A] * 20 + [B] * 20)), F.lit(False))
    history = hmm.train(found, states=2, rounds=4)[1]
    assert history[-1] > history[0]
