import math
import random
from collections import Counter

import numpy as np
from helpers import docs
from strata.llm.maxscore import BLOCK, _List, build, search_shard, term_rows, terms, top_documents


def brute(texts, items, k):
    """(item, rank, id, score) by scoring every document with a term."""
    own = [(i, Counter(terms((t or "").encode()))) for i, t in texts]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for q, text in items:
        scores = []
        for i, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in terms((text or "").encode()) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(q, r + 1, e[3], -e[0]) for r, e in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(spark, texts, items, k, shard_docs):
    postings, shards = build(docs(spark, *[t for _, t in texts], ids=[i for i, _ in texts]).repartition(3), shard_docs=shard_docs)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    rows = top_documents(postings, shards, queries, k=k, query_block=3).collect()
    return sorted(((r["query_id"], r["rank"], r["id"], r["score"]) for r in rows), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(4000)]
    texts = [(i, " ".join(rng.sample(words, rng.randint(1, 40)))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "..! --"), (203, "Ünï W1-w2_W3"), (None, "w1 w2 w3 w4"), (204, texts[7][1]), (7, texts[7][1]),
              (205, "w5 " * 30000)]
    items = [(1, texts[7][1]), (2, "W1 w1 w2, w150 w77"), (2, "w1 w1 w2 w150 w77"), (3, None), (4, "!"), (5, "nowhere"), (None, "ünï w3 w9"), (6, "w5 w6 w7 w8")]
    assert found(spark, texts, items, 5, 20) == brute(texts, items, 5)


def test_empty(spark):
    assert found(spark, [], [(1, "a")], 5, 20) == []
    assert found(spark, [(1, "a")], [], 5, 20) == []


def test_blocks_stay_packed():
    """Many documents with common terms, few with rare ones: exact, and most blocks are never unpacked."""
    rng = np.random.default_rng(2)
    n = 40000
    lengths = rng.integers(5, 400, n)
    norm = lambda x: 75 + (25 * x * n) // int(lengths.sum())
    weights, lists, dense = [9000, 8000, 300, 100, 50], {}, np.zeros((5, n), np.int64)
    for t, share in enumerate([0.004, 0.01, 0.4, 0.6, 0.9]):
        place = np.flatnonzero(rng.random(n) < share)
        tf = rng.geometric(0.5, len(place))
        _, columns = term_rows(np.full(len(place), t), place, tf, lengths[place])
        lists[t] = _List({k: c[0].as_py() for k, c in columns.items()}, weights[t], norm)
        dense[t, place] = weights[t] * ((10**9 * tf) // (1000 * tf + 12 * norm(lengths[place])))
        for x in lists.values():
            x.unpacked = 0
    queries = [{0: 1, 1: 1, 2: 2, 3: 1, 4: 1}]
    (score, place), = search_shard(lists, queries, norm(lengths), np.arange(n), 20)
    want = sum(times * dense[t] for t, times in queries[0].items())
    best = np.lexsort((np.arange(n), -want))[:20]
    assert (place == best).all() and (score == want[best]).all()
    assert sum(x.unpacked for x in lists.values()) < sum(len(x.last) for x in lists.values()) / 2


def test_packing():
    """Gaps and frequencies of every width come back, and impacts are those that no other of the block beats."""
    rng = np.random.default_rng(8)
    postings = []
    for t, (n, step, top) in enumerate([(1, 5, 2), (64, 3, 4), (65, 300, 4), (200, 70_000, 300), (130, 2, 70_000)]):
        place = np.cumsum(rng.integers(1, step + 1, n)) - 1
        postings += [(t, p, f, l) for p, f, l in zip(place, rng.integers(1, top, n), rng.integers(1, 50, n))]
    term, place, tf, length = np.array(postings).T
    numbers, columns = term_rows(term, place, tf, length)
    assert numbers.tolist() == [0, 1, 2, 3, 4]
    for t in range(5):
        own = term == t
        x = _List({k: c[t].as_py() for k, c in columns.items()}, 1, lambda m: m)
        blocks = [x.block(k) for k in range(len(x.last))]
        assert np.concatenate([b[0] for b in blocks]).tolist() == place[own].tolist() and np.concatenate([b[1] for b in blocks]).tolist() == tf[own].tolist()
        best = [int(x.score(f, l).max()) for f, l in ((tf[own][k:k + BLOCK], length[own][k:k + BLOCK]) for k in range(0, own.sum(), BLOCK))]
        assert x.block_max.tolist() == best
