"""Hidden Markov language model over hashed symbols, with exact scores.

A word belongs to one of ``SYMBOLS`` symbols by its hash; the last symbol ends a text. A text's
probability is the model's probability of its symbols times that of each word within its symbol,
(c + 0.1) / (C + 0.1 (V + 1)), where c counts the word, C the symbol's words and V its distinct ones in
the training texts. The first factor is the scaled forward recursion over all states, so the score is
the exact likelihood of the whole text. Symbols and states bound the broadcast model by constants;
the words' own counts grow with the corpus and reach the texts by a join.

Texts are read once into blocks of bounded size: the block's distinct words and the texts as numbers
of those words. A block that is a text longer than the bound is a block by itself. Word counts are a
Spark aggregation over blocks' distinct words; a block asks the counts for its own words by a join.

Baum-Welch: each round, tasks add up expected counts over their blocks, Spark sums them by symbol,
and the driver, which holds only the bounded model, normalises them. Within a block, texts are cut
into segments of ``SEGMENT`` symbols. The product of a segment's steps is a small matrix; chaining the
matrices gives the exact state distribution at each segment's ends, after which all segments run
through the forward and backward recursions at once.

Edge cases: null and empty texts are the end symbol alone; repeated rows each count and get equal
scores; null ids count as empty ids; a corpus without training texts gives a uniform model; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import lower_words, map_arrow, stored, utf8

SYMBOLS = 1 << 14
END = SYMBOLS  # number of the end symbol; SYMBOLS + 1 in all
STATES = 6
ROUNDS = 4
SEGMENT = 96
BLOCK_BYTES = 4 << 20
SMOOTHING = 0.1
_RESCALE = 4  # steps between rescalings


def _pack(codes: np.ndarray) -> bytes:
    return zstandard.compress(codes.astype("<u4").tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


def symbol(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) % SYMBOLS


def blocks(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block: (block, ids, held, sizes, codes, words, symbols, counts). ``codes`` are
    the texts' words as compressed numbers into ``words``, ``symbols`` the words' symbols, and
    ``counts`` the words' numbers in the block's training texts. Block numbers are random: the table is
    written once, so a task that runs twice leaves one of its results."""
    kind = docs.schema[id].dataType.simpleString()
    schema = (f"block bigint, ids array<{kind}>, held array<boolean>, sizes array<int>, codes binary, words array<binary>, "
              "symbols binary, counts array<int>")

    def pack(rows, texts):
        known: dict[bytes, int] = {}
        codes = [np.fromiter((known.setdefault(w, len(known)) for w in t), np.uint32, len(t)) for t in texts]
        counts = np.zeros(len(known), np.int64)
        for (_, held), c in zip(rows, codes):
            if not held:
                counts += np.bincount(c, minlength=len(known))
        return {"block": [uuid.uuid4().int >> 65], "ids": [[r[0] for r in rows]],
                "held": [[r[1] for r in rows]], "sizes": [[len(c) for c in codes]], "codes": [_pack(np.concatenate(codes))],
                "words": [list(known)], "symbols": [np.array([symbol(w) for w in known], "<u2").tobytes()], "counts": [counts.tolist()]}

    def run(batch: pa.RecordBatch):
        rows, texts, size = [], [], 0
        for i, h, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
            rows.append((i, h))
            texts.append(lower_words(t))
            size += len(t) + 64
            if size >= BLOCK_BYTES:
                yield pack(rows, texts)
                rows, texts, size = [], [], 0
        if rows:
            yield pack(rows, texts)
    picked = docs.select(F.col(id).alias("id"), held_out.alias("held"), utf8(text).alias("t"))
    return stored(map_arrow(picked, run, schema, rows=4096), "blocks")


def word_counts(found: DataFrame) -> DataFrame:
    """(word, c) of all training words, ``word`` in UTF-8."""
    each = found.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    return stored(each.where("c > 0").groupBy("word").agg(F.sum("c").cast("bigint").alias("c")), "words")


class Model:
    """Start, transition and emission probabilities; emissions are stored relative to the greatest of a
    symbol's states, whose logarithms are kept apart, so that products stay in range."""

    def __init__(self, start, move, emit):
        self.start, self.move = start, move
        top = emit.max(axis=1)
        self.emit, self.log_top = emit / top[:, None], np.log(top)

    @classmethod
    def first(cls, totals: np.ndarray, states: int, seed: int = 7):
        """States that stay as they are mostly and emit symbols by their counts, each with its own tilt."""
        rng = np.random.default_rng(seed)
        emit = (totals + SMOOTHING)[:, None] * np.exp(rng.normal(0, 1.0, (len(totals), states)))
        emit[END] = totals[END] + SMOOTHING
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def fitted(cls, start, move, emit, totals, prior: float = 2.0):
        """From expected counts. Emissions shrink towards the corpus's own by ``prior`` occurrences a symbol."""
        smooth = prior * len(totals) * (totals + SMOOTHING) / (totals + SMOOTHING).sum() * 0.05
        emit = emit + smooth[:, None]
        move = move + 0.1
        start = start + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Segments:
    """Texts of one block laid out as segments, side by side, the longest first: those that still run at
    step ``t`` are the first ``running[t]``."""

    def __init__(self, symbols: list[np.ndarray]):
        """symbols: of each text, end symbol included."""
        sizes = np.array([len(s) for s in symbols])
        self.per_text = -(-sizes // SEGMENT)
        self.first = np.concatenate([[0], np.cumsum(self.per_text)[:-1]])
        self.n = int(self.per_text.sum())
        text = np.repeat(np.arange(len(symbols)), self.per_text)
        place = np.arange(self.n) - self.first[text]  # of a segment in its text
        length = np.minimum(SEGMENT, sizes[text] - place * SEGMENT)
        order = np.argsort(-length, kind="stable")
        self.where = np.empty(self.n, np.int64)  # column of the segment that is the n-th in text order
        self.where[order] = np.arange(self.n)
        self.opens = np.flatnonzero(place[order] == 0)  # columns that begin a text
        self.running = np.searchsorted(-length[order], -np.arange(SEGMENT), side="left")
        self.grid = np.full((SEGMENT, self.n), END, np.int64)  # steps by columns
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(length) - length, length)
        self.grid[within, np.repeat(self.where, length)] = np.concatenate(symbols)

    def column(self, texts: np.ndarray, j: int) -> np.ndarray:
        return self.where[self.first[texts] + j]


def _entries(move: np.ndarray, emit: list[np.ndarray], start: np.ndarray, seg: Segments):
    """State distribution before each segment's first step (states by columns), the product of each segment's
    steps (from, to, column), and the log probability of each text. ``emit``: the relative emissions of each
    step, states by columns. Columns come last everywhere, so that all sums run along them."""
    k, back = len(start), np.ascontiguousarray(move.T)
    total = np.repeat(np.eye(k, dtype=move.dtype)[:, :, None], seg.n, axis=2)
    scale = np.zeros(seg.n)
    for t, m in enumerate(seg.running):
        if not m:
            break
        part = total[:, :, :m]
        moved = np.matmul(back, part)
        if t == 0:  # the first step of a text has no move before it
            moved[:, :, seg.opens] = part[:, :, seg.opens]
        np.multiply(moved, emit[t], out=part)
        if t % _RESCALE == _RESCALE - 1:
            top = part.max(axis=(0, 1))
            part /= top
            scale[:m] += np.log(top)
    entry = np.empty((k, seg.n))
    log_p = np.zeros(len(seg.per_text))
    state = np.repeat(start[:, None], len(seg.per_text), axis=1)
    for j in range(int(seg.per_text.max(initial=0))):
        who = np.flatnonzero(seg.per_text > j)
        at = seg.column(who, j)
        entry[:, at] = state[:, who]
        out = np.einsum("in,ijn->jn", state[:, who], total[:, :, at])
        size = out.sum(axis=0)
        state[:, who] = out / size
        log_p[who] += np.log(size) + scale[at]
    return entry, total, log_p


def _emissions(model: Model, seg: Segments, kind) -> list[np.ndarray]:
    of_state = np.ascontiguousarray(model.emit.T, kind)
    return [np.take(of_state, seg.grid[t, :m], axis=1) for t, m in enumerate(seg.running)]


def log_likelihood(model: Model, symbols: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text's symbols (the end symbol last)."""
    if not symbols:
        return np.zeros(0)
    seg = Segments(symbols)
    log_p = _entries(model.move, _emissions(model, seg, np.float64), model.start, seg)[2]
    return log_p + np.array([model.log_top[s].sum() for s in symbols])


def expected_counts(model: Model, symbols: list[np.ndarray]):
    """Expected starts (K), moves (K, K) and emissions (symbols, K) of the texts, and their log likelihood."""
    # Single precision is enough for counts; scores are computed in double precision.
    seg, k, move = Segments(symbols), len(model.start), model.move.astype(np.float32)
    emit = _emissions(model, seg, np.float32)
    entry, total, log_p = _entries(move, emit, model.start, seg)
    back = np.empty((k, seg.n), np.float32)  # backward weights behind each segment
    weight = np.ones((k, len(seg.per_text)))
    for j in range(int(seg.per_text.max(initial=0)) - 1, -1, -1):
        who = np.flatnonzero(seg.per_text > j)
        at = seg.column(who, j)
        back[:, at] = weight[:, who]
        w = np.einsum("ijn,jn->in", total[:, :, at], weight[:, who])
        weight[:, who] = w / w.sum(axis=0)
    del total
    forward = []
    entry = state = entry.astype(np.float32)
    against = np.ascontiguousarray(move.T)
    for t, m in enumerate(seg.running):
        if not m:
            break
        moved = against @ state[:, :m]
        if t == 0:
            moved[:, seg.opens] = state[:, seg.opens]
        moved *= emit[t]
        if t % _RESCALE == _RESCALE - 1:
            moved /= moved.sum(axis=0)
        forward.append(moved)
        state = moved
    gammas, seen = [], []
    moves, starts = np.zeros((k, k)), np.zeros(k)
    for t in range(len(forward) - 1, -1, -1):
        m = seg.running[t]
        inner = back[:, :m] * emit[t]
        step = move @ inner
        a = forward[t - 1][:, :m] if t else entry[:, :m]
        gamma = forward[t] * back[:, :m]
        gamma /= gamma.sum(axis=0)
        gammas.append(gamma)
        seen.append(seg.grid[t, :m])
        norm = (a * step).sum(axis=0)
        if t == 0:
            starts += gamma[:, seg.opens].sum(axis=1)
            norm[seg.opens] = np.inf
        moves += (a / norm) @ inner.T
        if t % _RESCALE == 0:
            step /= step.sum(axis=0)
        back[:, :m] = step
    gamma, sym = np.concatenate(gammas, axis=1), np.concatenate(seen)
    emissions = np.stack([np.bincount(sym, g, SYMBOLS + 1) for g in gamma], axis=1)
    return starts, moves * model.move, emissions, float(log_p.sum() + model.log_top[sym].sum())


def _texts(codes: bytes, sizes: list[int], symbols: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(symbols, "<u2").astype(np.int64)[_unpack(codes)]
    return [np.append(flat[e - n:e], END) for e, n in zip(np.cumsum(sizes), sizes)]


def train(found: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model and the training texts' log likelihood before each round."""
    spark = found.sparkSession
    per_symbol = _sum_rows(found.select("held", "sizes", "codes", "symbols"), None, 1)
    totals = np.zeros(SYMBOLS + 1)
    for r in per_symbol:
        totals[r["k"]] = r["v"][0]
    model, history = Model.first(totals, states), []
    for _ in range(rounds):
        starts, moves, emit, like = np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS + 1, states)), 0.0
        for r in _sum_rows(found.select("held", "sizes", "codes", "symbols"), spark.sparkContext.broadcast(model), states):
            k, v = r["k"], r["v"]
            if k >= 0:
                emit[k] = v
            elif k == -1:
                starts += v
            elif k == -2:
                like += v[0]
            else:
                moves[-k - 3] = v
        history.append(like)
        if emit.sum() == 0:
            break
        model = Model.fitted(starts, moves, emit, totals)
    return model, history


def _sum_rows(found: DataFrame, model, width: int):
    """Sums over the training texts of all blocks, as at most SYMBOLS + STATES + 3 rows (k, v): emissions by
    symbol k; starts at -1, the log likelihood at -2, moves from state i at -3 - i. Without a model: the
    symbols' counts."""
    def run(batches):
        starts, like, moves = np.zeros(width), 0.0, np.zeros((width, width))
        emit = np.zeros((SYMBOLS + 1, width))
        for batch in batches:
            for held, sizes, codes, symbols in zip(*(batch.column(c).to_pylist() for c in range(4))):
                texts = [t for t, h in zip(_texts(codes, sizes, symbols), held) if not h]
                if not texts:
                    continue
                if model is None:
                    emit[:, 0] += np.bincount(np.concatenate(texts), minlength=SYMBOLS + 1)
                else:
                    s, m, e, p = expected_counts(model.value, texts)
                    starts += s
                    moves += m
                    emit += e
                    like += p
        keys = np.flatnonzero(emit.any(axis=1))
        ks = [*keys.tolist(), -1, -2, *(-3 - i for i in range(width))]
        vs = [*emit[keys].tolist(), starts.tolist(), [like] * width, *moves.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(vs, pa.list_(pa.float64()))], ["k", "v"])
    parts = found.mapInArrow(run, "k int, v array<double>")
    sums = [F.sum(F.col("v")[i]) for i in range(width)]
    return parts.groupBy("k").agg(F.array(*sums).alias("v")).collect()


def scores(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text", states: int = STATES,
           rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from those
    where the boolean column ``held_out`` is not true. Scores are log10 probabilities of whole texts with
    their end; ``base_score`` is that of independent words."""
    found = blocks(docs, held_out, id, text)
    counts = word_counts(found)
    sizes = found.select(F.explode(F.arrays_zip("held", "sizes")).alias("x")).where("not x.held").agg(
        F.count(F.lit(1)).alias("ends"), F.coalesce(F.sum("x.sizes"), F.lit(0)).alias("n")).first()
    distinct = counts.count()
    model, _ = train(found, states, rounds)
    # Of each symbol: its tokens and distinct words in the training texts.
    of_symbol = np.zeros((SYMBOLS, 2))

    def by_symbol(batch: pa.RecordBatch):
        sym = np.array([symbol(w) for w in batch.column(0).to_pylist()], np.int64)
        c = np.bincount(sym, batch.column(1).to_numpy(), SYMBOLS)
        v = np.bincount(sym, minlength=SYMBOLS)
        keep = np.flatnonzero(v)
        yield {"s": keep.tolist(), "c": c[keep].tolist(), "v": v[keep].tolist()}
    for r in (map_arrow(counts, by_symbol, "s int, c double, v double", rows=1 << 16).groupBy("s")
              .agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()):
        of_symbol[r["s"]] = r["c"], r["v"]
    n_all, v_all = sizes["n"] + sizes["ends"], distinct + (sizes["ends"] > 0)
    shared = docs.sparkSession.sparkContext.broadcast((model, of_symbol, int(n_all), int(v_all), int(sizes["ends"])))
    # Each block's words with their counts in the corpus.
    asked = found.select("block", F.posexplode("words").alias("code", "word"))
    told = (asked.join(counts, "word").groupBy("block")
            .agg(F.collect_list("code").alias("known"), F.collect_list("c").alias("c")))
    kind = docs.schema[id].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        m, symbols_, n, v, ends = shared.value
        for ids, held, lens, codes, of_words, known, c in zip(*(batch.column(k).to_pylist() for k in range(7))):
            sym = np.frombuffer(of_words, "<u2")
            count = np.zeros(len(sym))
            if known:
                count[known] = c
            inside = np.log10(count + SMOOTHING) - np.log10(symbols_[sym, 0] + SMOOTHING * (symbols_[sym, 1] + 1))
            base = np.log10(count + SMOOTHING)
            like = log_likelihood(m, _texts(codes, lens, of_words)) / np.log(10)
            flat, size = _unpack(codes), np.array(lens)
            at = np.cumsum(size) - size
            add = lambda x: np.array([x[flat[a:a + k]].sum() for a, k in zip(at, size)])
            floor = np.log10(n + SMOOTHING * (v + 1))
            yield {"id": ids, "held_out": held, "n_tokens": (size + 1).tolist(), "n_known": (add((count > 0).astype(np.int64)) + (ends > 0)).tolist(),
                   "train_tokens": [n] * len(ids), "base_score": (add(base) + np.log10(ends + SMOOTHING) - (size + 1) * floor).tolist(),
                   "score": (like + add(inside)).tolist()}
    joined = found.join(told, "block", "left").select("ids", "held", "sizes", "codes", "symbols", "known", "c")
    return map_arrow(joined, run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                  "base_score double, score double", rows=1)
