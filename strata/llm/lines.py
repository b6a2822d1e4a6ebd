"""Removal of repeated passages by hashing lines and sentences.

Every text is cut into lines and those into sentences. Units are normalised (lower case, single
spaces) and digested; digests are counted over the whole corpus, and of each repeated one the
earliest occurrence (least id, then least text digest, then position) stays. All others go:

* lines of ``min_words`` words or more;
* runs of successive repeated sentences with ``min_run`` words or more together, so that a passage
  inside longer lines goes too. Sentences under ``SENTENCE_WORDS`` words neither start nor break a run.

Shorter repeated units are ordinary language and stay. What stays of a text keeps its characters and
order; ``removed`` lists the spans that went, as code point offsets into the original text. No text
is lost altogether: the first occurrence of a unit is never removed.

Edge cases: null stays null with no spans; empty texts stay; rows equal in id and text are one
document and get one result; null ids rank last; a text that is one huge line is one line of many
sentences; an empty table gives an empty table; other columns are kept, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import fresh, map_arrow, stored

MIN_WORDS = 8
MIN_RUN = 25
SENTENCE_WORDS = 4
_SENTENCE_END = re.compile(r"(?<=[.!?])[ \t\r\f\v]+")
LINE, SENTENCE = 0, 1


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple]:
    """(kind, place, start, end, words, digest) of the lines and sentences of a text. ``place`` counts
    lines and counted sentences apart, in their order."""
    out, at, n_sentences = [], 0, 0
    for n_line, line in enumerate(text.split("\n")):
        cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(line)), len(line)]
        whole: list[str] = []
        for a, b in zip(cuts, cuts[1:]):
            words = line[a:b].split()
            whole += words
            if len(words) >= SENTENCE_WORDS:
                out.append((SENTENCE, n_sentences, at + a, at + b, len(words), _digest(words)))
                n_sentences += 1
        if len(whole) >= min_words:
            out.append((LINE, n_line, at, at + len(line), len(whole), _digest(whole)))
        at += len(line) + 1
    return out


def removable(found: list[tuple], min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Spans to remove, joined and in order, from the repeated units (kind, place, start, end, words)."""
    spans = [(s, e) for kind, _, s, e, _ in found if kind == LINE]
    run: list[tuple] = []
    for u in [*sorted(u for u in found if u[0] == SENTENCE), None]:
        if run and (u is None or u[1] != run[-1][1] + 1):
            if sum(r[4] for r in run) >= min_run:
                spans.append((run[0][2], run[-1][3]))
            run = []
        if u is not None:
            run.append(u)
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans. A line that goes whole takes its line break along."""
    keep, at = [], 0
    for s, e in spans:
        if (s == 0 or text[s - 1] == "\n") and e < len(text) and text[e] == "\n":
            e += 1
        elif e == len(text) and 0 < s and text[s - 1] == "\n":
            s -= 1
        keep.append(text[at:max(at, s)])
        at = max(at, e)
    return "".join([*keep, text[at:]])


def repeated_units(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hash, kind, place, start, end, words, first_id) of every unit that is not the first of its digest; rows of
    repeated documents are repeated."""
    kind = docs.schema[id].dataType.simpleString()

    parts = ("kind", "place", "start", "end", "words", "digest")

    def run(batch: pa.RecordBatch):
        ids, hashes, texts = (batch.column(i) for i in range(3))
        found = [units(t, min_words) for t in texts.to_pylist()]
        yield {"id": ids, "hash": hashes} | {name: [[u[k] for u in us] for us in found] for k, name in enumerate(parts)}
    picked = (docs.where(F.col(text).isNotNull())
              .select(F.col(id).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("t")))
    schema = f"id {kind}, hash bigint, kind array<int>, place array<int>, start array<int>, end array<int>, words array<int>, digest array<binary>"
    # One row per document; only half digests travel to find the units that occur again.
    all_units = stored(map_arrow(picked, run, schema, rows=256).withColumn("row", F.monotonically_increasing_id()), "units")
    halves = all_units.select("row", F.posexplode(F.transform("digest", lambda d: F.xxhash64(d))).alias("k", "half"))
    # Half of a digest tells nearly all single units apart from repeated ones; the whole decides below.
    counts = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    again = halves.join(counts.hint("merge"), "half", "left_semi").groupBy("row").agg(F.collect_list("k").alias("ks"))
    # Rows equal in id and text are one document: its units are taken once where they may meet.
    at = all_units.join(again.hint("merge"), "row").select("id", "hash", F.explode("ks").alias("k"), *parts)
    several = at.select("id", "hash", *[F.col(c)[F.col("k")].alias(c) for c in parts])
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "hash", "start")
    first = several.groupBy("digest").agg(F.min(rank).alias("first"))
    return (several.join(first, "digest").where(~rank.eqNullSafe(F.col("first")))
            .select("id", "hash", "kind", "place", "start", "end", "words", F.col("first.id").alias("first_id")))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                   min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``, and ``removed``: array of (start, end)."""
    gone = (repeated_units(docs, id, text, min_words).groupBy("id", "hash")
            .agg(F.collect_set(F.struct("kind", "place", "start", "end", "words")).alias("found")))
    key, hash_, found = fresh(docs, "_id", "_hash", "_found")
    gone = gone.select(F.col("id").alias(key), F.col("hash").alias(hash_), F.col("found").alias(found))
    own = docs.drop("removed")
    joined = own.join(gone.hint("shuffle_hash"), own[id].eqNullSafe(F.col(key)) & (F.xxhash64(own[text]) == F.col(hash_)), "left")
    names = own.columns

    def run(batch: pa.RecordBatch):
        texts, spans = [], []
        for t, units_ in zip(batch.column(text).to_pylist(), batch.column(found).to_pylist()):
            s = removable([tuple(u.values()) for u in units_], min_run) if units_ else []
            spans.append([{"start": a, "end": b} for a, b in s])
            texts.append(cut(t, s) if s else t)
        yield {n: batch.column(n) for n in names} | {text: texts, "removed": spans}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields),
                        "removed array<struct<start:int,end:int>>"])
    return map_arrow(joined.select(*[f"`{n}`" for n in names], found), run, schema, rows=256)
