"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a posting (term, row, pos) for every word of the training texts that is a word of
the benchmark; words that no benchmark item has can match nothing. It is written once. Its counts
tell how rare each benchmark word is. Every window of ``window`` successive words of an item is
looked up by its rarest word, then by its second rarest: a posting at ``pos`` of the item's word
``offset`` is moved to the place ``pos - offset`` where the item would begin, and lists of equal
(row, item, place) are intersected. What both lists share is checked against the postings of all of
the item's words; runs of at least ``window`` matches are exact phrase matches (an item shorter than
a window must match whole). ``proximity`` finds the rows that have all words of an item within a
number of words, from the same index.

The benchmark side (words, windows) is broadcast below ``BROADCAST_ROWS`` rows and joined by
shuffles beyond; both ways give the same rows. Nothing is paired up that shares no rare word.

Edge cases: null and empty texts have no words; rows are told apart by a number of their own, so
repeated rows and null ids get a result each; items without words match nothing; repeated items
match each by itself; empty tables give zero hits; clashing column names cannot arise, since the
operator takes and returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.llm.common import ascii_lower
from strata.session import written

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_ROWS = 200_000


def split_words(text: Column) -> Column:
    """Lower-cased words; ASCII other than letters and digits separates them."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """``df`` (written before) marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class Index:
    """Positional index of a corpus, restricted to the words of the items."""

    def __init__(self, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                 text: str = "text"):
        texts = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"),
                             split_words(F.col(text)).alias("words")).where(F.size("words") > 0)
        self.items = written(texts.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("off", "word")), "items")
        terms = self.items.select("word").distinct()
        self.terms = written(terms.select("word", F.xxhash64("word").alias("term")), "terms")
        # A posting of a null word behind the last one carries the number of words and names the document.
        ends = F.concat(split_words(F.col(text)), F.array(F.lit(None).cast("string")))
        rows = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), ends.alias("w"))
                .select("row", "doc_id", "text_hash", F.posexplode("w").alias("pos", "word")))
        known = rows.join(_small(self.terms), "word", "left").where("term is not null or word is null")
        of_doc = lambda c: F.when(F.col("word").isNull(), F.col(c)).alias(c)
        self.postings = written(known.select("term", "row", "pos", of_doc("doc_id"), of_doc("text_hash")), "postings")

    def docs(self) -> DataFrame:
        """(row, doc_id, text_hash, n_words)"""
        return self.postings.where("term is null").select("row", "doc_id", "text_hash", F.col("pos").cast("bigint").alias("n_words"))

    def frequencies(self) -> DataFrame:
        """(term, tf) over the corpus; words that never occur have none."""
        return self.postings.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def _ranked(index: Index, window: int) -> DataFrame:
    """(item, n, start, need, off, term, rank): the words of each window, rarest first. Windows with a word
    that the corpus does not have are left out."""
    w = index.items.join(index.terms, "word").join(index.frequencies(), "term", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    need = F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - need + 1), F.least(F.col("off"), F.col("n") - need))
    each = w.withColumn("need", need).withColumn("start", F.explode(starts))
    of_window = Window.partitionBy("item", "start")
    return (each.withColumn("rank", F.row_number().over(of_window.orderBy("tf", "off")))
            .withColumn("least", F.min("tf").over(of_window)).where("least > 0").drop("least", "tf", "word", "item_id"))


def phrases(index: Index, window: int = WINDOW) -> DataFrame:
    """(row, item, start, end): maximal runs of words of a document, ``end`` excluded, that equal a run of
    an item's words of at least ``window`` words, or the whole of a shorter item."""
    ranked = written(_ranked(index, window), "windows")
    postings = index.postings.where("term is not null").select("term", "row", "pos")

    def places(rank: int) -> DataFrame:
        keys = _small(ranked.where(F.col("rank") == rank).select("term", "item", "off").distinct())
        return (postings.join(keys, "term").select("row", "item", (F.col("pos") - F.col("off")).alias("place"))).distinct()
    short = ranked.where("need = 1").select("item").distinct()  # a single word has no second
    rarest = places(1)
    both = rarest.join(places(2), ["row", "item", "place"], "left_semi")
    singles = rarest.join(_small(short), "item", "left_semi").select("row", "item", "place")
    candidates = written(both.unionByName(singles).distinct(), "candidates")
    words = _small(written(index.items.join(index.terms, "word").select("item", "n", "off", "term"), "item_words"))
    wanted = candidates.join(words, "item").select("row", "term", (F.col("place") + F.col("off")).cast("int").alias("pos"), "item", "n", "off", "place")
    wanted = _small(written(wanted.where("pos >= 0"), "wanted"))
    matched = postings.join(wanted, ["row", "pos", "term"]).select("row", "item", "place", "n", "off", "pos")
    # Successive offsets make a run.
    of = Window.partitionBy("row", "item", "place").orderBy("off")
    runs = matched.withColumn("run", F.col("off") - F.row_number().over(of))
    return (runs.groupBy("row", "item", "place", "run")
            .agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first("n").alias("n"))
            .where(F.col("end") - F.col("start") >= F.least(F.col("n"), F.lit(window))).select("row", "item", "start", "end"))


def proximity(index: Index, span: int) -> DataFrame:
    """(row, item): documents that have all distinct words of an item within ``span`` successive words.

    Around each posting of the item's rarest word, the other words' postings are counted by blocks of
    ``span`` places, so only places near that word meet; a sliding minimum then decides exactly."""
    ranked = index.items.join(index.terms, "word").select("item", "term").distinct()
    tf = index.frequencies()
    known = ranked.join(tf, "term", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    of = Window.partitionBy("item")
    known = (known.withColumn("k", F.row_number().over(of.orderBy("tf", "term"))).withColumn("m", F.count(F.lit(1)).over(of))
             .withColumn("least", F.min("tf").over(of)).where("least > 0"))
    known = written(known.select("item", "term", "k", "m"), "near_terms")
    postings = index.postings.where("term is not null").select("row", "term", "pos")
    rare = postings.join(_small(known.where("k = 1")), "term").select("row", "item", "m", F.col("pos").alias("at"))
    rare = rare.withColumn("block", F.explode(F.sequence(F.floor((F.col("at") - span + 1) / span), F.floor((F.col("at") + span - 1) / span))))
    other = postings.join(_small(known), "term").select("row", "item", "term", "pos", F.floor(F.col("pos") / span).alias("block"))
    near = rare.join(other, ["row", "item", "block"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    # All words lie in a stretch that begins at one of the matched places at or before the rare word.
    begins = near.where("pos <= at").select("row", "item", "at", "m", F.col("pos").alias("begin")).distinct()
    held = begins.join(near.select("row", "item", "at", "term", "pos"), ["row", "item", "at"]).where(
        (F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + span))
    full = held.groupBy("row", "item", "at", "begin").agg(F.countDistinct("term").alias("got"), F.first("m").alias("m")).where("got = m")
    return full.select("row", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                  item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash (xxhash64 of the text), n_words, n_hit (words inside any
    occurrence of a window), items (sorted ids of the items with occurring windows, as strings)."""
    index = Index(docs, items, doc_id, item_id, text)
    found = written(phrases(index, window), "phrases")
    # Runs of several items may overlap: a word counts for the first run that holds it.
    before = Window.partitionBy("row").orderBy("start", "end", "item").rowsBetween(Window.unboundedPreceding, -1)
    fresh_from = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = (found.withColumn("new", F.greatest(F.lit(0), F.col("end") - fresh_from)).groupBy("row").agg(F.sum("new").cast("bigint").alias("n_hit")))
    names = found.select("row", "item").distinct().join(_small(index.items.select("item", "item_id").distinct()), "item")
    listed = names.groupBy("row").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    return (index.docs().join(hits.join(listed, "row"), "row", "left")
            .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
