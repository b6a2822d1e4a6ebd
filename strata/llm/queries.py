"""Queries opN_<name>: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


@query()
def op5_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.bpe import encode_digests
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


@query()
def op10_simhash_popcount(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.popcount import as_hex, near_duplicates
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query()
def op4_line_hashing(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.lines import remove_repeats
    docs = table(spark, sf, "documents").select("doc_id", "text", F.length("text").cast("bigint").alias("n_before"))
    return remove_repeats(docs).select("doc_id", "text", "removed", F.size("removed").cast("bigint").alias("n_removed"),
                                       (F.col("n_before") - F.length("text")).alias("chars_removed"))


_OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT k, item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
       FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM d, ns, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS s)),
h AS (SELECT DISTINCT r, s, n, k, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, array_to_string(list_sort(list(item_id::VARCHAR)), ',') AS items FROM (SELECT DISTINCT r, k, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)"""


@query(_OP8_SQL)
def op8_positional_index(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.postings import contamination
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@query()
def op1_hidden_markov(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.hmm import scores
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return scores(table(spark, sf, "documents"), held).withColumnRenamed("id", "doc_id")


@query()
def op2_slot_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every document on one of 64 shards; a hot source spreads, since the id is the key."""
    from strata.llm.slots import lookup, place
    shards = lookup(spark, [f"shard-{i:03d}" for i in range(64)])
    return place(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", shards)


@query()
def op3_classifier_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled categories in the order of the chain: poor texts, then toxic ones."""
    from strata.llm.chain import predict, train
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    scored = predict(docs, train(docs, labels, ["poor", "toxic"]))
    return scored.select("doc_id", "p_poor", "p_toxic", F.col("is_toxic").alias("toxic"))


@query()
def op7_decision_list(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.decisions import COUNTS, judge, measures, train
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf, "labels"))
    judged = judge(measures(docs).drop("text"), rules)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "rule")


# The rules of the query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
# Words in hosts that label a URL as bad for training.
BAD_HOST_WORDS = ["spam", "pills", "casino", "bets"]


@query()
def op9_boosted_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled URLs: a page's URL ends in the number of the document that it shows. Its label is that
    document's, bad if its quality is 0, and bad for hosts with a word that marks them."""
    from strata.llm.boosting import host_of, judge, path_of
    pages = table(spark, sf, "pages").select("page_id", "url")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    numbered = pages.withColumn("doc_id", F.regexp_extract(path_of(F.col("url")), r"(\d+)[^/\d]*/?$", 1).try_cast("bigint"))
    marked = F.lit(False)
    for w in BAD_HOST_WORDS:
        marked = marked | host_of(F.col("url")).contains(w)
    labelled = numbered.join(labels, "doc_id", "left").select("url", F.when(marked, 1).when(F.col("quality").isNotNull(), 1 - F.col("quality")).alias("bad"))
    return judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "p_bad")


@query()
def op6_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.styletree import main_texts
    found = main_texts(table(spark, sf, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


_OP13_SQL = r"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS q FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, (k - 1) // (len(q) // 16) AS part, (k - 1) % (len(q) // 16) AS d, floor(256 * q[k]::DOUBLE)::BIGINT AS x
      FROM v, LATERAL (SELECT unnest(generate_series(1, len(q))) AS k)),
b0 AS (SELECT part, r - 1 AS entry, d, x AS e FROM p WHERE r <= 64),
d0 AS (SELECT r, part, entry, sum((x - e) * (x - e))::BIGINT AS far FROM p JOIN b0 USING (part, d) GROUP BY r, part, entry),
a0 AS (SELECT r, part, min(far * 64 + entry) % 64 AS entry FROM d0 GROUP BY r, part),
m0 AS (SELECT part, entry, d, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM p JOIN a0 USING (r, part) GROUP BY part, entry, d),
b1 AS (SELECT part, entry, d, coalesce(m, e) AS e FROM b0 LEFT JOIN m0 USING (part, entry, d)),
d1 AS (SELECT r, part, entry, sum((x - e) * (x - e))::BIGINT AS far FROM p JOIN b1 USING (part, d) GROUP BY r, part, entry),
a1 AS (SELECT r, part, min(far * 64 + entry) % 64 AS entry FROM d1 GROUP BY r, part),
m1 AS (SELECT part, entry, d, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM p JOIN a1 USING (r, part) GROUP BY part, entry, d),
b2 AS (SELECT part, entry, d, coalesce(m, e) AS e FROM b1 LEFT JOIN m1 USING (part, entry, d)),
d2 AS (SELECT r, part, entry, sum((x - e) * (x - e))::BIGINT AS far FROM p JOIN b2 USING (part, d) GROUP BY r, part, entry),
a2 AS (SELECT r, part, min(far * 64 + entry) AS best FROM d2 GROUP BY r, part),
c AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY part, entry, d)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"""


@query(_OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.prefixtrie import as_hex, compress, digest
    coded, books = compress(table(spark, sf, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), as_hex(F.col("code")).alias("code"), "error", "label_error",
                        F.lit(digest(books)).alias("codebooks_sha256"))


_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(t) AS term FROM (
        SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)) GROUP BY k, item_id, term),
p AS (SELECT r, doc_id, term, n, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term, n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
f AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS part FROM p JOIN w USING (term), s),
e AS (SELECT k, item_id, r, doc_id, sum(times * part)::BIGINT AS score FROM f JOIN q USING (term) GROUP BY k, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM e WHERE score > 0) WHERE rank <= 20"""


@query(_OP12_SQL)
def op12_block_max_maxscore(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.maxscore import build, top_documents
    postings, shards = build(table(spark, sf, "documents"))
    found = top_documents(postings, shards, table(spark, sf, "benchmark"))
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").cast("bigint").alias("doc_id"), "score")


@query()
def op11_suffix_levels(spark: SparkSession, sf: str) -> DataFrame:
    from strata.llm.suffixes import remove_repeats
    cut = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return cut.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"),
                      F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
