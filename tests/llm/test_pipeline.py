import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import docs
from pyspark.sql import functions as F
from strata.llm.decisions import measure
from strata.llm.queries import ORACLES, QUERIES
from strata.session import written
from test_postings import brute as brute_hits

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark pages labels".split()


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before each stage, and the result."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return [x.collect() for x in out]


def test_stages(steps):
    docs, good, single, cut, clean, coded = steps
    kept = lambda rows: {r["doc_id"] for r in rows}
    assert kept(docs) > kept(good) >= kept(single) >= kept(cut) >= kept(clean) == kept(coded)
    assert not any(m[0] < 50 or 2 * m[4] > m[0] for m in (measure(r["text"].encode()) for r in good))
    assert len({r["text"] for r in single}) == len(single)
    bench = [t for _, t in sorted(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())]
    for r in cut:
        n, hit, _ = brute_hits(r["text"], bench)
        assert (r["doc_id"] in kept(clean)) == (hit == 0 or 20 * hit < n)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in clean}
    for r in coded:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{SF}/{'pages' if name[:3] in ('op6', 'op9') else 'documents'}.parquet'").fetchall()[0][0]
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = con.execute(ORACLES[name]).df()
        cols = sorted(want.columns)
        assert sorted(rows[0].asDict()) == cols
        want = want[cols].itertuples(index=False, name=None)
        assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(want)


def test_digests(spark):
    row = QUERIES["op8_positional_index"](spark, SF).where("n_items = 0").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_clashing_columns(spark, tmp_path):
    """Every filtering stage takes documents with extra columns named like its own."""
    rows = docs(spark, "some words of a text", None, "").withColumns({c: F.lit(1) for c in ("_id", "_hash", "_measured", "n_words", "kept", "oi", "ot", "digest", "ids")})
    written_docs = written(rows, "clash")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, written_docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS and stage(spark, written_docs, str(tmp_path)).count() >= 1
