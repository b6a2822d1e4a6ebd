import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from helpers import A, B, docs
from strata.llm.bpe import Codec, encode, encode_digests, load

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return Codec(load(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, text):
    ids = codec.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert b"".join(codec.decode(ids)).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " \n\t ", A, B, "it's I'LL don't 'sx ''", "x<|endoftext|>y <|STARTOFTEXT|>", "Σίσυφος ΣΑΣ", "é ß İ ﬁ",
    "a\x00b\x1cc　d", "中文字 🎉👩‍👩‍👧", "12 345", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "word " * 5000, "x" * 20000])
def test_cases(codec, library, text):
    same(codec, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'.,!éü09 ABC\n", max_size=60))
def test_any_text(codec, library, text):
    same(codec, library, text)


def test_frames(spark, library):
    rows = encode_digests(docs(spark, A, None, "", A, ids=[1, 2, None, 1]).withColumnRenamed("lang", "ids_sha256"), PATH).collect()
    assert [r["doc_id"] for r in rows] == [1, 2, None, 1]
    ids = library.encode(A, add_special_tokens=False).ids
    assert rows[0]["n_tokens"] == len(ids)
    assert rows[0]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert rows[0]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert rows[0] == rows[3] and rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0
    assert encode(docs(spark), PATH).count() == 0
