import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY_DIR), reason="vocabulary files are not here")


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.VOCABULARY_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


HARD = ["", " ", "  \n\n x", "a" * 3000, "=" * 999, "<|endoftext|>", "I'll we've 'S", "naïve café 東京 😀👩‍👩‍👧", "​ ﻿", "1234567 3.14", "\r\n\t", "é", "the then there", " the" * 50]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(known, text):
    assert bpe.encoder().encode(text) == known(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(known, text):
    assert bpe.encoder().encode(text) == known(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinrst'- \n1é", max_size=120))
def test_wordlike_text(known, text):
    assert bpe.encoder().encode(text) == known(text)


def test_corpus_and_round_trip(spark, small, known):
    import base64

    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in bpe.with_ids(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")).collect()}
    with open(f"{bpe.VOCABULARY_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        token = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    for r in rows:
        assert got[r.doc_id] == (known(r.text) if r.text else [])
        assert b"".join(token[i] for i in got[r.doc_id]).decode() == (r.text or "")


def test_null_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 5), (1, None, "x", 5), (2, "", "y", 6), (3, "word " * 30_000, "z", 7)], "doc_id long, text string, ids string, n_tokens int")
    got = sorted((r.doc_id, len(r.ids), r.n_tokens) for r in bpe.with_ids(df).collect())
    assert got[:3] == [(1, 0, 5), (1, 0, 5), (2, 0, 6)] and got[3][1] > 30_000
    assert sorted(r.n_tokens for r in bpe.with_token_count(df).collect())[:3] == [0, 0, 0]
    assert bpe.with_ids(df.limit(0)).count() == 0
