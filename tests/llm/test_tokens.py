import base64
import os

import pytest
from helpers import rng
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("peer", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return tokens.Encoder()


SAMPLES = ["Hello world!", "", " ", "\n\n  a\t b", "don't we'll", "żółć Привет 你好 👩‍🍳", "\x00\x01\xad", "aaaa" * 5000, "12 500 €", "<|endoftext|>", "�", "a b c"]


@pytest.mark.parametrize("text", SAMPLES)
def test_equal_to_the_library(own, peer, text):
    assert own.encode(text) == peer.encode_ordinary(text) and own.decode(own.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    enc = tokens.encoder(tokens.VOCABULARY)
    assert enc.decode(enc.encode(text)) == text


def test_column(spark, peer):
    texts = [*SAMPLES, None, "x " * 100_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    assert got == {i: peer.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokens.decode_ids(tokens.encode_texts(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert {r.doc_id: r.tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode_texts(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_whole_table(spark, peer):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    assert len(got) == len(texts) and all(got[k] == (peer.encode_ordinary(t) if t else []) for k, t in texts.items())


def test_forgetting_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    r = rng(1)
    fresh = tokens.Encoder()
    for _ in range(20):
        text = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "ab"]) + str(r.randrange(9)) for _ in range(20))
        assert fresh.encode(text) == own.encode(text)
