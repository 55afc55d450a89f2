"""Byte BPE: exact against the reference library, round trips, linear time, edge cases."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from chronowatt.llm import bpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
WANT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert CODEC.encode(text) == WANT.encode_ordinary(text)
    assert CODEC.decode_packed(CODEC.encode_packed(text)) == text.encode()


def test_white_space_and_marks():
    rnd, marks = random.Random(1), " \n\t\r\x0b\x1c\x1f\x85\xa0 　abcdeèñ中文😀123'sS!?#--__́​"
    for _ in range(3_000):
        text = "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 30)))
        assert CODEC.encode(text) == WANT.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 40_000, " " * 20_000, "ab" * 20_000, "é" * 20_000, "\n" * 9_999 + "x", "<|endoftext|>"])
def test_long_pieces_take_linear_time(text):
    started = time.time()
    got = CODEC.encode(text)
    assert time.time() - started < 5
    assert got == WANT.encode_ordinary(text)


def test_bounded_memory_never_changes_a_result(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    text = "the quick brown fox, the lazy dog; the quickest of foxes  runs\n away " * 3
    assert small.encode(text) == WANT.encode_ordinary(text)
    assert max(len(small.fits), len(small.pieces), len(small.known), len(small.after_space)) <= 3


def test_merges_that_greedy_matching_gets_wrong():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"bcd": 258, b"abc": 259}
    codec = bpe.Codec(ranks, r"\S+")
    for text in ("abcd", "abc", "bcd", "abab", "abcbcd", "aabcdd"):
        assert codec.encode(text) == codec.merged(text.encode()), text


def test_query(spark):
    got = bpe.op3_byte_bpe(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(got) == len(docs)
    for r in docs.itertuples():
        ids = WANT.encode_ordinary(r.text or "")
        row = got.loc[r.doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_null_empty_repeated_and_no_rows(spark):
    schema = "doc_id long, text string, n_tokens string, ids string"
    docs = spark.createDataFrame([(1, None, "x", "y"), (2, "", "x", "y"), (None, "a b", "x", "y"), (3, "a b", "x", "y"), (3, "a b", "x", "y")], schema)
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN, ids=True).toPandas()
    assert len(got) == 5
    empty = got[got["doc_id"].isin([1, 2])]
    assert set(empty["n_tokens"]) == {0} and set(empty["decoded_sha256"]) == {hashlib.sha256(b"").hexdigest()}
    assert set(got[got["n_tokens"] > 0]["n_tokens"]) == {2}
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
