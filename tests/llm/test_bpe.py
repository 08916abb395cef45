"""Ids are those of the public libraries; every kind of row has a list."""

import os
import random

import pytest

from folio.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_of(bpe.vocabulary())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks_of(bpe.vocabulary()), special_tokens={})


def test_random_texts(encoder, reference):
    rnd = random.Random(5)
    alphabet = "abcdeehhiinnorsttt  \n\tééß漢字🙂0129'’.,<|endoftext|>́‍"
    for n in range(2500):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
        assert encoder.encode(t) == reference.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("t", ["a" * 5000, "漢" * 2000, "<|endoftext|>", " " * 300 + "x", "ab" * 3000, "🙂" * 100, "\n\n\n"])
def test_long_and_odd(encoder, reference, t):
    assert encoder.encode(t) == reference.encode_ordinary(t)


def test_memory_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.TextEncoder(bpe.ranks_of(bpe.vocabulary()))
    assert own.encode("one two three four five six one") == encoder.encode("one two three four five six one") and len(own.known) <= 3


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "Hello <|endoftext|>", None), (3, "Hello <|endoftext|>", None)], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_corpus(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) > 3
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_round_trip(encoder):
    back = {i: b for b, i in bpe.ranks_of(bpe.vocabulary()).items()}
    for t in ("naïve café — 12,5 %", "Вывод главы\n\nзаменяет", "x\u0000y z"):
        assert b"".join(back[i] for i in encoder.encode(t)).decode() == t
