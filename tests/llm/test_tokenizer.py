"""Ids against the reference encoder of the vocabulary, and the round trip."""

import os
import random

import pytest

from reactionloom.llm import tokenizer as K

tiktoken = pytest.importorskip("tiktoken")
TEXTS = ["", None, "Hello  world", "<|endoftext|> it's", "a" * 5_000, "½ café́ Ⅷ 12² \x1c x", "\U0001d7d8 \U0001f58b️", "  \n\t   z", "Ελ да 第一", "x" * 70_000 + " y"]


@pytest.fixture(scope="module")
def reference():
    vocabulary = K.read_vocabulary()
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})


def test_random_texts(reference):
    rng = random.Random(5)
    enc = K.encoder(K.serialised_model(K.read_vocabulary()))
    draw = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x300), rng.randrange(0, 0x3000), rng.randrange(0xE000, 0x10FFFF), 32, 10, 39]))
    texts = ["".join(draw() for _ in range(rng.randrange(1, 15))) for _ in range(3_000)]
    for text, packed in zip(texts, enc.packed(texts), strict=True):
        assert list(memoryview(packed).cast("i")) == reference.encode_ordinary(text)


def test_encode_decode_and_counts(spark, reference):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = K.encode(docs).collect()
    assert len(ids) == len(rows)
    expected = sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((r["doc_id"], r["ids"]) for r in ids) == expected
    assert sorted(tuple(r) for r in K.token_counts(docs).collect()) == sorted((i, len(x)) for i, x in expected)
    back = K.decode(K.encode(docs)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, t or "") for i, t, _ in rows)


def test_round_trip(spark, reference):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = sorted(tuple(r) for r in K.round_trip(docs).collect())
    assert got == [(i, len(reference.encode_ordinary(t or "")), True) for i, t in enumerate(TEXTS)]


def test_empty_table(spark):
    assert K.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_vocabulary_is_not_in_the_repository():
    assert not K.VOCABULARY.startswith(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
