"""Byte pair encoding against a plain merge loop, a public implementation, and its own inverse."""

import base64
import random

import pytest

from tidegate.llm import tokens

PATH = tokens.vocabulary()
pytest.importorskip("regex")


@pytest.fixture(scope="module")
def encoder():
    return tokens.BytePairEncoder(PATH)


def brute(ranks, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            return tuple(ranks[p] for p in parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_words_against_brute_force(encoder):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeinorst ' é€") for _ in range(r.randrange(1, 40))).encode() for _ in range(400)]
    words += [b"a" * n for n in (1, 2, 3, 63, 64, 65, 257)] + [bytes(range(256))]
    for w in words:
        assert encoder.encode_word(w) == brute(encoder.ranks, w)


def test_texts_against_a_public_implementation(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    back = {v: k for k, v in encoder.ranks.items()}
    for text in ["", " ", "\n\n  x", "It's 1999: naïve café — «Надежда»", "<|endoftext|>", "a" * 5000, "x­\ny", "日本語 テスト", "\x00\x1f", "a" * 40 + " " * 99]:
        ids = encoder.encode(text)
        assert ids == public.encode_ordinary(text)
        assert b"".join(back[i] for i in ids).decode() == text
    assert encoder.encode(None) == []


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 10)
    e = tokens.BytePairEncoder(PATH)
    text = " ".join(f"word{i}" for i in range(200))
    assert e.encode(text) == e.encode(text) and len(e.memory) <= 10


def test_documents(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0), (4, "  ", 0), (1, "hello world", 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_documents(df).collect())
    e = tokens.BytePairEncoder(PATH)
    assert got == sorted([(1, e.encode("hello world"))] * 2 + [(2, []), (3, []), (4, e.encode("  "))])
    assert tokens.encode_documents(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0, 4: len(e.encode("  "))}
    with open(PATH, "rb") as f:
        assert base64.b64decode(f.readline().split()[0])
