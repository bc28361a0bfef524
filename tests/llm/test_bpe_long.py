"""Long runs through the recursive queries, against tiktoken; a worker's memory of words is bounded."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from mealops.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
R = random.Random(5)
TEXTS = {"one letter": "x" * 100_000, "two letters": "ab" * 30_000, "spaces": " " * 10_000, "signs": "=" * 1000 + "-" * 777,
         "overlaps": "aaaab" * 777, "letters": "".join(R.choice("est") for _ in range(3000)),
         "syllables": "".join(R.choice(("th", "er", "on", "an", "re", "he", "in")) for _ in range(2000)),
         "mixed case": "".join(R.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(20_000)),
         "no spaces": "".join(R.choice("日本語漢字かなカナ東京都") for _ in range(5000))}


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.mark.parametrize("name", TEXTS)
def test_long_words(ranks, name):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(PATH, 200, 20_000, 128, 400_000)
    words = regex.findall(public_tokenizers.PATTERN, TEXTS[name])
    own.learn(set(words))
    assert np.frombuffer(b"".join(own.known[w] for w in words), "<u4").tolist() == enc.encode_ordinary(TEXTS[name])


def test_both_queries_agree(ranks):
    words = {"".join(R.choice(("th", "er", "on", "a", "re", "h", "in", "ed", "s", "t")) for _ in range(R.randint(1, 12)))
             for _ in range(2000)}
    short, long = (bpe.Encoder(PATH, 200, 20_000, n, 400_000) for n in (128, 0))
    short.learn(words)
    long.learn(words)
    assert short.known == long.known


def test_words_are_forgotten_by_generation():
    own = bpe.Encoder(PATH, 200, 20_000, 128, 100)
    for i in range(10):
        words = {f" kept{n}" for n in range(10)} | {f" zq{i}xv{n}" for n in range(30)}
        own.learn(words)
        assert words <= set(own.known) and len(own.known) + len(own.older) <= 100
