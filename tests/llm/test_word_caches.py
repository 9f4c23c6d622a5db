"""A small cache of words gives the same ids, and holds no more words than it may."""

import random

import public_tokenizers

from lodestone.llm import bpe


def test_small_cache_gives_the_same_ids():
    content = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeABC,.'é1") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    text = " ".join(rnd.choice(words) for _ in range(3000)).encode()
    large, small = bpe.WordBpe(content), bpe.WordBpe(content, 20)
    assert small.encode(text) == large.encode(text)
    assert len(small.words) <= 20 and len(small.words.old) <= 20 and len(small.pieces) <= 20
