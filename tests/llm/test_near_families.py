"""The pipeline's near-dedup on lone pairs and on families of look-alikes, against all pairs by brute force."""

import random

import pytest

from lodestone.llm import simhash
from tests.llm.test_pipeline import brute_force


def word(rnd):
    return "".join(rnd.choice("abdeghilnorstu") for _ in range(6))


def family(rnd, n, words, changes):
    """n texts that differ from one base at that many places each (a place costs five shingles)."""
    base = [word(rnd) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rnd.sample(range(words // 6), changes):
            copy[6 * k + 2] = word(rnd)
        out.append(" ".join(copy))
    return out


def checked(spark, texts, recall):
    rows = [(i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found, want = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}, set(brute_force(docs.collect()))
    gone = len(rows) - len(want)
    assert want <= found  # none goes that has no near copy before it
    assert len(rows) - len(found) >= recall * gone and gone


def test_lone_pairs_above_the_limit(spark):
    """Pairs at a similarity of 0.80 to 0.85."""
    rnd = random.Random(2)
    texts = []
    for k in range(150):
        base = [word(rnd) for _ in range(230)]
        copy = list(base)
        for i in range(4 + k % 2):  # 206 or 201 of 246 or 251 shingles
            copy[40 * i + 20] = word(rnd)
        texts += [" ".join(base), " ".join(copy)]
    checked(spark, texts, 0.9)


@pytest.mark.parametrize("size,copies", [(24, 12), (80, 3), (300, 1)])
def test_families_of_look_alikes(spark, size, copies):
    """Most pairs of a family lie between 0.6 and 0.8, some above: links have to be found among them."""
    rnd = random.Random(size)
    texts = [t for _ in range(copies) for t in family(rnd, size, 240, 4)]
    checked(spark, texts, 0.95)


def test_parts_of_a_large_component(spark, monkeypatch):
    """A component that is split into parts gives what it gives in one."""
    monkeypatch.setattr(simhash, "SHINGLES", 3000)
    checked(spark, family(random.Random(5), 60, 240, 4) + family(random.Random(6), 40, 240, 2), 0.95)


def test_equal_fingerprints(spark):
    """Different texts with one fingerprint: order of the words' shingles doesn't tell them apart."""
    rnd = random.Random(8)
    parts = [" ".join(word(rnd) for _ in range(30)) for _ in range(3)]
    texts = [" ".join([parts[0], parts[1]] * 9), " ".join([parts[0], parts[1]] * 10), " ".join([parts[2]] * 4), " ".join([parts[2]] * 5)]
    checked(spark, texts, 1.0)
