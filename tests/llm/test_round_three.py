"""Clustering, fill-in-middle and token counts against brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import clustering, fill_middle, token_counts
from tests.llm.test_operators import ROWS, SCHEMA, by_id, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def lloyd(vectors, k, rounds, seed=2):
    """Exhaustive search: (vec_id, vector, cluster, distance) and the centroids."""
    ranked = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"{seed}:{v[0]}".encode()).hexdigest(), v[1]))
    cents = [list(v[1]) for v in ranked[:k]]
    for step in range(rounds + 1):
        found = [(i, x, *min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))[::-1]) for i, x in vectors]
        if step < rounds:
            for j in range(len(cents)):
                own = [x for _, x, c, _ in found if c == j]
                if own:
                    cents[j] = [sum(col) // len(own) for col in zip(*own)]
    return found, cents


def made_vectors(dims=64):
    rnd = random.Random(3)
    hubs = [[rnd.gauss(0, 0.2) for _ in range(dims)] for _ in range(6)]
    out = [(i, [float(np.float32(rnd.gauss(a, 0.02 + 0.1 * (i % 3)))) for a in hubs[i % 6]]) for i in range(400)]
    out += [(400 + i, list(out[5][1])) for i in range(150)]  # a large group of copies
    out += [(7, [0.25] * dims), (7, [-0.25] * dims), (None, [0.5] * dims), (None, [0.5] * dims)]  # repeated and null ids
    out += [(900 + i, [(-1.0) ** i / 256] * dims) for i in range(6)]  # ties between the two sides
    bad = [(600, None), (601, []), (602, [0.1] * 63), (603, [0.1] * 65), (604, [None] * dims), (605, [float("nan")] * dims), (606, [float("inf")] + [0.0] * (dims - 1))]
    return out, bad


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "y", "z") for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("k,groups", [(40, 20), (40, 40), (7, 3), (1, 1)])
def test_clustering_matches_exhaustive_search(spark, k, groups):
    good, bad = made_vectors()
    want, cents = lloyd([(i, [int(np.floor(256 * c)) for c in v]) for i, v in good], k, 5)
    done, found = clustering.cluster_vectors(table(spark, good + bad), k=k, groups=groups)
    assert found.tolist() == cents
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in done.collect()), key=str)
    assert got == sorted(((i, c, d) for i, _, c, d in want), key=str)


def test_clustering_digest(spark):
    good, bad = made_vectors()
    want, cents = lloyd([(i, [int(np.floor(256 * c)) for c in v]) for i, v in good], 40, 5)
    inertia = {}
    for _, _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    for r in clustering.op11(table(spark, good + bad)).collect():
        c = r["cluster"]
        assert (r["cluster_inertia"], r["inertia"]) == (inertia[c], sum(inertia.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()


def test_bounds_skip_distances():
    """Ns-bounds keep settled vectors apart without an exact distance, and are never looser than sums of drifts."""
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.integers(-5, 6, (300, 8)) + shift for shift in (-200, 0, 200)])
    cents = x[[0, 300, 600]].copy()
    history, state = cents[None], clustering.Rounds(cents[None], 3).first(x)
    for step in range(4):
        cents = cents + np.array([[(-1) ** step * 3] * 8] * 3)  # back and forth: the total displacement stays small
        history = np.concatenate([history, cents[None]])
        rounds = clustering.Rounds(history, 3)
        assert rounds.moved[0].max() <= 3 * 8**0.5
        calls = []
        rounds.scan = lambda x, g: calls.append(g)
        state = rounds.assign(x, *state)
        assert not calls and (state[0] == np.repeat([0, 1, 2], 300)).all()


def test_clustering_edges(spark):
    assert clustering.op11(table(spark, [])).count() == 0
    assert clustering.op11(table(spark, made_vectors()[1])).count() == 0
    few = clustering.op11(table(spark, [(1, [0.0] * 64), (1, [0.0] * 64), (2, [1.0] * 64)])).collect()
    assert len(few) == 3 and {r["distance"] for r in few} == {0}
    far = clustering.op11(table(spark, [(i, [2000.0 * (i % 3)] * 64) for i in range(60)])).collect()  # beyond what doubles hold exactly
    assert len(far) == 60 and {r["distance"] for r in far} == {0}
    with pytest.raises(Exception, match="beyond"):
        clustering.op11(table(spark, [(1, [1e30] * 64)])).collect()


# --- fill-in-middle -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[], [0], [5, 9, 70000], list(range(100, 9000)), list(range(0, 60000, 3)), list(range(65530, 65600)) + list(range(200000, 270000, 2)) + [1 << 24]])
def test_boundary_set(values):
    found = fill_middle.BoundarySet(np.array(values, dtype=np.int64))
    assert len(found) == len(values) and [found.select(i) for i in range(len(values))] == values


def test_containers():
    kind = lambda v: type(fill_middle.container(np.array(v))).__name__
    assert [kind(range(5000)), kind(range(0, 9000, 2)), kind([1, 5, 9])] == ["RunPart", "BitmapPart", "ArrayPart"]


def filled(text, key):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark):
    rnd = random.Random(9)
    made = ["", " ", "a", "a <P> b", "<<S", "x<", "< S> y", "é 日本\t z ", "word " * 50000, "  lead"]
    rows = [(i, rnd.choice(made) + rnd.choice(made), "keep", 4) for i in range(300)] + [(None, "a b c", None, None), (5, None, None, None), (5, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, n int").repartition(3)
    whole = fill_middle.fill_in_middle(docs).collect()
    assert len(whole) == len(rows)
    for r in whole:
        text = r["text"] or ""
        want = filled(text, "" if r["doc_id"] is None else r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want and r["restored"] == text
    digests = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fill_middle.op12(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == {(r["doc_id"], sha(r["output"]), sha(r["text"] or "")) for r in whole}
    assert fill_middle.op12(docs.limit(0)).count() == 0


# --- token counts -------------------------------------------------------------------------------------------------


def test_token_counts_match_library(docs):
    lib = Tokenizer.from_file(PATH)
    for r, (i, x) in zip(by_id(token_counts.op13(docs, PATH)), texts()):
        n = len(lib.encode(x, add_special_tokens=False).ids)
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) == (i, len(x.encode()), n, n > 512)
    assert token_counts.op13(docs.limit(0), PATH).count() == 0


@pytest.fixture(scope="module")
def counter():
    content = open(PATH, encoding="utf-8").read()
    return token_counts.Counter(content, token_counts.classes_of(content))


def made_texts():
    rnd = random.Random(1)
    marks = " \n\t\x0b 　'strevmlld12!?éß日本xyz"
    out = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    out += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(200)) for _ in range(100)]
    out += ["x" * 70000, "ab" * 9000, " " * 3000, "'s" * 700, "''s 's's 'save'll", "日本" * 2000, "", "a\n\n b \n", "end  "]
    return out + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b  <|endoftext|>", "<|endoftext<|endoftext|>", " <|endoftext|>  x"]


def test_token_counts_of_odd_texts(counter):
    made = made_texts()
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(made, add_special_tokens=False)]
    assert counter.counts(made).tolist() == want


def test_token_counts_with_full_table(counter, monkeypatch):
    """A table that starts afresh over and over, and blocks of few chunks, change nothing."""
    made = made_texts()[::5]
    want = counter.counts(made).tolist()
    monkeypatch.setattr(token_counts, "STATES", 150)
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    assert counter.counts(made).tolist() == want


def test_stable_pairs(counter):
    """The border walk gives what encoding both tokens' bytes together gives."""
    t, rnd = counter.bytes, random.Random(5)
    ids = [i for i, b in t.bytes_of.items() if len(b) <= 6]
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(3000)]
    pairs += [(t.id_of[b[:k]], t.id_of[b[k:]]) for b in list(t.id_of)[::20] for k in range(1, len(b)) if b[:k] in t.id_of and b[k:] in t.id_of]
    assert all(t.fits(a, b) == (t.encoded(t.bytes_of[a] + t.bytes_of[b]) == [a, b]) for a, b in pairs)
