"""The pipeline's stages against what each should do with its own input."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import common, mixing, repetition, simhash
from tests.llm.test_operators import ROWS, SCHEMA


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute_force(rows):
    """Smallest doc_id of each group of rows linked by a Jaccard similarity of 0.8 or more."""
    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    return [None if no_id else i for no_id, i in least.values()]


def test_near_copies(spark):
    rnd = random.Random(11)
    rows, word = [], lambda: "".join(rnd.choice("abdeghilnorstu") for _ in range(6))
    for base in range(60):
        words = [word() for _ in range(200)]
        rows.append((len(rows), " ".join(words), "x"))
        for changed in (0, 1, 2, 3, 9):  # similarity 1, 0.95, 0.9, 0.86 and about 0.6
            copy = list(words)
            for k in range(changed):
                copy[20 * k + 10] = word()
            rows.append((len(rows), " ".join(copy).upper(), "x"))
    rows += [(0, rows[0][1], "y"), (None, rows[0][1], "z"), (None, None, "n"), (9000, "", "n"), (9001, "Two words", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    found = simhash.one_of_each(docs)
    assert found.columns == docs.columns
    found = [r["doc_id"] for r in found.collect()]
    want = brute_force(docs.collect())
    assert len(found) == len(set(found)) and set(want) <= set(found) and len(found) - len(want) <= 2
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_mixed_repeated_rows(spark):
    rows = [(1, "a b c d e f", "x", 1)] * 3 + [(2, "a b c d e", "x", 1)] + [(9, "q w", "y", 1)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    told = mixing.op3(docs).collect()
    out = corpus_pipeline.mixed(spark, docs, "")
    assert out.columns == docs.columns
    for text, size, source in (("a", 6, "x"), ("q", 2, "y")):
        words = sum(len(r["text"].split()) for r in out.collect() if r["source"] == source)
        target = next(r["target"] for r in told if r["source_size"] == {"x": 23, "y": 20}[source])
        assert words == sum(r["taken"] for r in told if r["target"] == target) and abs(words - target) <= 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages(spark):
    docs = common.stored(spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars"), "docs")
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, ""), "stage")
        rows = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "quality rules":
            judged = repetition.repetition(docs).filter("kept").count()
            assert len(rows) == judged
        elif name == "near-dedup":
            assert sorted(r["doc_id"] for r in rows) == sorted(brute_force(docs.collect()))
        elif name == "mixing":
            mix = mixing.mix(docs).agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.col("size")).alias("words")).first()
            assert len(rows) == mix["times"] and sum(len(r["text"].split()) for r in rows) == mix["words"]
        elif name == "tokens":
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sorted(hashlib.sha256(np.array(t.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in docs.collect())
            assert sorted(r["ids_sha256"] for r in rows) == want
        docs = out
