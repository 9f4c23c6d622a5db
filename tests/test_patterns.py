"""Containment of many patterns in many texts, and the operators on it."""

import random

import pytest

from lodestone.operators import evidence
from lodestone.plans import patterns


def made(seed=3):
    rnd = random.Random(seed)
    texts = [(i, "".join(rnd.choice("ab cé_1") for _ in range(rnd.randint(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, "abc" * 4000)]
    words = sorted({"".join(rnd.choice("ab cé_1") for _ in range(rnd.randint(1, 4))) for _ in range(150)})
    return texts, words


@pytest.mark.parametrize("limit", [patterns.LIMIT, 60])
@pytest.mark.parametrize("whole", [False, True])
def test_contained(spark, monkeypatch, limit, whole):
    """One block for all tasks, and several blocks that meet slices of the texts."""
    monkeypatch.setattr(patterns, "LIMIT", limit)
    monkeypatch.setattr(patterns, "SLICE", 5000)
    texts, words = made()
    word = lambda c: c.isalnum() or c == "_"
    alone = lambda t, w, i: not (i and word(t[i - 1])) and not (i + len(w) < len(t) and word(t[i + len(w)]))
    want = {(i, w) for i, t in texts if t for w in words if any(t.startswith(w, k) and (not whole or alone(t, w, k)) for k in range(len(t)))}
    rows = spark.createDataFrame(texts, "k long, t string")
    found = patterns.contained(rows, "k", "t", spark.createDataFrame([(w,) for w in [*words, "", None, words[0]]], "w string"), "w", whole_words=whole).collect()
    assert len(found) == len(want) and {(r["k"], r["w"]) for r in found} == want
    assert patterns.contained(rows.limit(0), "k", "t", spark.createDataFrame([("a",)], "w string"), "w").count() == 0
    assert patterns.contained(rows, "k", "t", spark.createDataFrame([], "w string"), "w").count() == 0


def test_contained_by_group(spark):
    texts = spark.createDataFrame([("title", "ml engineer"), ("comp", "ml engineer"), (None, "ml")], "type string, text string")
    wanted = spark.createDataFrame([("title", "engineer"), ("comp", "ml"), ("skill", "ml")], "type string, value string")
    found = {tuple(r) for r in patterns.contained(texts, "text", "text", wanted, "value", group="type").select("type", "text", "value").collect()}
    assert found == {("title", "ml engineer", "engineer"), ("comp", "ml engineer", "ml")}


def judged(claim, text):
    import re

    tokens = [w for w in re.findall(r"\b\w+\b", claim.lower()) if len(w) > 3]
    low, negations = text.lower(), evidence.NEGATIONS
    ratio = sum(t in low for t in tokens) / len(tokens) if tokens else 0
    if ratio < 0.3:
        return None
    best, most = "", 0
    for s in (x.strip() for x in text.replace("\n", " ").split(".") if x.strip()):
        score = sum(t in s.lower() for t in tokens)
        if score > most:
            best, most = s, score
    relation = "SUPPORTS"
    if any(n in low for n in negations) and ratio >= 0.5:
        relation = "CONTRADICTS" if any(n in best.lower() for n in negations) else relation
    elif ratio < 0.6:
        relation = "MENTIONS"
    return relation, best, "HIGH" if ratio > 0.7 else "MEDIUM"


@pytest.mark.parametrize("limit", [patterns.LIMIT, 50])
def test_claim_support(spark, monkeypatch, limit):
    """Words count inside others ("open" in "opened") and as often as the claim has them."""
    monkeypatch.setattr(patterns, "LIMIT", limit)
    rnd = random.Random(1)
    words = ["open", "opened", "factory", "large", "acme", "denied", "notes", "dubai", "with", "a", "of", "centre", "centres", "false"]
    claims = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8)))) for i in range(40)]
    claims += [(100, "Acme Corp expanding AI engineering in Dubai"), (101, "open open open factory"), (102, "a of in"), (103, None), (104, "")]
    docs = [(i, "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) + rnd.choice([".", "", " . "]) for _ in range(rnd.randint(1, 5)))) for i in range(50)]
    docs += [(200, "Acme Corp announced an expansion of its generative AI engineering center in Dubai."), (201, "Acme Corp denied and rejected reports that it is expanding its AI engineering center in Dubai."), (202, None), (203, ""), (204, "Opened.")]
    schema = "{} long, text string"
    found = evidence.claim_support(spark.createDataFrame(claims, schema.format("c")), spark.createDataFrame(docs, schema.format("d")), "c", "d").collect()
    want = {(c, d): j for c, claim in claims for d, text in docs if claim and text and (j := judged(claim, text))}
    assert {(r["c"], r["d"]): (r["relationship"], r["passage"], r["confidence"]) for r in found} == want and len(found) == len(want)
    assert want[100, 200][0] == "SUPPORTS" and want[100, 201][0] == "CONTRADICTS" and (101, 204) in want


def test_tickers(spark):
    docs = spark.createDataFrame([(1, "INFY rose. Tata Power too"), (2, "xINFY Infyx tata powers"), (3, "infy"), (4, None), (5, "It is IT")], "k long, text string")
    universe = spark.createDataFrame([("INFY", None), ("TATAPOWER", "Tata Power"), ("IT", None), (None, "infy"), ("SYM", "infy")], "symbol string, alias string")
    assert {tuple(r) for r in evidence.ticker_mentions(docs, universe, "k").collect()} == {(1, "INFY"), (1, "SYM"), (1, "TATAPOWER"), (3, "SYM")}


def test_mentions_by_alias(spark):
    entities = spark.createDataFrame([(1, "Acme Corp"), (2, "cloud"), (2, "CloudGen"), (3, None), (4, "")], "id long, alias string")
    docs = spark.createDataFrame([(1, "the ACME corporation and cloudgen"), (2, None), (3, "acmecorp")], "k long, text string")
    assert {tuple(r) for r in evidence.entity_mentions(entities, docs, "id", "k", alias="alias").collect()} == {(1, 1), (1, 2)}


def test_largest_boosts(spark):
    postings = spark.createDataFrame([(f"r{i}", f"ML Engineer {i}", "Acme" if i < 2 else "Beta", "", "") for i in range(4)], "record_id string, title string, company string, location string, skills string")
    signals = spark.createDataFrame([("u", "pos", "title", "ml engineer", 1.0), ("u", "pos", "comp", "acme", 2.0), ("v", "neg", "comp", "beta", 1.0)], "user_id string, polarity string, type string, value string, weight double")
    whole = evidence.preference_boost(postings, signals)
    assert whole.count() == 6
    assert {(r["user_id"], r["record_id"]) for r in evidence.preference_boost(postings, signals, most=1).collect()} == {("u", "r0"), ("v", "r2")}


def test_boosts_over_blocks_of_users(spark, monkeypatch):
    """Rows that share an id, users without a name, blocks of few users and values of several skills add up as pair by pair."""
    monkeypatch.setattr(evidence, "USERS", 2)
    rnd = random.Random(4)
    jobs = [(rnd.choice([None, *"abcdefgh"]), rnd.choice(["ML Engineer", "Senior ml engineer ", "Chef", None]), rnd.choice(["Acme", "Acme Labs", None]), rnd.choice(["Dubai", "Remote", "", None]), rnd.choice(["sql, k8s ,K8S", "docker,k8s", "sql,  sql", "", None])) for _ in range(14)]
    values = {"title": ["ml engineer", "chef"], "comp": ["acme", "labs"], "loc": ["dubai", "remote"], "skill": ["sql", "k8s", "docker,k8s", "k"], "ind": ["retail"]}
    signals = list({(u, pol, t, v): (u, pol, t, v, rnd.choice([0.5, 3.0, 9.0])) for u in [None, *"pqrst"] for t, vs in values.items() for v in vs for pol in ("pos", "neg") if rnd.random() < 0.3}.values())
    got = evidence.preference_boost(spark.createDataFrame(jobs, "record_id string, title string, company string, location string, skills string").repartition(3), spark.createDataFrame(signals, "user_id string, polarity string, type string, value string, weight double"))
    assert not [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(user_id" in line]
    factor, want = {(p, t): (f, cap) for p, t, f, cap in evidence.BOOSTS}, {}
    for r in {j[0] for j in jobs}:
        held = {(t, x) for j in jobs if j[0] == r for t, x in [("title", j[1]), ("comp", j[2]), ("loc", j[3]), *(("skill", s) for s in (j[4] or "").split(","))]}
        for u, pol, t, v, w in signals:
            if any(k == t and v in (x or "").lower().strip() for k, x in held):
                f, cap = factor.get((pol, t), (0.0, 0.0))
                want[u, r] = want.get((u, r), 0.0) + min(w * abs(f), cap) * (1 if f > 0 else -1)
    found = {(x["user_id"], x["record_id"]): x["boost"] for x in got.collect()}
    assert found == pytest.approx({k: max(-0.25, min(0.25, b)) for k, b in want.items()}) and len(found) > 20


def test_texts_are_read_in_parts(spark, monkeypatch):
    """No more than PART bytes of texts, or one text, become strings at once."""
    batch = patterns.pa.RecordBatch.from_pydict({"text": ["a" * 60, None, "b" * 60, "", "c" * 300, "é" * 20, "d"]})
    monkeypatch.setattr(patterns, "PART", 100)
    cut = [p.column("text").to_pylist() for p in patterns.parts(batch, "text")]
    assert sum(cut, []) == batch.column("text").to_pylist() and [len(p) for p in cut] == [2, 2, 1, 2]
    texts, words = made()
    docs = spark.createDataFrame([(i, t * 30 if t else t) for i, t in texts], "id long, text string")
    seen = {(r["id"], r["w"]) for r in patterns.contained(docs, "id", "text", spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    assert seen == {(i, w) for i, t in texts if t for w in words if w in t * 30}
