"""Ordered rules worked out in rounds, against the rules read one record after the other."""

import random
import re

import pytest

from lodestone.operators import news, resolve

FIELDS = "record_id string, seq long, title string, company string, location string, city string, source string, job_id string, identity_key string, url string, application_url string"


def close(a, b):
    if not a or not b:
        return True
    x, y = (re.sub("[^a-z0-9]", "", t.lower()) for t in (a, b))
    p, q = (set(re.findall("[a-z0-9]+", t.lower())) - set(resolve.TITLE_NOISE) for t in (a, b))
    if x == y or ((x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.75):
        return True
    return not p or not q or len(p & q) / len(p | q) >= 0.5


def replay(rows):
    """rows: (record_id, title, keys) in order."""
    holder, out = {}, {}
    for record, title, keys in rows:
        found = next((holder[k] for k in keys if k in holder and close(title, holder[k][1])), None)
        for k in keys:
            if found:
                holder.setdefault(k, found)
            else:
                holder[k] = (record, title)
        out[record] = found[0] if found else record
    return out


def made_records(seed):
    rnd = random.Random(seed)
    titles = ["Data Engineer", "Senior Data Engineer", "Data Platform Engineer", "Platform Engineer", "Platform Operations Lead", "Chef", "", None, "日本", "ML Engineer - Applied AI", "Applied AI Engineer", "of the"]
    rows = []
    for i in range(700):
        hot = rnd.random() < 0.4  # a company with a large share of all records
        rows.append((
            f"r{i}", i * 3, rnd.choice(titles), "Hot Corp" if hot else rnd.choice(["Acme", "Beta", "unknown", "", None]), rnd.choice(["Riyadh", "Dubai", None]), rnd.choice(["Amman", None]), rnd.choice(["x", "Y", ""]),
            rnd.choice([None, "", f"j{rnd.randint(0, 60)}"]), rnd.choice([None, " ", f"K{rnd.randint(0, 90)}"]), rnd.choice([None, "", f"https://o.org/p/{rnd.randint(0, 50)}?utm_source=a", "https://acme.org/careers"]), rnd.choice([None, f"https://o.org/p/{rnd.randint(0, 50)}"]),
        ))
    return rows


@pytest.mark.parametrize("hot", [4096, 5])
@pytest.mark.parametrize("keys", ["record_keys", "posting_keys"])
def test_dedupe_equals_replay(spark, monkeypatch, hot, keys):
    monkeypatch.setattr(resolve, "HOT", hot)
    df = spark.createDataFrame(made_records(hot), FIELDS).repartition(5)
    keyed = getattr(resolve, keys)(df)
    want = replay([(r["record_id"], r["title"], r["keys"]) for r in sorted(keyed.collect(), key=lambda r: r["seq"])])
    assert {r["record_id"]: r["primary_id"] for r in resolve.dedupe_by_keys(keyed).collect()} == want


def test_dedupe_chain_of_titles(spark):
    """Titles compatible with their neighbours only: each status hangs on the one before."""
    words = [f"w{i}" for i in range(16)]
    rows = [(f"r{i}", i, " ".join(words[i : i + 3]), "Acme", None, None, None, None, "same", None, None) for i in range(14)]
    df = spark.createDataFrame(rows, FIELDS)
    keyed = resolve.record_keys(df)
    want = replay([(r["record_id"], r["title"], r["keys"]) for r in sorted(keyed.collect(), key=lambda r: r["seq"])])
    assert {r["record_id"]: r["primary_id"] for r in resolve.dedupe_records(df).collect()} == want
    assert resolve.dedupe_records(df.limit(0)).count() == 0


def test_keys_in_order(spark):
    row = ("r", 1, "Data Engineer", "Acme", "Riyadh", "Amman", "Src", "J1", " ID ", "https://o.org/p/1", "https://o.org/p/2")
    df = spark.createDataFrame([row, ("e", 2, *[None] * 9)], FIELDS)
    found = {r["record_id"]: r["keys"] for r in resolve.record_keys(df).collect()}
    fp = ["fp::acme::dataengineer::riyadh", "fpt::acme::dataengineer::"]
    assert found == {"r": ["ident::id", "sid::src::j1", "url::https://o.org/p/1", "link::https://o.org/p/1", "app::https://o.org/p/2", "link::https://o.org/p/2", *fp], "e": ["id::e"]}
    typed = {r["record_id"]: r["keys"] for r in resolve.posting_keys(df).collect()}
    assert typed["r"] == ["sid::src::j1", "app::https://o.org/p/2", "url::https://o.org/p/1", fp[0], "fp_city::acme::dataengineer::amman", fp[1]]


def first_fit(rows):
    heads, out = [], {}
    for seq, title in rows:
        own = set(re.findall(r"\b[a-zA-Z]{4,}\b", (title or "").lower()))
        hit = next((h for h, t in heads if len(own & t) >= 3 or (own and len(own & t) / len(own) >= 0.5)), None)
        if hit is None:
            heads.append((seq, own))
        out[seq] = seq if hit is None else hit
    return out


def test_first_fit(spark):
    rnd = random.Random(4)
    words = ["market", "update", "daily"] + ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(70)]
    rows = [(i * 2, " ".join(rnd.choice(words[:3] if rnd.random() < 0.35 else words) for _ in range(rnd.randint(0, 9)))) for i in range(600)]
    rows += [(5000 + i, rows[i][1].upper()) for i in range(60)] + [(9001, None), (9002, "a-b é1234 straße wordé"), (9003, "Market's update_daily x")]
    found = news.cluster_news(spark.createDataFrame(rows, "seq long, title string").repartition(5))
    assert {r["seq"]: r["cluster"] for r in found.collect()} == first_fit(rows)
    assert news.cluster_news(spark.createDataFrame([], "seq long, title string")).count() == 0


def test_first_fit_chain(spark):
    """Each title shares three words with its neighbour only, so items wait for each other."""
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(300)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 6])) for i in range(12)]
    assert {r["seq"]: r["cluster"] for r in news.cluster_news(spark.createDataFrame(rows, "seq long, title string")).collect()} == first_fit(rows)


def test_news_events(spark):
    rows = [
        (1, "Acme Corp acquires CloudGen for strategic expansion", "The strategic acquisition of CloudGen.", "https://r.com/1", "2026-03-10", ["Acme", "CloudGen"]),
        (2, "CloudGen acquired by Acme Corp in strategic expansion", "CloudGen has entered into a definitive merger agreement.", "https://b.com/2", "2026-03-10", ["CloudGen", "Beta"]),
        (3, "Unrelated: rain", None, None, None, None), (4, None, None, "https://x.org", "10/03/2026", []), (5, "CloudGen acquired by Acme Corp in strategic expansion", "", "https://b.com/2", None, None),
    ]
    df = spark.createDataFrame(rows, "seq long, title string, summary string, url string, date string, entities array<string>")
    found = {r["cluster"]: r.asDict() for r in news.news_events(df, "2026-03-12 00:00:00").collect()}
    assert sorted(found) == [1, 3, 4]
    one = found[1]
    assert one["sources"] == ["https://r.com/1", "https://b.com/2"] and one["entities"] == ["Acme", "CloudGen", "Beta"] and one["summary"].startswith("CloudGen has") and one["articles"] == 3
    assert (one["impact"], one["sentiment"], one["freshness"], one["confidence"]) == ("high", "positive", "AGING", 0.9)
    assert (found[3]["summary"], found[3]["impact"], found[3]["freshness"], found[3]["confidence"]) == ("Unrelated: rain", "low", "UNKNOWN", 0.7)
    assert (found[4]["title"], found[4]["summary"], found[4]["freshness"]) == (news.UNTITLED, "", "AGING")
