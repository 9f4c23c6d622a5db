"""Small fixed inputs with known results."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.operators import evidence, listings, news, postings, resolve, series
from lodestone.plans.components import connected_components
from lodestone.sources import payloads, sections, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("wanted", "actual", "status"), [
    (("Saudi Arabia",), "Riyadh, KSA", "MATCH"), (("UAE",), "Abu Dhabi", "MATCH"), ((), "anywhere", "MATCH"), (("UAE",), "", "UNKNOWN"), (("UAE",), "not specified", "UNKNOWN"),
    (("UAE",), "Timbuktu Province", "UNKNOWN"), (("Saudi Arabia",), "remote", "UNKNOWN"), (("UAE",), "London, United Kingdom", "MISMATCH"), (("UAE",), "Bangalore, India", "MISMATCH"), (("UAE",), "Denver, CO (Remote)", "MISMATCH"),
])
def test_locations(spark, wanted, actual, status):
    assert one(spark, postings.location_status(F.lit(actual), postings.JobSpec(locations=wanted))) == status


@pytest.mark.parametrize(("url", "tier"), [("https://boards.greenhouse.io/x", 1), ("https://JOBS.LEVER.CO/x", 1), ("https://www.bayt.com/x", 2), ("https://www.linkedin.com/jobs/1", 3), ("https://blog.example.org", 4)])
def test_tiers(spark, url, tier):
    assert one(spark, c.search_tier(F.lit(url))) == tier


@pytest.mark.parametrize(("url", "canonical"), [
    ("HTTP://www.Example.com/a/b/?b=2&utm_source=x&a=1#top", "https://example.com/a/b?a=1&b=2"), ("https://x.org/", "https://x.org/"), ("", ""), ("https://x.org/p?q=a%20b&r=", "https://x.org/p?q=a+b"),
])
def test_canonical(spark, url, canonical):
    assert one(spark, c.canonical_url(F.lit(url))) == canonical


def test_yield(spark):
    rows = spark.createDataFrame([("a", 10, 10), ("b", 10, 0), ("c", 20, 10), ("d", 0, 0), ("e", 3, 1)], "g string, hits long, new long")
    assert {r["g"]: r["yield"] for r in series.search_yield(rows, ["g"], "hits", "new").collect()} == {"a": 1.0, "b": 0.0, "c": 0.5, "d": 0.0, "e": 0.333}


def bars(spark, closes):
    return spark.createDataFrame([("s", i, float(x), float(x) + 1, float(x) - 1, 100.0) for i, x in enumerate(closes)], "symbol string, ts long, close double, high double, low double, volume double")


def test_indicators(spark):
    flat, up = bars(spark, [100.0] * 25), bars(spark, range(1, 21))
    assert series.ema(flat, 20).first()["ema"] == pytest.approx(100) and series.ema(bars(spark, [10, 20]), 20).first()["ema"] is None
    assert series.sma(up, 20).orderBy(F.desc("ts")).first()["sma"] == 10.5
    assert series.rsi(up).first()["rsi"] > 80 and series.rsi(bars(spark, range(20, 0, -1))).first()["rsi"] < 20 and series.rsi(bars(spark, [1, 2])).first()["rsi"] is None
    assert series.weekly_return(bars(spark, [100, 101, 102, 103, 105])).first()["change"] == pytest.approx(5.0)
    line = series.macd(bars(spark, range(1, 41))).first()
    assert line["line"] > 0 and line["signal"] is not None


def test_recursions_equal_closed_forms(spark):
    closes = [10, 12, 11, 15, 14, 18, 17, 16, 20, 22, 21, 19, 23, 25, 24, 26, 28, 27]
    m, e = 2 / 6, sum(closes[:5]) / 5
    for x in closes[5:]:
        e = m * x + (1 - m) * e
    assert series.ema(bars(spark, closes), 5).first()["ema"] == pytest.approx(e)
    gains = [max(b - a, 0) for a, b in zip(closes, closes[1:])]
    losses = [max(a - b, 0) for a, b in zip(closes, closes[1:])]
    g, d = sum(gains[:14]) / 14, sum(losses[:14]) / 14
    for x, y in zip(gains[14:], losses[14:]):
        g, d = (g * 13 + x) / 14, (d * 13 + y) / 14
    assert series.rsi(bars(spark, closes)).first()["rsi"] == pytest.approx(100 - 100 / (1 + g / d))


RECORD = "record_id string, seq long, title string, company string, location string, source string, url string, application_url string"


def test_dedupe(spark):
    rows = [("a", 1, "Data Engineer", "Acme", "Dubai", "x", "https://boards.greenhouse.io/acme/jobs/1", None), ("b", 2, "Data Engineer", "Acme", "Dubai", "y", "https://boards.greenhouse.io/acme/jobs/1", None), ("c", 3, "Chef", "Other", "Rome", "z", "https://o.org/p/9", None)]
    rows += [(f"d{i}", 10 + i, t, None, None, "z", "https://acme.org/careers", None) for i, t in enumerate(("Cook", "Nurse", "Pilot"))]
    out = {r["record_id"]: r["primary_id"] for r in resolve.dedupe_records(spark.createDataFrame(rows, RECORD)).collect()}
    assert out == {"a": "a", "b": "a", "c": "c", "d0": "d0", "d1": "d1", "d2": "d2"}


def test_dedupe_does_not_depend_on_partitions(spark):
    rows = [(str(i), i, ("Data Engineer", "Chef", "ML Engineer")[i % 3], f"C{i % 4}", f"L{i % 5}", "x", f"https://o.org/p/{i % 7}", None) for i in range(60)]
    df = spark.createDataFrame(rows, RECORD)
    first = sorted(map(tuple, resolve.dedupe_records(df.repartition(1)).collect()))
    assert first == sorted(map(tuple, resolve.dedupe_records(df.repartition(7)).collect()))


def test_contradictions(spark):
    rows = [("e", 1, "margin", "15%", "a"), ("e", 2, "Margin", "11%", "b"), ("e", 3, "hq", "Riyadh", "a"), ("e", 4, "hq", "riyadh", "b")]
    assert evidence.contradictions(spark.createDataFrame(rows, "entity_id string, seq long, field string, value_text string, source string")).count() == 1


def test_facts(spark):
    text = "Revenue of ₹1,200 crore. Operating margin of 18%. Net income $40 million. Headcount of 5,000. Salary: 12 LPA"
    out = {r["field"]: r["unit"] for r in evidence.extract_facts(spark.createDataFrame([(1, text), (2, None)], "k long, text string"), "k").collect()}
    assert (out["revenue"], out["operating_margin"], out["net_profit"], out["salary"]) == ("₹ crore", "%", "USD million", "LPA")


def test_claims(spark):
    claims = spark.createDataFrame([(1, "the company opened a large factory")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "The company opened a large factory in May"), (2, "The company denied that it opened a large factory"), (3, "other words")], "doc_id long, text string")
    out = {r["doc_id"]: r["relationship"] for r in evidence.claim_support(claims, docs, "item_id", "doc_id").collect()}
    assert out == {1: "SUPPORTS", 2: "CONTRADICTS"}


def test_companies(spark):
    rows = [(1, "Acme Ltd", "www.acme.com", None), (2, "Acme Inc.", "acme.com", None), (3, "Acme Ltd", "other.com", None), (4, "Beta Ltd", None, None), (5, "beta", None, None)]
    out = {r["key"]: r["n"] for r in resolve.resolve_companies(spark.createDataFrame(rows, "seq long, name string, domain string, symbol string")).collect()}
    assert out == {"domain::acme.com": 2, "domain::other.com": 1, "name::beta": 2}


def test_news(spark):
    rows = [(1, "Acme completes acquisition of Beta"), (2, "Beta acquisition by Acme completes today"), (3, "Rain expected tomorrow")]
    out = {r["seq"]: r["cluster"] for r in news.cluster_news(spark.createDataFrame(rows, "seq long, title string")).collect()}
    assert out == {1: 1, 2: 1, 3: 3}


def test_csv_cells(spark):
    df = spark.createDataFrame([("=cmd|x", "@dangerous", "ok")], "a string, b string, c string")
    assert tuple(listings.csv_cells(df, ["a", "b", "c"]).first()) == ("'=cmd|x", "'@dangerous", "ok")


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (5, 5), (None, 3)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_hard_filter(spark):
    rows = [("1", 1, "GenAI Engineer", "A", "Riyadh", "Python"), ("2", 2, "GenAI Engineer", "B", "Berlin", "Python"), ("3", 3, "GenAI Engineer", "C", "Dubai", "Java")]
    raw = spark.createDataFrame(rows, "record_id string, seq long, title string, company string, location string, skills string").selectExpr("*", "CAST(NULL AS STRING) AS salary", "CAST(NULL AS STRING) AS experience", "CAST(NULL AS DOUBLE) AS confidence", "CAST(NULL AS BIGINT) AS posted_age_seconds")
    good, bad = postings.hard_filter(postings.normalize_postings(raw), postings.JobSpec(title="GenAI Engineer", locations=("Saudi Arabia", "UAE"), skills=("Python",)))
    assert [r["record_id"] for r in good.collect()] == ["1"] and bad.count() == 2


def test_page_text(spark):
    posting = '{"@type": "JobPosting"}'
    html = f'''<html><head><title>A &amp; B</title><meta name="description" content=" d "><meta property="og:description" content="later"><meta name="twitter:url" content="https://x.org/">
<script type="application/ld+json"> {posting} </script><script type="application/ld+json">{{"a": 1}}</script><script>x</script></head>
<body><nav>menu</nav><div class="ads-box">buy</div><div id="Newsletter-1">mail</div><div class="ad">kept</div><h1>Head</h1><p>Main <b>text</b>.</p><pre>a = 1
  b</pre></body></html>'''
    long = f"<html><head><meta property='og:title' content='O'></head><body>out<article><p>{'word ' * 50}</p></article><div class='content'>other</div></body></html>"
    rows = payloads.page_text(spark.createDataFrame([(1, html), (2, None), (3, long), (4, "<h1>One</h1><main>short</main>after<h1>Two</h1>"), (5, "<pre>open <b>code"), (6, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert (rows[0]["title"], rows[0]["meta"], rows[0]["snippets"]) == ("A & B", {"description": "d", "url": "https://x.org/"}, [posting])
    assert rows[0]["text"] == "A & B\nkept\nHead\nMain\ntext\n.\n```python\na = 1\nb\n```"
    assert (rows[2]["title"], rows[2]["text"]) == ("O", ("word " * 50).strip()) and (rows[3]["title"], rows[3]["text"]) == ("One", "One\nshort\nafter\nTwo")
    assert rows[4]["text"] == "```python\nopen code\n```" and [tuple(rows[i])[1:] for i in (1, 5)] == [("", {}, [], "")] * 2
    headed = payloads.with_metadata(payloads.page_text(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))).orderBy("page_id").collect()
    assert headed[0]["text"].startswith(f"--- STRUCTURED JOB SCHEMA (JSON-LD) ---\n{posting}\n--- END STRUCTURED SCHEMA ---\n\n--- STRUCTURED PAGE METADATA ---\nDESCRIPTION: d\nURL: https://x.org/\n--- END PAGE METADATA ---\n\nA & B") and headed[1]["text"] == ""


def test_claim_passages(spark):
    told = "A description of the page that is long enough to be a claim"
    menu = "Home\n" * 12
    text = f"--- STRUCTURED PAGE METADATA ---\nTITLE: t\nDESCRIPTION: {told}\n--- END PAGE METADATA ---\n\n{told}\n\nRead our privacy policy before you go any further here\n\n{menu}\n\nThe first paragraph\nspeaks of  joins and of little else\n\nThe second tells of the overhead {'x' * 400}\n\ntoo short"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Short")], "doc_id long, text string")
    rows = evidence.claim_passages(docs, "doc_id").orderBy("place").collect()
    assert [tuple(r) for r in rows] == [(1, 1, told, False), (1, 2, "The first paragraph speaks of joins and of little else", False), (1, 3, "The second tells of the overhead " + "x" * 400, True)]
    cut = evidence.claim_passages(docs, "doc_id", most=3, width=300).filter("place = 3").first()["claim"]
    assert len(cut) == 300 and cut.endswith("x...")
    assert evidence.claim_passages(docs, "doc_id", most=2).count() == 2 and evidence.claim_passages(docs.limit(0), "doc_id").count() == 0


def test_contact_points(spark):
    hits = spark.createDataFrame([("a", 1, "https://a.org/about", "Info@a.org, joe@a.org and jobs@a.org", "a.org/"), ("a", 2, "https://a.org/x", "info@a.org", "a.org/"), ("b", 3, None, None, None), ("c", 4, "https://c.org/Careers", None, "")], "entity string, seq long, url string, text string, own string")
    rows = evidence.contact_points(hits, "entity", "seq", "own").orderBy("entity", "place").collect()
    assert [(r["entity"], r["kind"], r["value"], r["place"]) for r in rows] == [("a", "page", "https://a.org/contact", 1), ("a", "page", "https://a.org/about", 2), ("a", "email", "info@a.org", 3), ("a", "email", "jobs@a.org", 4), ("c", "page", "https://c.org/Careers", 1)]
    assert {r["source"] for r in rows if r["kind"] == "email"} == {"https://a.org/about"} and evidence.contact_points(hits, "entity", "seq", most=1).count() == 2


@pytest.mark.parametrize(("location", "shown"), [
    (None, "Remote / Unspecified"), (" Unspecified", "Remote / Unspecified"), ("['Dubai']", "Dubai"), ("[]", "Remote / Unspecified"),
    ("{'@type': 'Place', 'address': {'addressLocality': 'Riyadh', 'addressCountry': 'SA'}}", "Riyadh, SA"),
])
def test_shown_place(spark, location, shown):
    assert one(spark, listings.shown_place(F.lit(location).cast("string"))) == shown


def test_facets(spark):
    rows = [("A", "Dubai", "verified"), ("A", "['Dubai']", "verified"), (" ", "Remote", "rejected"), ("B", None, "verified"), ("C", "London (Remote)", None)]
    got = {(r["facet"], r["value"]): r["n"] for r in listings.facets(spark.createDataFrame(rows, "company string, location string, status string")).collect()}
    assert got == {("company", "A"): 2, ("company", "B"): 1, ("company", "C"): 1, ("company", "Direct Employer"): 1, ("location", "Dubai"): 2, ("location", "London (Remote)"): 1, ("mode", "remote"): 3, ("mode", "onsite"): 2, ("status", "verified"): 3, ("status", "rejected"): 1, ("status", None): 1}


def test_run_coverage(spark):
    runs = spark.createDataFrame([(r, s, 0, d) for r, s, d in (("done", 3, None), ("late", 3, "2026-01-01"), ("spent", 150, None), ("left", 3, None), ("none", 3, None), ("empty", 3, None))], "run_id string, search_calls int, fetch_calls int, deadline string").withColumn("deadline", F.to_timestamp("deadline"))
    records = spark.createDataFrame([("done", "verified", True, "Riyadh, Saudi", 1, None, None), ("done", "duplicate", None, "Dubai", None, None, 5), ("none", "rejected", False, "Dubai", None, None, 5)], "run_id string, status string, qualified boolean, location string, experience_min int, experience_max int, posted_age_seconds long")
    tasks = spark.createDataFrame([("done", "completed"), ("left", "pending"), ("left", "completed"), ("none", "blocked")], "run_id string, state string")
    got = {r["run_id"]: r for r in listings.run_coverage(runs, records, tasks, ["Saudi Arabia", "Dubai"], 2, "2026-06-01").collect()}
    assert {k: r["run_status"] for k, r in got.items()} == {"done": "complete_within_scope", "late": "interrupted", "spent": "partial", "left": "partial", "none": "failed", "empty": "complete_within_scope"}
    done = got["done"]
    assert (done["raw"], done["unique"], done["duplicates"], done["qualified"], done["unknown_experience"], done["unknown_date"], done["weak_areas"], done["is_sufficient"]) == (2, 1, 1, 1, 0, 1, ["Dubai"], False)
    assert got["spent"]["budgets_reached"] == ["max_search_calls"] and got["empty"]["raw"] == 0 and got["empty"]["weak_areas"] == ["Saudi Arabia", "Dubai"]


def test_manifest_counts_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, 'a "quoted"\nline, with a break') for i in range(25)], "record_id long, title string").repartition(3)
    sinks.export_csv(rows, f"{tmp_path}/csv")
    told = sinks.manifest(spark, f"{tmp_path}/csv", "csv")
    assert told.agg(F.sum("rows")).first()[0] == 25 and told.filter("length(sha256) = 64 and length > 0").count() == told.count()
    victim = sorted((tmp_path / "csv").glob("part-*"))[0]
    victim.write_text("record_id,title\n")
    (tmp_path / "csv" / f".{victim.name}.crc").unlink(missing_ok=True)
    kept = {r["file"]: r["rows"] for r in sinks.manifest(spark, f"{tmp_path}/csv", "csv").collect()}
    assert kept[victim.name] == 0 and sum(kept.values()) < 25


def test_sketches_add_up(spark):
    calls = spark.range(20000).selectExpr("CONCAT('t', id % 3) AS tool", "CONCAT('d', id % 4) AS domain", "CAST(id AS DOUBLE) AS duration", "id % 10 = 0 AS failed")
    total = listings.ops_rollup(listings.ops_sketches(calls)).filter("tool IS NULL").first()
    assert total["n"] == 20000 and total["errors"] == 2000 and total["error_rate"] == 0.1 and abs(total["p50"] - 10000) < 660 and abs(total["p95"] - 19000) < 660


def test_technical_sections(spark):
    text = "intro\n# 1. Spark joins\nA join meets keys of two tables. More.\n- one more point here\n- two\n# Pricing of joins\nenroll now for a discount on the joins course\n# Other\nnothing of that kind, though it is long\nQUERY PLANS\nthe batch joins run as tasks, x = scan | filter\n# docs / Spark joins\nseen before under the same name, joins"
    rows = sections.technical_sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "overview of joins").collect()
    assert [(r["place"], r["heading"], r["category"], r["points"]) for r in rows] == [(1, "Spark joins", "Architecture & Primitives", ["one more point here"]), (2, "QUERY PLANS", "Execution Protocols & Methods", [])]
    assert rows[0]["definition"] == "A join meets keys of two tables" and rows[1]["code"] == "the batch joins run as tasks, x = scan | filter"


def test_competitors(spark):
    text = """
    # Supabase
    The open source alternative with a database. Pricing starts with a generous free tier.
    - Free tier: $0/month includes 500MB
    - Enterprise: custom volume pricing, SOC2
    Strengths: Full access, SQL first
    # Cookie notice
    text
    # Neon Serverless
    - Launch plan: $19/month usage-based
    """
    rows = [(1, text, "https://supabase.com/pricing", "x"), (2, "Only prose for developers", "https://www.neon.co.uk/", ""), (3, "Prose", None, "Beta Pricing - now"), (4, None, None, None)]
    found = sections.competitor_profiles(spark.createDataFrame(rows, "doc_id long, text string, url string, title string")).orderBy("doc_id", "place").collect()
    assert [(r["doc_id"], r["company_name"], r["pricing_model"], r["starting_price"], r["target_audience"]) for r in found] == [
        (1, "Supabase", "Open Source / Self-Hosted", "Free / $0", "Enterprise & High-Growth Scaleups"),
        (1, "Neon Serverless", "Usage-Based / Pay-As-You-Go", "$19/mo", "Startups & Engineering Teams"),
        (2, "Neon", "Subscription / Tiered", "Free Tier Available", "Developers & Technical Teams"), (3, "Beta", "Subscription / Tiered", "Free Tier Available", "Startups & Engineering Teams"),
    ]
    assert found[0]["strengths"] == "Full access, SQL first" and found[0]["key_features"][0] == "Free tier: $0/month includes 500MB"


def test_listed_roles_behind_plain_sections(spark):
    """Numbers and limits count postings, not the sections before them."""
    plain = "".join(f"## About {i}\nnothing\n" for i in range(30))
    roles = "".join(f"## Engineer {i}\nLocation: {'Riyadh' if i else 'Pune, India'}\nApply: https://x.org/{'people/' if i == 2 else ''}{i}\n" for i in range(4))
    docs = spark.createDataFrame([(1, plain + roles), (2, None)], "doc_id long, text string")
    found = lambda **k: [(r["place"], r["title"]) for r in sections.section_postings(docs, **k).orderBy("place").collect()]
    assert found() == [(1, "Engineer 0"), (2, "Engineer 1"), (3, "Engineer 3")]
    assert found(most=2) == [(1, "Engineer 0"), (2, "Engineer 1")] and found(geography="UAE") == [(1, "Engineer 1"), (2, "Engineer 3")]
    assert found(topic="chef jobs") == [] and len(found(topic="engineer in dubai")) == 2 and len(found(topic="engineer")) == 3


def test_roles_in_headings(spark):
    text = "# Join our Data Engineer crew\n# Careers\n## Staff ML Engineer\nLocation: Riyadh\nPays $90,000\n- Data Scientist, NLP\nbased in Berlin, Germany\n## Staff ML Engineer\n"
    docs = spark.createDataFrame([(1, text), (2, "# Data Engineer\nalone"), (3, None)], "doc_id long, text string")
    rows = sections.heading_postings(docs).orderBy("place").collect()
    assert [(r["doc_id"], r["title"], r["location"], r["salary"]) for r in rows] == [(1, "Staff ML Engineer", "Riyadh", "$90,000"), (1, "Data Scientist, NLP", "Berlin, Germany", None)]


def test_answer_sections(spark):
    text = "dropped intro\n# 1. First steps\n- install the package from the archive\nThen you run the first command. It prints a very long line of output.\n## Cookie settings\nthis body is long enough to be kept otherwise\n# \n## First Steps\nthe same title again, with a body of some length\n# Short\ntiny"
    block = "A paragraph without any heading. " * 4
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, f"small\n\n{block}\nsecond line"), (5, "# Only heading")], "doc_id long, text string")
    rows = {(r["doc_id"], r["place"]): r for r in payloads.answer_sections(docs).collect()}
    assert sorted(rows) == [(1, 1), (4, 1)]
    assert rows[1, 1]["section_title"] == rows[1, 1]["topic"] == "First steps" and rows[1, 1]["key_points"] == ["install the package from the archive"]
    assert rows[1, 1]["summary"] == "- install the package from the archive"
    assert rows[4, 1]["section_title"] == block[:60] and rows[4, 1]["key_points"] == ["A paragraph without any heading"] * 3
    assert payloads.answer_sections(docs, topic="t", most=0).count() == 0


def test_boosted_rank(spark):
    ranked = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.1), ("d", 0.5)], "record_id string, relevance_raw double")
    boosts = spark.createDataFrame([("u", "a", 0.25), ("u", "b", 0.1), ("u", "c", -0.25), ("u", "d", 0.1), ("v", "b", 0.0)], "user_id string, record_id string, boost double")
    rows = evidence.boosted_rank(ranked, boosts).collect()
    assert {(r["user_id"], r["record_id"]): (r["place"], round(r["final"], 6)) for r in rows} == {("u", "a"): (1, 1.0), ("u", "b"): (2, 0.6), ("u", "d"): (3, 0.6), ("u", "c"): (4, 0.0), ("v", "b"): (1, 0.5)}


def test_places_over_ranges(spark):
    """No task ranks all rows of a user, and lists rank as their rows do."""
    ranked = spark.range(3000).selectExpr("concat('r', id) AS record_id", "(id * 37 % 50) / 50 AS relevance_raw")
    users = [("u",), (None,), ("v",)]
    lists = ranked.selectExpr("record_id", "array(named_struct('user_id', 'u'), named_struct('user_id', cast(null as string)), named_struct('user_id', 'v')) AS users", "array(0.1D, 0.0D, CASE WHEN record_id LIKE '%7' THEN -0.2D END) AS boosts")
    got = [evidence.boosted_rank(ranked, b) for b in (lists, evidence.opened(lists))]
    rows = [{(r["user_id"], r["record_id"]): (r["place"], r["final"]) for r in g.collect()} for g in got]
    assert rows[0] == rows[1] and len(rows[0]) == 6300
    for (u,) in users:
        mine = sorted(((k[1], *v) for k, v in rows[0].items() if k[0] == u), key=lambda x: x[1])
        assert [x[1] for x in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: (-x[2], x[0]))
    assert "hashpartitioning(user_id" not in got[0]._jdf.queryExecution().executedPlan().toString()
