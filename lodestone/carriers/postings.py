"""Queries over postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.carriers.base import carrier, oracle, table
from lodestone.carriers.web import CANON, any_of
from lodestone.functions import columns as c
from lodestone.functions import rules
from lodestone.operators import postings as p

SPEC = p.JobSpec(title="Generative AI Engineer", locations=("Saudi Arabia", "UAE"), experience_min=2, experience_max=6, skills=("Python",), inferred_skills=("docker", "sql"), salary_min=100000.0, currency="USD", freshness_days=60, excluded_titles=("intern",), excluded_companies=("customer#000000007",))
PAY = p.JobSpec(salary_min=150000.0, currency="USD", locations=("uae",))
GENERAL = p.JobSpec(title="Backend Platform Engineer", alternatives=("widget economy",))


def raw(s, d):
    return carrier(s, d, "postings")


def normal(s, d):
    return p.normalize_postings(raw(s, d))


NORMAL_COLUMNS = ["record_id", "normalized_company", "normalized_title", "normalized_location", "remote_status", "city", "country", "confidence_value"]


def age_texts(s, d):
    return table(s, d, "events").select("event_id", F.expr("CASE event_id % 12 WHEN 0 THEN 'just now' WHEN 1 THEN concat(event_id % 59, ' mins ago') WHEN 2 THEN concat(event_id % 23, ' hours ago') WHEN 3 THEN 'today' WHEN 4 THEN 'Yesterday' WHEN 5 THEN concat(event_id % 29, ' days ago') WHEN 6 THEN concat(event_id % 5, ' weeks ago') WHEN 7 THEN concat(event_id % 11, ' months ago') WHEN 8 THEN concat('over ', event_id % 4, '+ years ago') WHEN 9 THEN date_format(ts, 'yyyy-MM-dd') WHEN 10 THEN 'Salary range' END").alias("text"))


QUERIES = {
    "b4_normalize_postings": lambda s, d: normal(s, d).select(*NORMAL_COLUMNS),
    "b5_salary_range": lambda s, d: normal(s, d).select("record_id", "salary_min", "salary_max", "salary_currency", "salary_period", "experience_min", "experience_max"),
    "b8_posted_age": lambda s, d: p.posted_age(age_texts(s, d), "text", "2024-06-01").select("event_id", "age_seconds", "label"),
    "b9_enrich_postings": lambda s, d: p.enrich_from_text(table(s, d, "documents"), ["the", "des", "und", "el"]).select("doc_id", F.array_join("skill_hits", ",").alias("hits"), "is_remote", "years"),
    "b10_identity_keys": lambda s, d: p.identity_keys(raw(s, d)).select("record_id", "fingerprint", "crawl_key"),
    "b11_freshness_category": lambda s, d: p.freshness_category(table(s, d, "events"), "ts", "2024-01-20 12:00:00").select("event_id", "category"),
    "b12_freshness_rating": lambda s, d: p.freshness_rating(table(s, d, "events"), "ts", "job_posting", "2024-02-10").select("event_id", "rating"),
    "c1_location_match": lambda s, d: raw(s, d).select("record_id", p.location_status(F.col("location"), SPEC).alias("status")),
    "c2_experience_match": lambda s, d: normal(s, d).select("record_id", p.experience_status(F.col("experience_min"), F.col("experience_max"), SPEC).alias("status")),
    "c3_skills_match": lambda s, d: p.match_skills(raw(s, d), ["python", "langchain", "genai"], "skills").select("record_id", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing")),
    "c4_aggregator_title_filter": lambda s, d: raw(s, d).filter(~c.is_listing_title(F.col("title"))).select("record_id", "title"),
    "c5_title_relevance": lambda s, d: raw(s, d).select("record_id", p.title_match(F.col("title"), SPEC).alias("t"), p.title_match(F.col("title"), GENERAL).alias("g")).select("record_id", F.col("t.status").alias("status"), F.col("t.score").alias("score"), F.col("g.status").alias("general_status"), F.col("g.score").alias("general_score")),
    "c6_salary_floor": lambda s, d: normal(s, d).select("record_id", p.salary_status(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), PAY).alias("status")),
    "c7_qualify": lambda s, d: p.qualify(normal(s, d), SPEC).select("record_id", "qualified", F.array_join("rejection_reasons", ",").alias("reasons"), "score", "title_category"),
    "c8_hard_filter": lambda s, d: p.hard_filter(normal(s, d), SPEC)[1].select("record_id", "reason"),
    "c9_geo_compliance": lambda s, d: p.geo_compliant(raw(s, d), "saudi", ["dubai", "london", "bangalore", "doha", "riyadh"]).select("record_id", "geo_ok"),
    "c10_substantive_filter": lambda s, d: p.substantive(raw(s, d)).select("record_id"),
    "c11_verify_records": lambda s, d: p.verify(raw(s, d), carrier(s, d, "evidence"), ["title", "company", "location"]).select("record_id", "verified", "checked_confidence"),
    "c12_posting_page_filter": lambda s, d: p.posting_pages(table(s, d, "documents")).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("n_signals").alias("signals")),
    "c16_broad_title_filter": lambda s, d: p.broad_titles(raw(s, d), ["machine learning engineer", "software engineer", "widget"]).select("record_id"),
    "c21_safety_gate": lambda s, d: p.safety_gate(normal(s, d), SPEC).select("record_id"),
    "e3_rejection_tally": lambda s, d: p.rejection_tally(p.qualify(normal(s, d), SPEC)),
    "g1_rank_postings": lambda s, d: p.rank_postings(normal(s, d), SPEC).select("record_id", F.round("relevance_raw", 6).alias("relevance")),
}

LEGAL = r"(?i)\b(inc|llc|ltd|pvt|limited|corp|corporation|gmbh|co)\b\.?"
NORMAL = rf"""
WITH a AS (SELECT *, coalesce(location, '') AS loc, lower(title || ' ' || coalesce(location, '')) AS txt FROM postings),
b AS (SELECT *, CASE WHEN {any_of('txt', ['remote', 'wfh', 'work from home', 'anywhere', 'virtual'])} THEN 'remote' WHEN contains(txt, 'hybrid') THEN 'hybrid' ELSE 'onsite' END AS remote_status,
  trim(regexp_replace(regexp_replace(company, '{LEGAL}', '', 'g'), '\s+', ' ', 'g'), ' .,-|') AS nc,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)\b(senior|sr\.?|junior|jr\.?|lead|principal|staff|associate)\b', '', 'g'), '[\(\[\{{].*?[\)\]\}}]', '', 'g'), '[-/|].*$', ''), '\s+', ' ', 'g')) AS nt,
  CASE WHEN contains(lower(loc), 'remote') AND lower(loc) <> 'remote' THEN trim(regexp_replace(loc, '(?i)\b(remote|wfh)\b', '', 'g'), ' ,-|') ELSE loc END AS nl FROM a),
n AS (SELECT *, CASE WHEN nc <> '' THEN nc ELSE company END AS normalized_company, CASE WHEN nt <> '' THEN nt ELSE title END AS normalized_title, CASE WHEN nl = '' AND remote_status = 'remote' THEN 'Remote' ELSE nl END AS normalized_location,
  CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.85 ELSE confidence END AS confidence_value FROM b)"""
PARTS = "list_filter(list_transform(string_split(normalized_location, ','), lambda x: trim(x)), lambda x: x <> '')"
SALARY = """
WITH s AS (SELECT *, p.p_size AS z, o.o_orderkey % 9 AS m, o.o_orderkey % 5 AS e FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part))
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(CASE m WHEN 0 THEN z * 100000 WHEN 1 THEN (z + 90) * 1000 WHEN 2 THEN 180000 WHEN 3 THEN (z + 40) * 1000 WHEN 4 THEN 360000 WHEN 8 THEN z * 1000 + 20000 END AS DOUBLE) AS salary_min,
 CAST(CASE m WHEN 0 THEN (z + 10) * 100000 WHEN 1 THEN (z + 130) * 1000 WHEN 2 THEN 300000 WHEN 3 THEN (z + 40) * 1000 WHEN 4 THEN 360000 WHEN 8 THEN z * 1000 + 20000 END AS DOUBLE) AS salary_max,
 CASE m WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'AED' WHEN 4 THEN 'SAR' WHEN 8 THEN 'GBP' END AS salary_currency, CASE WHEN m IN (2, 4) THEN 'monthly' ELSE 'annual' END AS salary_period,
 CASE e WHEN 0 THEN 3 WHEN 1 THEN z % 12 WHEN 4 THEN 2 END AS experience_min, CASE e WHEN 0 THEN 5 WHEN 4 THEN 4 END AS experience_max FROM s"""
LOCATION = """CASE coalesce(location, '') WHEN '' THEN 'UNKNOWN' WHEN 'Riyadh, Saudi Arabia' THEN 'MATCH' WHEN 'Dubai, UAE' THEN 'MATCH' WHEN 'Gulf region' THEN 'MATCH' WHEN 'Remote worldwide' THEN 'MATCH' WHEN 'Remote' THEN 'UNKNOWN'
 WHEN 'Timbuktu Province' THEN 'UNKNOWN' WHEN 'London, United Kingdom' THEN 'MISMATCH' WHEN 'Denver, CO (Remote)' THEN 'MISMATCH' WHEN 'Bangalore, India' THEN 'MISMATCH' WHEN 'Doha, Qatar' THEN 'MISMATCH' WHEN 'Berlin, Germany' THEN 'MISMATCH' ELSE 'UNKNOWN' END"""
TITLE = """CASE seq % 16 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN 0.4 WHEN 5 THEN 0.85 WHEN 6 THEN 0.0 WHEN 7 THEN 0.0 WHEN 8 THEN 0.85 WHEN 9 THEN 0.0 WHEN 10 THEN 1.0 WHEN 11 THEN 0.0 WHEN 12 THEN 0.8 ELSE 0.0 END"""
EXPERIENCE = "CASE WHEN seq % 5 = 0 OR seq % 5 = 4 THEN 'MATCH' WHEN seq % 5 IN (2, 3) OR y = 0 THEN 'UNKNOWN' WHEN y > 6 THEN 'MISMATCH' ELSE 'MATCH' END"
JUDGED = f"""
WITH y AS (SELECT t.*, p.p_size % 12 AS y FROM postings t JOIN part p ON p.p_partkey = t.seq % (SELECT count(*) FROM part)),
j AS (SELECT *, CAST({TITLE} AS DOUBLE) AS ts, {LOCATION} AS ls, {EXPERIENCE} AS es, NOT (seq % 4 = 0) AS miss,
 CASE seq % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END / 2.0 AS inf, coalesce(posted_age_seconds / 86400.0 > 60, false) AS stale FROM y),
k AS (SELECT *, list_filter([CASE WHEN ts = 0 THEN 'title_job_family_mismatch' END, CASE WHEN ls = 'MISMATCH' THEN 'location_mismatch' END,
 CASE WHEN ls = 'UNKNOWN' AND coalesce(location, '') <> 'Remote' THEN 'unverified_location' END, CASE WHEN es = 'MISMATCH' THEN 'experience_mismatch' END, CASE WHEN miss THEN 'missing_explicit_skill' END,
 CASE WHEN contains(lower(title), 'intern') THEN 'excluded_title' END, CASE WHEN contains(lower(company), 'customer#000000007') THEN 'excluded_company' END, CASE WHEN stale THEN 'stale_job' END], lambda x: x IS NOT NULL) AS reasons,
 0.40 * CASE WHEN ts = 0.4 THEN 0.4 WHEN ts > 0 THEN 1 ELSE 0 END + 0.30 * CASE ls WHEN 'MATCH' THEN 1 WHEN 'UNKNOWN' THEN 0.5 ELSE 0 END + 0.15 * CASE es WHEN 'MATCH' THEN 1 WHEN 'UNKNOWN' THEN 0.5 ELSE 0 END + 0.15 * CASE WHEN miss THEN 0 ELSE 1 END + round_even((inf - 0.5) * 0.10, 2) AS base FROM j),
q AS (SELECT *, len(reasons) = 0 AS qualified, round_even(least(greatest(base, 0.05), 1.0), 2) AS raw FROM k)"""
AGE = "epoch(TIMESTAMP '{0}') - epoch(date_trunc('second', ts))"

ORACLES = {
    "b4_normalize_postings": oracle(NORMAL + f" SELECT record_id, normalized_company, normalized_title, normalized_location, remote_status, {PARTS}[1] AS city, CASE WHEN len({PARTS}) > 1 THEN {PARTS}[-1] END AS country, confidence_value FROM n", "postings"),
    "b5_salary_range": SALARY,
    "b8_posted_age": """WITH e AS (SELECT event_id, ts, event_id % 12 AS m FROM events) SELECT event_id, CAST(CASE m WHEN 0 THEN 0 WHEN 1 THEN event_id % 59 * 60 WHEN 2 THEN event_id % 23 * 3600 WHEN 3 THEN 3600 WHEN 4 THEN 86400 WHEN 5 THEN event_id % 29 * 86400
 WHEN 6 THEN event_id % 5 * 604800 WHEN 7 THEN event_id % 11 * 2592000 WHEN 8 THEN event_id % 4 * 31536000 WHEN 9 THEN greatest(epoch(TIMESTAMP '2024-06-01') - epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)), 0) END AS BIGINT) AS age_seconds,
 CASE m WHEN 0 THEN 'JUST NOW' WHEN 1 THEN (event_id % 59) || 'm ago' WHEN 2 THEN (event_id % 23) || 'h ago' WHEN 3 THEN 'Today' WHEN 4 THEN '1d ago' WHEN 5 THEN (event_id % 29) || 'd ago' WHEN 6 THEN (event_id % 5) || 'w ago' WHEN 7 THEN (event_id % 11) || 'mo ago' WHEN 8 THEN (event_id % 4) || 'y ago' WHEN 9 THEN 'dated' ELSE 'UNKNOWN' END AS label FROM e""",
    "b9_enrich_postings": """WITH t AS (SELECT doc_id, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '  ', 'g') || ' ' AS w, lower(text) AS low FROM documents)
 SELECT doc_id, array_to_string(list_filter(['the', 'des', 'und', 'el'], lambda x: contains(w, ' ' || x || ' ')), ',') AS hits, contains(low, 'remote') OR contains(low, 'work from home') AS is_remote,
 coalesce(TRY_CAST(nullif(regexp_extract(low, '([0-9]+)\\s*(?:-|–|to)\\s*[0-9]+\\s*(?:years?|yrs?)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(low, '(?:minimum|at least)\\s*([0-9]+)\\s*(?:years?|yrs?)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(low, '([0-9]+)\\+?\\s*(?:years?|yrs?)', 1), '') AS INT), CASE WHEN regexp_matches(low, 'entry[- ]level|fresher') THEN 0 END) AS years FROM t""",
    "b10_identity_keys": oracle("SELECT record_id, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') || '::' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') || '::' || regexp_replace(lower(coalesce(location, '')), '[^a-z0-9]', '', 'g') AS fingerprint, lower(trim(title)) || '|' || lower(trim(company)) AS crawl_key FROM postings", "postings"),
    "b11_freshness_category": "WITH a AS (SELECT event_id, abs(" + AGE.format("2024-01-20 12:00:00") + ") / 86400.0 AS days FROM events) SELECT event_id, CASE WHEN days < 1 THEN 'VERY_RECENT' WHEN days <= 3 THEN 'RECENT' WHEN days <= 7 THEN 'RELEVANT' WHEN days <= 30 THEN 'CONTEXT' ELSE 'BACKGROUND' END AS category FROM a",
    "b12_freshness_rating": "WITH a AS (SELECT event_id, greatest(" + AGE.format("2024-02-10") + ", 0) AS age FROM events) SELECT event_id, CASE WHEN age <= 1209600 THEN 'FRESH' WHEN age <= 2592000 THEN 'AGING' WHEN age <= 5184000 THEN 'STALE' ELSE 'EXPIRED' END AS rating FROM a",
    "c1_location_match": oracle(f"SELECT record_id, {LOCATION} AS status FROM postings", "postings"),
    "c2_experience_match": oracle(f"SELECT t.record_id, CASE WHEN seq % 5 IN (2, 3) THEN 'UNKNOWN' WHEN seq % 5 = 1 AND p_size % 12 > 6 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM postings t JOIN part p ON p.p_partkey = t.seq % (SELECT count(*) FROM part)", "postings"),
    "c3_skills_match": oracle("SELECT record_id, CASE seq % 4 WHEN 0 THEN 'python,langchain' WHEN 3 THEN 'genai' ELSE '' END AS matched, CASE seq % 4 WHEN 0 THEN 'genai' WHEN 3 THEN 'python,langchain' ELSE 'python,langchain,genai' END AS missing FROM postings", "postings"),
    "c4_aggregator_title_filter": oracle("SELECT record_id, title FROM postings WHERE seq % 16 NOT IN (3, 9)", "postings"),
    "c5_title_relevance": oracle(f"""SELECT record_id, CASE WHEN ts = 0 THEN 'MISMATCH' WHEN ts = 0.4 THEN 'UNKNOWN' ELSE 'MATCH' END AS status, ts AS score, CASE WHEN g = 0 THEN 'MISMATCH' WHEN g = 0.4 THEN 'UNKNOWN' ELSE 'MATCH' END AS general_status, g AS general_score
 FROM (SELECT record_id, CAST({TITLE} AS DOUBLE) AS ts, CAST(CASE WHEN seq % 16 = 7 THEN 0.7 WHEN contains(lower(title), 'widget economy') THEN 0.85 ELSE 0 END AS DOUBLE) AS g FROM postings)""", "postings"),
    "c6_salary_floor": oracle(f"SELECT record_id, CASE WHEN salary_min IS NULL THEN 'UNKNOWN' WHEN salary_currency = 'USD' AND salary_max < 150000 * 0.85 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM ({SALARY})"),
    "c7_qualify": oracle(JUDGED + " SELECT record_id, qualified, array_to_string(reasons, ',') AS reasons, CASE WHEN qualified THEN raw ELSE least(raw, 0.2) END AS score, CASE WHEN ts = 0 THEN 'MISMATCH' WHEN ts >= 0.98 THEN 'DIRECT' WHEN ts >= 0.9 THEN 'CLOSE' WHEN ts >= 0.7 THEN 'RELATED' ELSE 'ADJACENT' END AS title_category FROM q", "postings"),
    "c8_hard_filter": oracle(JUDGED + " SELECT record_id, array_to_string(reasons, '; ') AS reason FROM q WHERE NOT qualified", "postings"),
    "c9_geo_compliance": oracle("SELECT record_id, regexp_matches(lower(coalesce(location, '')), '" + "|".join(rules.GEO_ALIASES["saudi"]) + "') OR NOT regexp_matches(lower(coalesce(location, '')), 'dubai|london|bangalore|doha') AS geo_ok FROM postings", "postings"),
    "c10_substantive_filter": oracle("SELECT record_id FROM postings WHERE seq % 16 NOT IN (3, 9)", "postings"),
    "c11_verify_records": oracle("WITH e AS (SELECT record_id, count(DISTINCT field_name) AS n FROM evidence WHERE supports_value = 1 AND field_name IN ('title', 'company', 'location') GROUP BY 1), v AS (SELECT p.record_id, coalesce(e.n, 0) = 3 AND coalesce(trim(p.location), '') <> '' AS ok FROM postings p LEFT JOIN e ON e.record_id = p.record_id) SELECT record_id, CASE WHEN ok THEN 'verified' ELSE 'needs_review' END AS verified, CAST(CASE WHEN ok THEN 0.95 ELSE 0.45 END AS DOUBLE) AS checked_confidence FROM v", "postings", "evidence"),
    "c12_posting_page_filter": f"WITH t AS (SELECT lower(coalesce(text, '')) AS low FROM documents), s AS (SELECT low, {' + '.join('CAST(contains(low, ' + chr(39) + k.replace(chr(39), chr(39) * 2) + chr(39) + ') AS INT)' for k in rules.POSTING_SIGNALS)} AS n FROM t), v AS (SELECT n, CASE WHEN length(trim(low)) < 120 THEN 'sparse' WHEN {any_of('substr(low, 1, 400)', rules.ERROR_SIGNALS)} THEN 'error' WHEN {any_of('low', rules.EXPIRED_SIGNALS)} THEN 'expired' WHEN contains(low, 'jobposting') OR contains(low, 'dateposted') THEN 'schema' WHEN n >= 2 THEN 'signals' ELSE 'assumed' END AS verdict FROM s) SELECT verdict, count(*) AS n, CAST(sum(n) AS BIGINT) AS signals FROM v GROUP BY 1",
    "c16_broad_title_filter": oracle("WITH w AS (SELECT record_id, lower(title) AS low, string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ') AS ws FROM postings) SELECT record_id FROM w WHERE contains(low, 'widget') OR list_contains(ws, 'software') OR list_contains(ws, 'engineer') OR CAST(list_contains(ws, 'machine') AS INT) + CAST(list_contains(ws, 'learning') AS INT) + CAST(list_contains(ws, 'engineer') AS INT) >= 2", "postings"),
    "c21_safety_gate": oracle(JUDGED + " SELECT record_id FROM q WHERE qualified", "postings"),
    "e3_rejection_tally": oracle(JUDGED + " SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM q) GROUP BY 1", "postings"),
    "g1_rank_postings": oracle(f"""WITH s AS (SELECT record_id, salary_min FROM ({SALARY})), a AS (SELECT p.*, s.salary_min AS pay, lower(title) AS low, lower(title || ' ' || coalesce(location, '')) AS txt FROM postings p JOIN s ON s.record_id = p.record_id),
 f AS (SELECT record_id, CASE WHEN contains(low, 'generative ai engineer') THEN 1.0 ELSE 0.5 * (CAST(contains(low, 'generative') AS INT) + CAST(contains(low, 'engineer') AS INT)) / 2 END AS t,
 CASE WHEN coalesce(location, '') = '' THEN CASE WHEN contains(txt, 'remote') THEN 0.9 ELSE 0.5 END WHEN regexp_matches(lower(location), 'saudi|arabia|uae|ksa|riyadh|jeddah|dubai|emirates') THEN 1.0 WHEN contains(txt, 'remote') THEN 0.75 ELSE 0.35 END AS l,
 CASE WHEN seq % 4 IN (0, 3) THEN 1.0 ELSE 0.0 END AS k, CASE WHEN pay IS NULL THEN 0.6 WHEN pay >= 100000 THEN 0.8 ELSE 0.5 END AS m,
 CASE WHEN posted_age_seconds IS NULL THEN 1.0 WHEN posted_age_seconds <= 86400 THEN 1.05 WHEN posted_age_seconds <= 604800 THEN 1.0 WHEN posted_age_seconds <= 2592000 THEN 0.9 ELSE 0.75 END AS r,
 CASE WHEN regexp_matches(coalesce(url, ''), 'greenhouse.io|lever.co|ashbyhq.com|workable.com') THEN 1.05 WHEN regexp_matches(coalesce(url, ''), 'linkedin.com|indeed.com|bayt.com|naukri.com') THEN 0.98 ELSE 1.0 END AS w FROM a),
 z AS (SELECT record_id, round(least(greatest((CAST(t AS DOUBLE) * 0.35 + CAST(l AS DOUBLE) * 0.25 + CAST(k AS DOUBLE) * 0.25 + CAST(m AS DOUBLE) * 0.15) * CAST(r AS DOUBLE) * CAST(w AS DOUBLE), 0.05), 1.0), 6) AS relevance FROM f)
 SELECT record_id, relevance FROM z""", "postings"),
}
