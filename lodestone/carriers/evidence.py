"""Queries over facts, claims, documents and preferences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.carriers.base import carrier, oracle, table
from lodestone.operators import evidence as m
from lodestone.operators import postings



def whole(words: str) -> str:
    """A pattern for whole words that all engines read alike."""
    return rf"(?:^|[^\p{{L}}])(?:{words})(?:[^\p{{L}}]|$)"


RISK_WORDS = [("warm", "HIGH", whole("onst|wher")), ("cold", "MEDIUM", whole("und|los")), ("odd", "MEDIUM", whole("layoffs|password"))]


def docs(s, d):
    return table(s, d, "documents")


def fact_texts(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey AS doc_id", "CASE o_orderkey % 6 WHEN 0 THEN concat('Revenue of ₹', CAST(o_totalprice AS BIGINT), ' crore, net profit was $', o_custkey, ' million.') WHEN 1 THEN concat('Headcount of ', o_custkey, '+ staff. Founded in 1999; based in Riyadh.') WHEN 2 THEN concat('Operating margin of ', o_orderkey % 40, '%') WHEN 3 THEN concat(o_orderkey % 9, ' years of experience; salary: ', o_orderkey % 30 + 5, ' LPA') WHEN 4 THEN '' END AS text")


def price_texts(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey AS doc_id", "CASE o_orderkey % 3 WHEN 0 THEN concat('Trades at Rs. ', o_custkey, '; target price INR ', o_custkey + 10) WHEN 1 THEN concat('Fair value ₹', o_custkey, '.50. Now Rs ', o_custkey) ELSE NULL END AS text")


def prefs(s, d):
    return table(s, d, "events").selectExpr("CONCAT('u', user_id % 20) AS user_id", "CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'save' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'wrong_location' END AS action", "CASE event_id % 3 WHEN 0 THEN 'Generative AI Engineer' WHEN 1 THEN 'Sales Executive' END AS title", "concat('Customer#', lpad(CAST(event_id % 40 AS STRING), 9, '0')) AS company", "CASE event_id % 2 WHEN 0 THEN 'Dubai, UAE' ELSE 'Remote' END AS location", "CASE event_id % 4 WHEN 0 THEN 'Retail' END AS industry", "array(CASE event_id % 3 WHEN 0 THEN 'Docker' WHEN 1 THEN 'k8s' END) AS skills")


def seekers(s, d):
    named = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.selectExpr("s_suppkey AS cand", "s_nationkey % 5 AS segment", "CASE s_suppkey % 4 WHEN 0 THEN array('SQL', 'python') WHEN 1 THEN array(' sql') WHEN 2 THEN array('Machine Learning') END AS explicit_skills", "array('spark', 'go') AS inferred_skills", "CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 9 END AS max_years", "CASE WHEN s_suppkey % 6 > 0 THEN array(n_name) END AS want_places")


def openings(s, d):
    named = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.selectExpr("c_custkey AS opp", "c_nationkey % 5 AS segment", "CASE c_custkey % 4 WHEN 0 THEN array('sql') WHEN 1 THEN array('SQL', 'Go ') WHEN 2 THEN array('golang') END AS has_skills", "CASE c_custkey % 5 WHEN 1 THEN 'Python developer' WHEN 3 THEN 'Machine learning engineer' ELSE 'Engineer' END AS title", "CASE c_custkey % 3 WHEN 0 THEN 'PostgreSQL databases, Spark' WHEN 1 THEN c_mktsegment END AS description", "CASE c_custkey % 11 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Worldwide' WHEN 2 THEN NULL ELSE n_name END AS location", "c_custkey % 12 AS years")


def universe(s, d):
    """Words of the benchmark items as aliases, in capitals as symbols, and the items' first two words as an alias of two."""
    words = table(s, d, "benchmark").selectExpr("item_id", "regexp_extract_all(text, '[a-zA-Z]+', 0) AS w")
    single = words.select(F.explode("w").alias("w")).filter("length(w) between 3 and 12").select(F.upper("w").alias("symbol"), F.lower("w").alias("alias"))
    return single.unionByName(words.filter("size(w) > 1").selectExpr("concat('T', item_id) AS symbol", "lower(concat(w[0], ' ', w[1])) AS alias")).distinct()


UNIVERSE = r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[a-zA-Z]+') AS w FROM benchmark),
 u AS (SELECT upper(x) AS symbol, lower(x) AS alias FROM (SELECT unnest(w) AS x FROM w) WHERE length(x) BETWEEN 3 AND 12 UNION SELECT 'T' || item_id, lower(w[1] || ' ' || w[2]) FROM w WHERE len(w) > 1)"""


def evidence_of(s, d):
    return table(s, d, "lineitem").selectExpr("concat('E', l_partkey) AS entity_id", "CASE WHEN l_quantity > 48 THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS relationship", "CASE WHEN l_linenumber = 7 THEN 'a risk' ELSE 'a claim' END AS claim", "concat('src', l_suppkey % 9) AS source")


QUERIES = {
    "j1_extract_facts": lambda s, d: m.extract_facts(fact_texts(s, d), "doc_id"),
    "j3_contradictions": lambda s, d: m.contradictions(carrier(s, d, "facts")).select("entity_id", "field", "seq_a", "seq_b"),
    "j4_scan_risks": lambda s, d: m.scan_risks(docs(s, d), "doc_id", signatures=RISK_WORDS).select("doc_id", "risk", "severity", "sentence"),
    "j2_claim_support": lambda s, d: m.claim_support(table(s, d, "benchmark"), docs(s, d), "item_id", "doc_id").select("item_id", "doc_id", "n", "total", "relationship", "passage", "confidence"),
    "d7_entity_mentions": lambda s, d: m.entity_mentions(table(s, d, "benchmark"), docs(s, d), "item_id", "doc_id", alias="text"),
    "j5_claim_passages": lambda s, d: m.claim_passages(carrier(s, d, "said"), "doc_id"),
    "j6_evidence_split": lambda s, d: m.bibliography(m.claim_passages(carrier(s, d, "said"), "doc_id").withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 20).cast("string"))), "source", "doc_id"),
    "e8_entity_coverage": lambda s, d: m.entity_coverage(table(s, d, "supplier").select(F.concat(F.lit("E"), "s_suppkey").alias("entity_id")), carrier(s, d, "facts"), evidence_of(s, d)).select("entity_id", F.array_join("missing", ",").alias("missing")),
    "e8_coverage_state": lambda s, d: m.coverage_state(m.entity_coverage(table(s, d, "supplier").select(F.concat(F.lit("E"), "s_suppkey").alias("entity_id")), carrier(s, d, "facts"), evidence_of(s, d)), 50),
    "e13_entity_sources": lambda s, d: m.entity_sources(carrier(s, d, "facts"), evidence_of(s, d)),
    "j11_hiring_posts": lambda s, d: m.hiring_posts(table(s, d, "conversations").filter("role = 'user'"), hiring=whole("the|des"), seeking=whole("und|que")).select("conv_id", "turn"),
    "j13_contact_points": lambda s, d: m.contact_points(carrier(s, d, "reached"), "entity_id", "doc_id", "own"),
    "j14_company_profiles": lambda s, d: m.company_profiles(carrier(s, d, "facts"), "entity_id", "seq", ["revenue", "headquarters"]),
    "j15_price_mentions": lambda s, d: m.price_mentions(price_texts(s, d), "doc_id").groupBy("doc_id").agg(F.min_by("amount", F.when(~F.col("is_target"), F.col("pos"))).alias("current"), F.min_by("amount", F.when(F.col("is_target"), F.col("pos"))).alias("target")),
    "j16_ticker_mentions": lambda s, d: m.ticker_mentions(docs(s, d), universe(s, d), "doc_id"),
    "j17_sentiment_evidence": lambda s, d: m.sentiment_evidence(docs(s, d), r"\bthe\b", r"\bund\b").groupBy("sentiment", "is_counter", "source").agg(F.count("*").alias("n")),
    "j18_market_regime": lambda s, d: m.market_regime(docs(s, d), [("BULLISH", r"\bthis\b"), ("BEARISH", r"\bich\b")], "doc_id"),
    "j19_request_intents": lambda s, d: m.request_intents(table(s, d, "conversations").filter("role = 'user'"), [("JOBS", whole("thereof|ofthe")), ("MARKET", whole("und")), ("COMPANY", whole("que"))]).groupBy("intent").agg(F.count("*").alias("n")),
    "k2_preference_signals": lambda s, d: m.preference_signals(prefs(s, d)).withColumn("weight", F.round("weight", 6)),
    "k3_preference_boost": lambda s, d: m.preference_boost(carrier(s, d, "postings"), m.preference_signals(prefs(s, d))).withColumn("boost", F.round("boost", 6)),
    "k4_soft_boost": lambda s, d: m.soft_boost(carrier(s, d, "postings").selectExpr("record_id", "company", "CASE seq % 3 WHEN 0 THEN 'Retail' ELSE 'Banking' END AS industry", "split(skills, ',') AS skills"), m.preference_signals(prefs(s, d))).withColumn("boost", F.round("boost", 6)),
    "k5_boosted_rank": lambda s, d: m.boosted_rank(postings.rank_postings(postings.normalize_postings(carrier(s, d, "postings")), postings.JobSpec(title="Data Scientist")).select("record_id", "relevance_raw"), m.preference_lists(carrier(s, d, "postings"), m.preference_signals(prefs(s, d)))).select("user_id", "record_id", "place", F.round("final", 6).alias("final")),
    "c22_opportunity_match": lambda s, d: m.match_opportunities(seekers(s, d), openings(s, d)).select("cand", "opp", "match"),
}

SIGNALS = """
e AS (SELECT 'u' || (user_id % 20) AS user_id, CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'save' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'wrong_location' END AS action, CASE event_id % 3 WHEN 0 THEN 'generative ai engineer' WHEN 1 THEN 'sales executive' END AS title,
 'customer#' || lpad(CAST(event_id % 40 AS VARCHAR), 9, '0') AS comp, CASE event_id % 2 WHEN 0 THEN 'dubai, uae' ELSE 'remote' END AS loc, CASE event_id % 4 WHEN 0 THEN 'retail' END AS ind, CASE event_id % 3 WHEN 0 THEN 'docker' WHEN 1 THEN 'k8s' END AS skill FROM events),
u AS (SELECT user_id, action, 'title' AS type, title AS value FROM e UNION ALL SELECT user_id, action, 'comp', comp FROM e UNION ALL SELECT user_id, action, 'loc', loc FROM e UNION ALL SELECT user_id, action, 'ind', ind FROM e UNION ALL SELECT user_id, action, 'skill', skill FROM e),
w(action, polarity, type, weight) AS (VALUES ('save', 'pos', 'title', 1.0::DOUBLE), ('save', 'pos', 'comp', 0.5), ('save', 'pos', 'loc', 0.5), ('save', 'pos', 'skill', 0.8), ('wrong_location', 'neg', 'loc', 2.0), ('accepted', 'pos', 'comp', 1.0), ('accepted', 'pos', 'ind', 1.0), ('accepted', 'pos', 'skill', 0.5), ('opened', 'pos', 'comp', 0.3), ('rejected', 'neg', 'comp', 1.5), ('rejected', 'neg', 'ind', 1.5)),
sig AS (SELECT user_id, polarity, u.type AS type, value, sum(weight) AS weight FROM u JOIN w ON w.action = u.action AND w.type = u.type WHERE value IS NOT NULL GROUP BY ALL)"""
BOOST = """
att AS (SELECT record_id, 'title' AS type, lower(title) AS txt FROM postings UNION ALL SELECT record_id, 'comp', lower(company) FROM postings UNION ALL SELECT record_id, 'loc', lower(coalesce(location, '')) FROM postings UNION ALL SELECT record_id, 'skill', lower(skills) FROM postings),
met AS (SELECT DISTINCT record_id, user_id, polarity, s.type AS type, value, weight FROM att a JOIN sig s ON s.type = a.type AND contains(a.txt, s.value)),
bst AS (SELECT user_id, record_id, greatest(least(sum(CASE polarity || type WHEN 'postitle' THEN least(weight * 0.03, 0.10) WHEN 'poscomp' THEN least(weight * 0.04, 0.10) WHEN 'posloc' THEN least(weight * 0.02, 0.05) WHEN 'posskill' THEN least(weight * 0.02, 0.06) WHEN 'negtitle' THEN -least(weight * 0.05, 0.15) WHEN 'negcomp' THEN -least(weight * 0.08, 0.25) WHEN 'negloc' THEN -least(weight * 0.05, 0.15) ELSE 0 END), 0.25), -0.25) AS boost FROM met GROUP BY 1, 2)"""
SPACE = r"[\t\n\x0B\f\r ]"
HAS = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"
PASSAGES = rf"""x AS (SELECT doc_id, trim(regexp_extract(regexp_extract(text, '(?s)--- STRUCTURED PAGE METADATA ---{SPACE}*(.*?){SPACE}*--- END PAGE METADATA ---', 1), '(?m)^DESCRIPTION:(.*)$', 1)) AS told, regexp_replace(text, '(?s)--- STRUCTURED (?:JOB SCHEMA \(JSON-LD\)|PAGE METADATA) ---.*?--- END (?:STRUCTURED SCHEMA|PAGE METADATA) ---{SPACE}*', '', 'g') AS body FROM said),
 l AS (SELECT doc_id, told, regexp_replace(unnest(string_split(body, chr(10) || chr(10))), '^{SPACE}+|{SPACE}+$', '', 'g') AS p, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS pos FROM x), n AS (SELECT *, length(p) - length(replace(p, chr(10), '')) AS nl FROM l),
 q AS (SELECT doc_id, told, pos, regexp_replace(p, '{SPACE}+', ' ', 'g') AS claim FROM n WHERE length(p) > 40 AND NOT {HAS("lower(p)", m.BOILERPLATE)} AND NOT (nl > 5 AND (length(p) - nl) / (nl + 1) < 25)),
 u AS (SELECT doc_id, pos, claim, {HAS("lower(claim)", m.COUNTER_SIGNS)} AS is_counter FROM q WHERE NOT contains(told, claim) UNION ALL SELECT doc_id, 0, told, false FROM x WHERE length(told) > 30), c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, claim, is_counter FROM u)"""
COVER = """f AS (SELECT entity_id, bool_or(lower(field) IN ('revenue', 'headquarters')) AS fu FROM facts GROUP BY 1), v AS (SELECT 'E' || l_partkey AS entity_id, count(*) >= 2 AS news, bool_or(l_quantity > 48 OR l_linenumber = 7) AS counter FROM lineitem GROUP BY 1),
 g AS (SELECT 'E' || s_suppkey AS entity_id, coalesce(fu, false) AS fundamental, coalesce(news, false) AS news, coalesce(counter, false) AS counter FROM supplier LEFT JOIN f ON f.entity_id = 'E' || s_suppkey LEFT JOIN v ON v.entity_id = 'E' || s_suppkey)"""

ORACLES = {
    "j1_extract_facts": """WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS m, o_custkey AS c, CAST(trunc(o_totalprice) AS BIGINT) AS t FROM orders) SELECT doc_id, 'revenue' AS field, '₹' || t || ' crore' AS value_text, '₹ crore' AS unit FROM o WHERE m = 0 UNION ALL SELECT doc_id, 'net_profit', '$' || c || ' million', 'USD million' FROM o WHERE m = 0
 UNION ALL SELECT doc_id, 'employee_count', c || '', NULL FROM o WHERE m = 1 UNION ALL SELECT doc_id, 'founded_year', '1999', NULL FROM o WHERE m = 1 UNION ALL SELECT doc_id, 'headquarters', 'Riyadh', NULL FROM o WHERE m = 1 UNION ALL SELECT doc_id, 'operating_margin', (doc_id % 40) || '%', '%' FROM o WHERE m = 2 UNION ALL SELECT doc_id, 'experience_years', (doc_id % 9) || '', NULL FROM o WHERE m = 3 UNION ALL SELECT doc_id, 'salary', (doc_id % 30 + 5) || ' LPA', 'LPA' FROM o WHERE m = 3""",
    "j3_contradictions": oracle("""WITH b AS (SELECT entity_id, lower(field) AS field, seq, source, lower(trim(value_text)) AS v, TRY_CAST(regexp_extract(value_text, '[0-9,]+(?:\\.[0-9]+)?') AS DOUBLE) AS x FROM facts) SELECT a.entity_id, a.field, a.seq AS seq_a, b.seq AS seq_b FROM b a JOIN b ON a.entity_id = b.entity_id AND a.field = b.field AND a.seq < b.seq AND a.source <> b.source AND a.v <> b.v
 WHERE CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN abs(a.x - b.x) / greatest(a.x, b.x) > 0.05 ELSE NOT contains(a.v, b.v) AND NOT contains(b.v, a.v) END""", "facts"),
    "j4_scan_risks": """WITH l AS (SELECT doc_id, trim(unnest(string_split(replace(coalesce(text, ''), chr(10), ' '), '.'))) AS s, generate_subscripts(string_split(replace(coalesce(text, ''), chr(10), ' '), '.'), 1) AS pos FROM documents),
 h AS (SELECT doc_id, 'warm' AS risk, 'HIGH' AS severity, arg_min(substr(s, 1, 200), pos) AS sentence FROM l WHERE regexp_matches(lower(s), '{W}') GROUP BY 1 UNION ALL SELECT doc_id, 'cold', 'MEDIUM', arg_min(substr(s, 1, 200), pos) FROM l WHERE regexp_matches(lower(s), '{C}') GROUP BY 1 UNION ALL SELECT doc_id, 'odd', 'MEDIUM', arg_min(substr(s, 1, 200), pos) FROM l WHERE regexp_matches(lower(s), '{O}') GROUP BY 1)
 SELECT * FROM h UNION ALL SELECT doc_id, 'clean_disclosures', 'LOW', NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)""".replace("{W}", whole("onst|wher")).replace("{C}", whole("und|los")).replace("{O}", whole("layoffs|password")),
    "j2_claim_support": r"""WITH a AS (SELECT item_id, w, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark) WHERE length(w) > 3 GROUP BY 1, 2),
 b AS (SELECT w, doc_id FROM (SELECT DISTINCT w FROM a) JOIN documents ON contains(lower(text), w)), t AS (SELECT item_id, sum(k) AS total, list({'w': w, 'k': k}) AS tokens FROM a GROUP BY 1),
 n AS (SELECT item_id, doc_id, sum(k) AS n FROM a JOIN b ON b.w = a.w GROUP BY 1, 2), r AS (SELECT n.*, total, tokens, d.text, list_filter(list_transform(string_split(replace(d.text, chr(10), ' '), '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM n JOIN t ON t.item_id = n.item_id JOIN documents d ON d.doc_id = n.doc_id WHERE n / total >= 0.3),
 k AS (SELECT *, list_transform(ss, lambda x: coalesce(list_sum(list_transform(list_filter(tokens, lambda y: contains(lower(x), y.w)), lambda y: y.k)), 0)) AS sc FROM r), v AS (SELECT *, ss[list_position(sc, list_max(sc))] AS best FROM k)
 SELECT item_id, doc_id, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, CASE WHEN regexp_matches(lower(text), '<DENIED>') AND n / total >= 0.5 THEN CASE WHEN regexp_matches(lower(best), '<DENIED>') THEN 'CONTRADICTS' ELSE 'SUPPORTS' END WHEN n / total < 0.6 THEN 'MENTIONS' ELSE 'SUPPORTS' END AS relationship, best AS passage, CASE WHEN n / total > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM v""".replace("<DENIED>", "|".join(m.NEGATIONS)),
    "d7_entity_mentions": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) AND b.text <> ''",
    "j5_claim_passages": oracle("WITH " + PASSAGES + " SELECT * FROM c", "said"),
    "j6_evidence_split": oracle("WITH " + PASSAGES + ", b AS (SELECT 's' || (doc_id % 20) AS source, min(doc_id) AS first, count(*) FILTER (NOT is_counter) AS primary_rows, count(*) FILTER (is_counter) AS counter_rows FROM c GROUP BY 1) SELECT *, dense_rank() OVER (ORDER BY first, source) AS number FROM b", "said"),
    "e8_entity_coverage": oracle("WITH " + COVER + " SELECT entity_id, array_to_string(list_filter(['technical', CASE WHEN NOT fundamental THEN 'fundamental' END, CASE WHEN NOT news THEN 'news' END, CASE WHEN NOT counter THEN 'counter' END], lambda x: x IS NOT NULL), ',') AS missing FROM g", "facts"),
    "e8_coverage_state": oracle("WITH " + COVER + ", z AS (SELECT count(*) AS validated, CAST(0 AS BIGINT) AS technical, count(*) FILTER (fundamental) AS fundamental, count(*) FILTER (news) AS news, count(*) FILTER (counter) AS counter FROM g) SELECT *, validated >= 50 AND fundamental >= 35 AND counter >= 25 AS sufficient, round_even(least(validated + fundamental + news + counter, 200) / 200, 2) AS completion FROM z", "facts"),
    "e13_entity_sources": oracle("WITH b AS (SELECT entity_id, source FROM facts UNION ALL SELECT 'E' || l_partkey, 'src' || (l_suppkey % 9) FROM lineitem) SELECT entity_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n FROM b GROUP BY 1", "facts"),
    "j11_hiring_posts": f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_matches(lower(text), '{whole('the|des')}') AND NOT regexp_matches(lower(text), '{whole('und|que')}')",
    "j13_contact_points": oracle(rf"""WITH k AS (SELECT *, coalesce(url, '') AS u, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}'), lambda x: list_contains({m.rules.ROLE_MAILBOXES}, string_split(x, '@')[1])) AS a FROM reached),
 e AS (SELECT entity_id, doc_id AS seen, 0 AS pos, 'page' AS kind, u AS value, u AS source, 0.9 AS confidence FROM k WHERE {HAS("lower(u)", m.CONTACT_PARTS)} UNION ALL SELECT entity_id, doc_id, generate_subscripts(a, 1), 'email', unnest(a), u, 0.95 FROM k UNION ALL SELECT DISTINCT entity_id, -1, 0, 'page', 'https://' || rtrim(own, '/') || '/contact', 'own domain', 1.0 FROM reached WHERE own IS NOT NULL),
 g AS (SELECT *, row_number() OVER (PARTITION BY entity_id, value ORDER BY seen, pos) AS again FROM e) SELECT entity_id, kind, value, source, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY entity_id ORDER BY seen, pos, value) AS place FROM g WHERE again = 1""", "reached"),
    "j14_company_profiles": oracle("SELECT entity_id, arg_max(value_text, seq) FILTER (lower(field) = 'revenue') AS revenue, arg_max(value_text, seq) FILTER (lower(field) = 'headquarters') AS headquarters FROM facts GROUP BY 1", "facts"),
    "j15_price_mentions": "SELECT o_orderkey AS doc_id, CAST(o_custkey AS DOUBLE) AS current, CASE o_orderkey % 3 WHEN 0 THEN o_custkey + 10 ELSE o_custkey + 0.5::DOUBLE END AS target FROM orders WHERE o_orderkey % 3 < 2",
    "j16_ticker_mentions": UNIVERSE + r""", t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS t FROM documents)
 SELECT DISTINCT doc_id, symbol FROM t JOIN u ON t.t = u.symbol AND regexp_full_match(u.symbol, '[A-Z]{3,12}') UNION SELECT DISTINCT doc_id, symbol FROM t JOIN u ON lower(t.t) = u.alias AND NOT contains(u.alias, ' ')
 UNION SELECT doc_id, symbol FROM documents JOIN u ON contains(u.alias, ' ') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || u.alias || '([^\p{L}\p{N}_]|$)')""",
    "j17_sentiment_evidence": "SELECT 'bullish' AS sentiment, false AS is_counter, source, count(*) AS n FROM documents WHERE regexp_matches(lower(text), '\\bthe\\b') GROUP BY ALL UNION ALL SELECT 'bearish', true, source, count(*) FROM documents WHERE regexp_matches(lower(text), '\\bund\\b') GROUP BY ALL",
    "j18_market_regime": "SELECT coalesce(arg_max(CASE WHEN regexp_matches(lower(text), '\\bthis\\b') THEN 'BULLISH' ELSE 'BEARISH' END, doc_id), 'SIDEWAYS') AS regime FROM documents WHERE regexp_matches(lower(text), '\\b(this|ich)\\b')",
    "j19_request_intents": f"SELECT CASE WHEN regexp_matches(lower(text), '{whole('thereof|ofthe')}') THEN 'JOBS' WHEN regexp_matches(lower(text), '{whole('und')}') THEN 'MARKET' WHEN regexp_matches(lower(text), '{whole('que')}') THEN 'COMPANY' ELSE 'GENERAL' END AS intent, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "k2_preference_signals": "WITH " + SIGNALS + " SELECT user_id, polarity, type, value, round(weight, 6) AS weight FROM sig",
    "k3_preference_boost": oracle("WITH " + SIGNALS + "," + BOOST + " SELECT user_id, record_id, round(boost, 6) + 0 AS boost FROM bst", "postings"),
    "k4_soft_boost": oracle("WITH " + SIGNALS + """, att AS (SELECT record_id, 'comp' AS type, lower(trim(company)) AS value FROM postings UNION SELECT record_id, 'ind', CASE seq % 3 WHEN 0 THEN 'retail' ELSE 'banking' END FROM postings UNION SELECT record_id, 'skill', lower(trim(unnest(string_split(skills, ',')))) FROM postings)
 SELECT user_id, record_id, round(greatest(least(sum(weight * CASE polarity || att.type WHEN 'poscomp' THEN 0.02 WHEN 'negcomp' THEN -0.03 WHEN 'posind' THEN 0.01 WHEN 'negind' THEN -0.02 WHEN 'posskill' THEN 0.01 ELSE 0 END), 0.05), -0.05), 6) AS boost FROM att JOIN sig ON sig.type = att.type AND sig.value = att.value GROUP BY 1, 2""", "postings"),
    "c22_opportunity_match": """WITH s AS (SELECT s_suppkey AS cand, s_nationkey % 5 AS g, CASE s_suppkey % 4 WHEN 0 THEN ['sql', 'python'] WHEN 1 THEN ['sql'] WHEN 2 THEN ['machine learning'] ELSE [] END AS need, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 9 END AS y, CASE WHEN s_suppkey % 6 > 0 THEN n_name END AS w FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 c AS (SELECT c_custkey AS opp, c_nationkey % 5 AS g, CASE c_custkey % 4 WHEN 0 THEN ['sql'] WHEN 1 THEN ['sql', 'go'] WHEN 2 THEN ['golang'] ELSE [] END AS own, lower(CASE c_custkey % 5 WHEN 1 THEN 'Python developer' WHEN 3 THEN 'Machine learning engineer' ELSE 'Engineer' END || '/' || coalesce(CASE c_custkey % 3 WHEN 0 THEN 'PostgreSQL databases, Spark' WHEN 1 THEN c_mktsegment END, '')) AS said, CASE c_custkey % 11 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Worldwide' WHEN 2 THEN NULL ELSE n_name END AS l, c_custkey % 12 AS years FROM customer JOIN nation ON n_nationkey = c_nationkey)
 SELECT cand, opp, round(least(1.0, 0.5 + CASE WHEN w IS NULL THEN 0 ELSE 0.2 END + 0.1 * len(need) + 0.05 * len(list_filter(['spark', 'go'], lambda x: contains(said, x) OR list_contains(own, x)))), 2)::DOUBLE AS match FROM s JOIN c ON s.g = c.g WHERE len(list_filter(need, lambda x: NOT contains(said, x) AND NOT list_contains(own, x))) = 0 AND (y IS NULL OR years <= y + 1) AND (w IS NULL OR l = 'Worldwide' OR contains(l, w) OR contains(w, l))""",
}
