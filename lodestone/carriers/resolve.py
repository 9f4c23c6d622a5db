"""Queries over deduplication and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.carriers.base import carrier, oracle, table
from lodestone.operators import news
from lodestone.operators import resolve as m


def P(s, d):
    return carrier(s, d, "postings")


def clusters(s, d):
    """A cluster map that SQL can state: the first posting of each company and title."""
    first = P(s, d).groupBy("company", "title").agg(F.min("seq").cast("string").alias("primary_id"))
    return P(s, d).select("record_id", "company", "title").join(first, ["company", "title"]).select("record_id", "primary_id")


def single_key(s, d):
    """Records whose only key is their identity key and whose titles are the same."""
    return P(s, d).select("record_id", "seq", F.lit("Engineer").alias("title"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("location"), "source", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("application_url"), F.concat(F.lit("K"), F.col("seq") % 900).alias("identity_key"))


def universe(s, d):
    return table(s, d, "part").selectExpr("concat('SYM', p_partkey) AS symbol", "CASE WHEN p_partkey % 2 = 0 THEN concat('supplier#', lpad(CAST(p_partkey AS STRING), 9, '0')) END AS alias", "p_partkey AS ord")


def cands(s, d):
    return table(s, d, "lineitem").selectExpr("concat('SYM', l_suppkey) AS symbol", "CASE WHEN l_linenumber > 2 THEN l_extendedprice END AS current_price", "CASE WHEN l_linenumber > 3 THEN l_discount END AS change_1w", "CASE WHEN l_linenumber > 1 THEN l_quantity END AS volume", "CASE WHEN l_returnflag = 'A' THEN 'IT' END AS sector", "concat('s', l_partkey % 6) AS source", "concat(l_returnflag, l_linestatus) AS claim", "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq")


AS_OF = "2026-03-12 00:00:00"

QUERIES = {
    "i1_dedupe_records": lambda s, d: m.dedupe_records(P(s, d)),
    "i1_dedupe_single_key": lambda s, d: m.dedupe_records(single_key(s, d)),
    "i1_dedupe_two_keys": lambda s, d: m.dedupe_records(carrier(s, d, "rivals")),
    "i2_dedupe_postings": lambda s, d: m.dedupe_postings(P(s, d).withColumn("job_id", F.concat(F.lit("J"), (F.col("seq") % 700).cast("string")))),
    "i2_dedupe_by_city": lambda s, d: m.dedupe_postings(carrier(s, d, "rivals").withColumn("job_id", F.concat("job_id", F.lit("-"), F.col("seq") % 2))),
    "i3_compatible_titles": lambda s, d: m.title_pairs(table(s, d, "part").withColumn("title", F.concat_ws(" ", "p_name", "p_type")), "p_partkey", "title", ["p_size", "p_brand"]),
    "i4_primary_url": lambda s, d: m.primary_url(clusters(s, d), P(s, d)),
    "i5_merge_evidence": lambda s, d: m.merge_evidence(clusters(s, d), carrier(s, d, "evidence")).groupBy("record_id").agg(F.count("*").alias("n")),
    "i6_resolve_stocks": lambda s, d: m.resolve_stocks(carrier(s, d, "mentions").withColumn("name", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("sym"), F.col("seq") % 80, F.lit(".NS"))).otherwise(F.col("name"))), universe(s, d), ["customer#000000001"]).select("seq", "symbol"),
    "i7_resolve_companies": lambda s, d: m.resolve_companies(carrier(s, d, "mentions")).select("key", "canonical", "domain", "n", F.array_join("aliases", "|").alias("aliases")),
    "i8_resolve_postings": lambda s, d: m.resolve_postings(P(s, d)),
    "i9_resolve_people": lambda s, d: m.resolve_people(table(s, d, "customer").selectExpr("c_custkey AS seq", "concat('P', c_custkey % 50) AS name", "c_mktsegment AS company", "CASE WHEN c_custkey % 9 = 0 THEN concat('https://X/in/p', c_custkey % 30, '/') END AS profile", "concat('role', c_nationkey % 3) AS role")),
    "i10_validate_symbols": lambda s, d: m.validate_symbols(carrier(s, d, "mentions").withColumn("name", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("sym"), F.col("seq") % 80, F.lit(".NS"))).otherwise(F.col("name"))), universe(s, d), ["customer"], ["000005"]).select("seq", "kind"),
    "i11_merge_candidates": lambda s, d: m.merge_candidates(cands(s, d)),
    "i12_cluster_news": lambda s, d: news.cluster_news(carrier(s, d, "articles")),
    "i12_news_events": lambda s, d: news.news_events(carrier(s, d, "articles").withColumn("entities", F.split("names", ",")), AS_OF),
}

BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\b(ltd|limited|inc|incorporated|corp|corporation|llc|pvt|private|co|company|plc|sa)\b', '', 'g'), '[.,\-]', ' ', 'g'), '\s+', ' ', 'g'))"
CL = "cl AS (SELECT record_id, CAST(min(seq) OVER (PARTITION BY company, title) AS VARCHAR) AS primary_id, seq, coalesce(application_url, url) AS u FROM postings)"
GOOD = "CASE WHEN regexp_matches(lower(u), 'greenhouse.io|lever.co|ashbyhq.com|workable.com') THEN 0 WHEN regexp_matches(lower(u), 'indeed.com|linkedin.com|bayt.com') THEN 1 WHEN regexp_matches(lower(u), '/careers|/jobs') THEN 0 ELSE 1 END"
NAMES = "n AS (SELECT seq, CASE WHEN seq % 7 = 0 THEN 'sym' || (seq % 80) || '.NS' ELSE name END AS name FROM mentions)"
STOP = ", ".join(f"'{w}'" for w in m.TITLE_NOISE)

# Both ordered rules as they read: one record after the other, with what has been kept so far.
FIRST_FIT = r"""WITH t AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}'))) AS w FROM articles),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS hit, CAST([] AS STRUCT(seq BIGINT, w VARCHAR[])[]) AS heads UNION ALL
 SELECT i, seq, coalesce(found, seq), CASE WHEN found IS NULL THEN list_append(heads, {'seq': seq, 'w': w}) ELSE heads END
 FROM (SELECT t.i AS i, t.seq AS seq, t.w AS w, r.heads AS heads, list_filter(r.heads, lambda h: len(list_intersect(h.w, t.w)) >= 3 OR (len(t.w) > 0 AND len(list_intersect(h.w, t.w)) / len(t.w) >= 0.5))[1].seq AS found FROM r JOIN t ON t.i = r.i + 1))"""
HAS = lambda words: "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda x: contains(low, x)))"
EVENTS = f""", j AS (SELECT hit AS cluster, t.*, CASE WHEN trim(coalesce(summary, '')) = '' AND t.seq = hit THEN trim(title) ELSE trim(coalesce(summary, '')) END AS s FROM r JOIN t ON t.seq = r.seq),
g AS (SELECT cluster, CASE WHEN trim(arg_min(title, seq)) = '' THEN '{news.UNTITLED}' ELSE trim(arg_min(title, seq)) END AS title, first(s ORDER BY length(s) DESC, seq) AS summary, first(date ORDER BY seq) AS date, count(*) AS articles,
 coalesce(list_filter(list(url ORDER BY seq), lambda x: x IS NOT NULL), []) AS urls, list(string_split(names, ',') ORDER BY seq) AS ns FROM j GROUP BY 1),
o AS (SELECT *, lower(title || ' ' || summary) AS low, list_filter(urls, lambda x, i: list_position(urls, x) = i) AS sources, list_filter(flatten(ns), lambda x, i: list_position(flatten(ns), x) = i) AS entities,
 epoch(TIMESTAMP '2026-03-12') - epoch(CASE WHEN date = 'soon' THEN NULL WHEN contains(date, '/') THEN strptime(date, '%d/%m/%Y') ELSE CAST(replace(replace(date, 'T', ' '), 'Z', '') AS TIMESTAMP) END) AS age FROM g)
SELECT cluster, title, summary, entities, date, sources, CASE WHEN {HAS(news.GOOD)} > {HAS(news.BAD)} THEN 'positive' WHEN {HAS(news.BAD)} > {HAS(news.GOOD)} THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN {HAS(news.IMPACT)} > 0 THEN 'high' WHEN len(sources) >= 2 THEN 'medium' ELSE 'low' END AS impact,
 CASE WHEN age IS NULL THEN 'UNKNOWN' WHEN age <= 86400 THEN 'FRESH' WHEN age <= 259200 THEN 'AGING' WHEN age <= 604800 THEN 'STALE' ELSE 'EXPIRED' END AS freshness, round(least(1.0, 0.7 + 0.1 * len(sources)), 2)::DOUBLE AS confidence, articles FROM o"""
PLAIN = "list_filter(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')), lambda w: w NOT IN (" + STOP + "))"
CLOSE = "(regexp_replace(lower(h.title), '[^a-z0-9]', '', 'g') = cc OR (contains(regexp_replace(lower(h.title), '[^a-z0-9]', '', 'g'), cc) OR contains(cc, regexp_replace(lower(h.title), '[^a-z0-9]', '', 'g'))) AND least(length(cc), length(regexp_replace(lower(h.title), '[^a-z0-9]', '', 'g'))) / greatest(length(cc), length(regexp_replace(lower(h.title), '[^a-z0-9]', '', 'g'))) >= 0.75 OR len(list_intersect(ww, {H})) / len(list_distinct(list_concat(ww, {H}))) >= 0.5)".replace("{H}", PLAIN.format("h.title"))


def replayed(keys: list[str]) -> str:
    """The holders' rule over all companies side by side, record by record: entries in front win, so a primary puts its own in front, a duplicate behind."""
    listed = "list_filter([" + ", ".join(keys) + "], lambda k: k IS NOT NULL)"
    return oracle(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY seq) AS i, {listed} AS keys, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS cc, {PLAIN.format('title')} AS ww FROM rivals),
r AS (SELECT DISTINCT CAST(0 AS BIGINT) AS i, company, CAST(NULL AS VARCHAR) AS record_id, CAST(NULL AS VARCHAR) AS primary_id, CAST([] AS STRUCT(k VARCHAR, rec VARCHAR, title VARCHAR)[]) AS held FROM t UNION ALL
 SELECT i, company, record_id, coalesce(found.rec, record_id), CASE WHEN found IS NULL THEN list_concat(list_transform(keys, lambda k: {{'k': k, 'rec': record_id, 'title': title}}), held) ELSE list_concat(held, list_transform(keys, lambda k: {{'k': k, 'rec': found.rec, 'title': found.title}})) END
 FROM (SELECT t.*, r.held AS held, list_filter(list_transform(t.keys, lambda k: list_filter(r.held, lambda e: e.k = k)[1]), lambda h: h IS NOT NULL AND {CLOSE})[1] AS found FROM r JOIN t ON t.company = r.company AND t.i = r.i + 1)) SELECT record_id, primary_id FROM r WHERE i > 0""", "rivals").replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "i1_dedupe_single_key": oracle("SELECT record_id, CAST(min(seq) OVER (PARTITION BY seq % 900) AS VARCHAR) AS primary_id FROM postings", "postings"),
    "i3_compatible_titles": f"""WITH t AS (SELECT p_partkey AS k, p_size || '/' || p_brand AS p_size, p_name || ' ' || p_type AS x FROM part), u AS (SELECT *, regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS c, list_filter(list_distinct(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda w: w <> '')), lambda w: w NOT IN ({STOP})) AS w FROM t)
 SELECT a.k AS a, b.k AS b, a.c = b.c OR (contains(a.c, b.c) OR contains(b.c, a.c)) AND least(length(a.c), length(b.c)) / greatest(length(a.c), length(b.c)) >= 0.75 OR len(a.w) = 0 OR len(b.w) = 0 OR len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.5 AS ok FROM u a JOIN u b ON a.p_size = b.p_size AND a.k < b.k""",
    "i4_primary_url": oracle(f"WITH {CL} SELECT primary_id, arg_min(u, ({GOOD}) * 1000000000 + seq) AS primary_url, count(*) AS n FROM cl WHERE u IS NOT NULL GROUP BY 1", "postings"),
    "i5_merge_evidence": oracle(f"WITH {CL}, e AS (SELECT DISTINCT primary_id, field_name, document_id, evidence_text FROM cl JOIN evidence USING (record_id)) SELECT primary_id AS record_id, count(*) AS n FROM e GROUP BY 1", "postings", "evidence"),
    "i6_resolve_stocks": oracle(f"WITH {NAMES}, u AS (SELECT 'SYM' || p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'supplier#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS alias FROM part), r AS (SELECT seq, coalesce(a.symbol, b.symbol) AS symbol FROM (SELECT * FROM n WHERE NOT contains(lower(name), 'customer#000000001')) n LEFT JOIN (SELECT DISTINCT symbol FROM u) a ON a.symbol = trim(string_split(upper(name), '.')[1]) LEFT JOIN u b ON contains(lower(name), b.alias)) SELECT seq, symbol FROM r WHERE symbol IS NOT NULL", "mentions"),
    "i7_resolve_companies": oracle(f"WITH r AS (SELECT *, regexp_replace(lower(trim(domain)), '^(https?://)?(www\\.)?', '') AS d FROM mentions), k AS (SELECT *, CASE WHEN coalesce(d, '') <> '' THEN 'domain::' || d WHEN coalesce(symbol, '') <> '' THEN 'symbol::' || lower(symbol) ELSE 'name::' || lower({BARE}) END AS key FROM r) SELECT key, arg_min(name, seq) AS canonical, max(d) AS domain, count(*) AS n, array_to_string(list_sort(list(DISTINCT name)), '|') AS aliases FROM k GROUP BY 1", "mentions"),
    "i8_resolve_postings": oracle("WITH k AS (SELECT *, coalesce(regexp_replace(application_url, '\\?.*$', ''), regexp_replace(lower(company), '[^a-z0-9]', '', 'g') || '::' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') || '::' || regexp_replace(lower(coalesce(location, '')), '[^a-z0-9]', '', 'g')) AS key FROM postings) SELECT key, arg_min(title, seq) AS canonical, count(DISTINCT title) AS n_names, count(*) AS n FROM k GROUP BY 1", "postings"),
    "i9_resolve_people": "WITH p AS (SELECT c_custkey AS seq, 'P' || (c_custkey % 50) AS name, c_mktsegment AS company, CASE WHEN c_custkey % 9 = 0 THEN 'https://x/in/p' || (c_custkey % 30) END AS profile, 'role' || (c_nationkey % 3) AS role FROM customer), k AS (SELECT *, coalesce(profile, lower(name) || '@' || lower(company)) AS key FROM p) SELECT key, arg_min(name, seq) AS name, arg_min(company, seq) AS company, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM k GROUP BY 1",
    "i10_validate_symbols": oracle(f"WITH {NAMES} SELECT seq, CASE WHEN contains(lower(name), 'customer') THEN 'source' WHEN contains(lower(name), '000005') THEN 'index' WHEN regexp_matches(lower(name), '^sym[0-9]+\\.ns$') AND CAST(regexp_extract(lower(name), '[0-9]+') AS INT) <= (SELECT max(p_partkey) FROM part) THEN 'stock' ELSE 'company' END AS kind FROM n", "mentions"),
    "i11_merge_candidates": "WITH c AS (SELECT 'SYM' || l_suppkey AS symbol, *, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq FROM lineitem) SELECT symbol, arg_min(l_extendedprice, seq) FILTER (l_linenumber > 2) AS current_price, arg_min(l_discount, seq) FILTER (l_linenumber > 3) AS change_1w, arg_min(l_quantity, seq) FILTER (l_linenumber > 1) AS volume, CASE WHEN bool_or(l_returnflag = 'A') THEN 'IT' END AS sector, count(DISTINCT l_partkey % 6) AS sources, count(DISTINCT lower(l_returnflag || l_linestatus)) AS claims FROM c GROUP BY 1",
    "i1_dedupe_two_keys": replayed(["'ident::' || identity_key", "'sid::src::' || job_id", "'fp::' || company || title || coalesce(location, '')", "'fpt::' || company || title"]),
    "i2_dedupe_by_city": replayed(["'sid::src::' || job_id || '-' || (seq % 2)", "'fp::' || company || title || coalesce(location, '')", "'fp_city::' || company || title || city", "'fpt::' || company || title"]),
    "i12_cluster_news": oracle(FIRST_FIT + " SELECT seq, hit AS cluster FROM r WHERE i > 0", "articles").replace("WITH ", "WITH RECURSIVE ", 1),
    "i12_news_events": oracle(FIRST_FIT + EVENTS, "articles").replace("WITH ", "WITH RECURSIVE ", 1),
}
