"""Queries over hits, URLs and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.carriers.base import carrier, oracle, table
from lodestone.functions import rules
from lodestone.operators import web


def hits(s, d):
    return carrier(s, d, "hits")


def any_of(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def tier_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({col})', t)} THEN {k}" for k, t in rules.SEARCH_TIERS.items()) + " ELSE 4 END"


def category_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({col})', t)} THEN '{k}'" for k, t in rules.SOURCE_CATEGORIES.items()) + " ELSE 'company_careers' END"


HOST = "regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"
PATH = "regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
CANON = f"""'https://' || {HOST} || CASE WHEN length({PATH}) > 1 THEN regexp_replace({PATH}, '/+$', '') ELSE {PATH} END ||
 coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract({{0}}, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT list_contains([{", ".join(f"'{t}'" for t in rules.TRACKING_PARAMS)}], lower(string_split(x, '=')[1])))), 'string_agg', '&'), ''), '')"""

QUERIES = {
    "b1_canonical_urls": lambda s, d: web.canonical_urls(hits(s, d)).select("seq", "canonical_url"),
    "b2_url_kind": lambda s, d: web.url_kind(hits(s, d), "link").select("seq", "is_board"),
    "b3_source_labels": lambda s, d: web.label_sources(hits(s, d), "link").select("seq", "search_tier", "source_category", "market_tier", "market_name"),
    "b14_source_domains": lambda s, d: web.source_domains(hits(s, d)),
    "c13_posting_urls": lambda s, d: web.posting_urls(hits(s, d), "link", mock_hosts=False).select("seq", "link"),
    "c14_drop_ads": lambda s, d: web.drop_ads(hits(s, d), "link").select("seq"),
    "c17_domain_policy": lambda s, d: web.domain_policy(hits(s, d), ["example.com", "example.net"], ["blog.tionsh.example.net", "ththre.example.com"]).select("seq"),
    "h1_unseen_hits": lambda s, d: web.unseen(hits(s, d).filter("wave <> 'wave0'"), web.canonical_urls(hits(s, d).filter("wave = 'wave0'"))).select("canonical_url", "seq"),
    "e4_source_distribution": lambda s, d: web.source_distribution(hits(s, d), "link"),
    "e7_coverage_matrix": lambda s, d: web.coverage_matrix(hits(s, d), "link", "wave"),
    "g7_tiered_topn": lambda s, d: web.tiered_top(hits(s, d), 5, url="link").select("wave", "seq", "tier", "place"),
    "g8_location_first_queue": lambda s, d: web.location_first(hits(s, d), "uae", "link", 25).select("seq", "local"),
    "a7_page_links": lambda s, d: web.page_links(table(s, d, "pages")),
    "a6_page_titles": lambda s, d: web.page_titles(table(s, d, "pages")),
    "c18_contact_policy": lambda s, d: web.emails(table(s, d, "documents")).select("doc_id", "email", "is_role", "digest"),
    "d9_suppression_filter": lambda s, d: web.suppress(web.emails(table(s, d, "documents")), web.emails(table(s, d, "documents")).filter("doc_id % 3 = 0").select("digest", F.when(F.col("doc_id") % 2 == 0, F.timestamp_seconds(F.lit(0))).alias("expires_at")), "2020-01-01").select("doc_id", "email"),
}

BOARD = """WITH p AS (SELECT seq, lower(link) AS u, regexp_extract(lower(link), '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_replace(regexp_extract(lower(link), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM hits),
q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
SELECT seq, CASE WHEN len(parts) = 0 THEN true WHEN contains(host, 'greenhouse.io') THEN NOT (regexp_matches(path, '/jobs/[0-9]+') OR regexp_matches(path, '/job\\b') OR regexp_matches(u, 'gh_jid=[0-9]+'))
 WHEN contains(host, 'lever.co') OR contains(host, 'ashbyhq.com') THEN len(parts) < 2 WHEN contains(host, 'workable.com') THEN NOT regexp_matches(path, '/j/[a-z0-9]+')
 ELSE parts[-1] IN ('careers', 'jobs', 'openings', 'vacancies', 'all-jobs', 'positions', 'search', 'browse') END AS is_board FROM q"""
EMAILS = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}')) AS email FROM documents"
ROLES = ", ".join(f"'{r}'" for r in rules.ROLE_MAILBOXES)
MARKET = "CASE " + " ".join(f"WHEN contains(lower(link), '{m}') THEN {t}" for t, m, _ in rules.MARKET_TIERS) + " ELSE 4 END"
MARKET_NAME = "CASE " + " ".join(f"WHEN contains(lower(link), '{m}') THEN '{n}'" for _, m, n in rules.MARKET_TIERS) + " ELSE 'External Web Source' END"

ORACLES = {
    "b1_canonical_urls": oracle(f"SELECT seq, {CANON.format('url')} AS canonical_url FROM hits", "hits"),
    "b2_url_kind": oracle(BOARD, "hits"),
    "b3_source_labels": oracle(f"SELECT seq, {tier_case('link')} AS search_tier, {category_case('link')} AS source_category, {MARKET} AS market_tier, {MARKET_NAME} AS market_name FROM hits", "hits"),
    "b14_source_domains": oracle(f"SELECT DISTINCT {HOST.format('url')} AS domain FROM hits", "hits"),
    "c13_posting_urls": oracle("SELECT seq, link FROM hits WHERE seq % 5 IN (0, 2, 4) OR seq % 5 = 1 AND NOT regexp_matches(link, '-\\d+-jobs|jobs-in-|\\b\\d+-|-jobs') OR seq % 5 = 3", "hits"),
    "c14_drop_ads": oracle(f"SELECT seq FROM hits WHERE NOT {any_of('lower(link)', rules.AD_MARKS)}", "hits"),
    "c17_domain_policy": oracle(f"WITH h AS (SELECT seq, {HOST.format('url')} AS host FROM hits) SELECT seq FROM h WHERE (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.net' OR host LIKE '%.example.net') AND NOT (host = 'blog.tionsh.example.net' OR host LIKE '%.blog.tionsh.example.net' OR host = 'ththre.example.com' OR host LIKE '%.ththre.example.com')", "hits"),
    "h1_unseen_hits": oracle(f"WITH c AS (SELECT seq, wave, {CANON.format('url')} AS canonical_url FROM hits) SELECT canonical_url, min(seq) AS seq FROM c WHERE wave <> 'wave0' AND canonical_url NOT IN (SELECT canonical_url FROM c WHERE wave = 'wave0') GROUP BY 1", "hits"),
    "e4_source_distribution": oracle(f"SELECT {category_case('link')} AS category, count(*) AS n FROM hits GROUP BY 1", "hits"),
    "e7_coverage_matrix": oracle(f"WITH c AS (SELECT {category_case('link')} AS category, wave FROM hits), d AS (SELECT unnest(['direct_ats', 'regional_board', 'major_board', 'company_careers']) AS category) SELECT d.category, count(c.wave) AS n, count(DISTINCT c.wave) AS regions FROM d LEFT JOIN c ON c.category = d.category GROUP BY 1", "hits"),
    "g7_tiered_topn": oracle(f"WITH t AS (SELECT wave, seq, {tier_case('link')} AS tier FROM hits), r AS (SELECT *, row_number() OVER (PARTITION BY wave ORDER BY tier, seq) AS place FROM t) SELECT * FROM r WHERE place <= 5", "hits"),
    "g8_location_first_queue": oracle("SELECT seq, CAST(contains(lower(link), 'uae') AS INT) AS local FROM hits ORDER BY 2 DESC, 1 LIMIT 25", "hits"),
    "a7_page_links": """WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, unnest(list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href="([^"#]+)', 1))) AS href FROM pages),
 a AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN 'https:' || href WHEN href LIKE '/%' THEN root || href ELSE root || '/' || href END AS link FROM h) SELECT DISTINCT page_id, link FROM a WHERE regexp_matches(link, '^https?://')""",
    "a6_page_titles": """SELECT page_id, trim(CASE WHEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' THEN regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)
 ELSE regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g') END) AS title, CAST((length(html) - length(replace(html, '<a ', ''))) / 3 AS BIGINT) AS n_links FROM pages""",
    "c18_contact_policy": f"WITH e AS ({EMAILS}) SELECT doc_id, email, string_split(email, '@')[1] IN ({ROLES}) AS is_role, sha256(email) AS digest FROM e",
    "d9_suppression_filter": f"WITH e AS ({EMAILS}) SELECT doc_id, email FROM e WHERE email NOT IN (SELECT email FROM e WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0)",
}
