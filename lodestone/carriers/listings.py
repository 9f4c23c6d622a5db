"""Queries over the listing store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.carriers.base import carrier, oracle, table
from lodestone.carriers.web import CANON
from lodestone.operators import listings as m
from lodestone.operators import postings

P = lambda s, d: carrier(s, d, "postings")
A = lambda s, d: carrier(s, d, "applications")


def docs_of(s, d):
    return table(s, d, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("document_id"), F.concat(F.lit("run"), (F.col("user_id") % 7).cast("string")).alias("run_id"), F.expr("CASE event_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 410 ELSE 200 END").alias("http_status"), F.expr("CASE WHEN event_id % 4 = 0 THEN 'Sorry, this job has expired' ELSE 'open role' END").alias("text"), F.col("ts").alias("retrieved_at"), F.col("event_id").alias("n"))


DOCS = "docs AS (SELECT 'd' || user_id AS document_id, 'run' || (user_id % 7) AS run_id, CASE event_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 410 ELSE 200 END AS http_status, CASE WHEN event_id % 4 = 0 THEN 'Sorry, this job has expired' ELSE 'open role' END AS text, ts AS retrieved_at, event_id AS n FROM events)"

RATES = ["acceptance_rate", "field_completeness", "evidence_coverage", "duplicate_rate", "conflict_rate"]
PLACES = ["Dubai", "Saudi Arabia", "Tokyo", "Remote"]
REQUIRED = ["title", "company", "location", "salary"]


def told(s, d):
    """Postings with bounds of experience; those of one run never qualify."""
    return P(s, d).selectExpr("*", "CASE WHEN seq % 5 > 2 THEN seq % 4 END AS experience_min", "CASE WHEN seq % 10 = 1 THEN 5 END AS experience_max", "status = 'verified' AND run_id <> 'run3' AS qualified")


def coverage(s, d):
    runs = table(s, d, "events").groupBy((F.col("user_id") % 8).alias("k")).agg(F.count("*").alias("n"))
    runs = runs.selectExpr("concat('run', k) AS run_id", "CAST(n % 100 + IF(k = 4, 150, 0) AS INT) AS search_calls", "IF(k = 6, 400, 20) AS fetch_calls", "CASE WHEN k = 6 THEN TIMESTAMP '2026-01-01' WHEN k > 0 THEN TIMESTAMP '2027-01-01' END AS deadline")
    tasks = table(s, d, "events").selectExpr("concat('run', user_id % 8) AS run_id", "CASE user_id % 8 WHEN 1 THEN IF(event_id % 2 = 0, 'completed', 'pending') WHEN 2 THEN 'partial' WHEN 3 THEN 'failed' WHEN 7 THEN 'blocked' ELSE 'completed' END AS state")
    return m.run_coverage(runs, told(s, d), tasks, PLACES, 1000000, "2026-06-01")


def calls(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("tool"), F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("domain"), F.col("value").alias("duration"), (F.col("event_id") % 6 == 0).alias("failed"))


def sketched(s, d):
    """The roll-up of stored sketches beside the exact quantiles 3.3 % of the rows to either side."""
    exact = calls(s, d).rollup("tool", "domain").agg(F.percentile("duration", [0.467, 0.533]).alias("near50"), F.percentile("duration", [0.917, 0.983]).alias("near95"))
    a, b = m.ops_rollup(m.ops_sketches(calls(s, d))).alias("a"), exact.alias("b")
    both = a.join(b, F.col("a.tool").eqNullSafe(F.col("b.tool")) & F.col("a.domain").eqNullSafe(F.col("b.domain")))
    return both.select("a.tool", "a.domain", "n", "errors", F.col("p50").between(F.col("near50")[0], F.col("near50")[1]).alias("p50_holds"), F.col("p95").between(F.col("near95")[0], F.col("near95")[1]).alias("p95_holds"))


QUERIES = {
    "a11_document_upsert": lambda s, d: m.upsert(docs_of(s, d).filter("n % 2 = 0").groupBy("document_id").agg(F.max("retrieved_at").alias("at"), F.min("n").alias("id"), F.max("http_status").alias("status")), docs_of(s, d).filter("n % 2 = 1").groupBy("document_id").agg(F.max("retrieved_at").alias("at"), F.min("n").alias("id"), F.max("http_status").alias("status")), ["document_id"], ["id"], "at"),
    "a12_record_upsert": lambda s, d: m.upsert_records(P(s, d), docs_of(s, d)).select("record_id", "document_id"),
    "d1_listing_detail": lambda s, d: m.listing_detail(P(s, d), A(s, d), carrier(s, d, "evidence")).select("record_id", "applied_status", "interview_status", "n_evidence"),
    "d2_saved_listings": lambda s, d: m.saved_listings(A(s, d), P(s, d)).select("record_id", "user_id", "title"),
    "d3_applications": lambda s, d: m.saved_listings(A(s, d).filter("applied_status = 'applied'"), P(s, d)).select("record_id", "user_id", "company"),
    "d4_exclude_ignored": lambda s, d: m.drop_ignored(P(s, d), A(s, d).filter("user_id = 'u1'")).select("record_id"),
    "d5_records_with_evidence": lambda s, d: m.with_evidence(P(s, d).filter("status = 'verified'"), carrier(s, d, "evidence")).select("record_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws("/", e["field_name"], e["document_id"], e["evidence_text"])), ";").alias("nested")),
    "d6_pending_changes": lambda s, d: m.pending_changes(A(s, d).withColumn("notified", F.col("interview_status") == "scheduled"), P(s, d)).select("record_id", "applied_status", "title"),
    "d8_profile_lookup": lambda s, d: m.profile_lookup(P(s, d).select("record_id", "company"), table(s, d, "customer").select(F.col("c_name").alias("company"), F.col("c_mktsegment").alias("profile"), F.col("c_custkey").alias("updated_at"))).select("record_id", "profile"),
    "d10_saved_listing_health": lambda s, d: m.listing_health(P(s, d).select("record_id", "document_id"), docs_of(s, d)),
    "c19_listing_filters": lambda s, d: m.listing_filters(P(s, d), "engineer customer", ["verified"], ["Dubai, UAE", "Remote"], 60).select("record_id"),
    "c20_listing_eligibility": lambda s, d: m.eligible_listings(P(s, d)).select("record_id"),
    "e1_listing_count": lambda s, d: m.listing_count(P(s, d)),
    "e5_run_diagnostics": lambda s, d: m.run_diagnostics(P(s, d)),
    "e6_coverage_report": lambda s, d: m.coverage_report(told(s, d), PLACES),
    "e6_run_coverage": lambda s, d: coverage(s, d).withColumns({"weak_areas": F.array_join("weak_areas", ","), "budgets_reached": F.array_join("budgets_reached", ",")}).drop("deadline"),
    "e9_facet_counts": lambda s, d: m.facets(P(s, d), {"company": 120, "location": 80}),
    "e10_status_totals": lambda s, d: m.status_totals(A(s, d)),
    "e14_ops_metrics": lambda s, d: m.ops_metrics(calls(s, d)).withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6)).withColumn("error_rate", F.round("error_rate", 9)),
    "e14_sketch_rollup": sketched,
    "e14_quality_metrics": lambda s, d: m.quality_metrics(P(s, d), carrier(s, d, "evidence"), REQUIRED).select("run_id", "n", *[F.round(x, 9).alias(x) for x in RATES]),
    "e14_run_rates": lambda s, d: m.run_rates(coverage(s, d)),
    "f1_latest_listing": lambda s, d: m.latest_listing(P(s, d)).select("record_id"),
    "g3_page_listings": lambda s, d: m.page(P(s, d), 50, 100).select("record_id"),
    "g3_page_after": lambda s, d: m.page_after(P(s, d), "1997-05-28", 500, 40).select("record_id"),
    "g4_recent_rows": lambda s, d: m.page(P(s, d), 20, 0).select("record_id", "run_id"),
    "g6_cap_results": lambda s, d: m.cap(P(s, d), 10, "run_id", [F.desc_nulls_last("confidence"), "seq"]).select("run_id", "record_id", "place"),
    "h2_merge_sources": lambda s, d: m.merge_sources(*[postings.identity_keys(P(s, d).filter(f"source = '{x}'")) for x in ("greenhouse", "linkedin", "bayt", "careers", "lever.co", "indeed")]).select("record_id"),
    "h3_unprocessed": lambda s, d: m.unprocessed(P(s, d), A(s, d).filter("applied_status = 'applied'"), P(s, d).filter("status = 'rejected'")).select("record_id"),
    "h5_cascade_delete": lambda s, d: m.cascade_delete({"records": P(s, d).withColumn("identity_key", F.when(F.col("seq") % 3 > 0, F.concat("document_id", "source"))), "evidence": carrier(s, d, "evidence")}, P(s, d).filter("seq % 1000 = 4").select("record_id"))["evidence"].groupBy("field_name").agg(F.count("*").alias("n")),
    "h6_retention_sweep": lambda s, d: m.retention(table(s, d, "events"), "ts", {"view": 10, "click": 3}, "event_type", "2024-01-31").groupBy("event_type").agg(F.count("*").alias("n")),
    "a14_csv_escaping": lambda s, d: m.csv_cells(table(s, d, "events").select("event_id", F.expr("CASE event_id % 6 WHEN 0 THEN concat('=cmd', props) WHEN 1 THEN '@x' WHEN 2 THEN '  -1' WHEN 3 THEN props WHEN 4 THEN '' END").alias("cell")), ["cell"]),
}

NAME = "lower(trim(title)) AS t, lower(trim(company)) AS c"
BARE = r"trim(regexp_replace(regexp_replace(company, '(?i)\b(inc|llc|ltd|pvt|limited|corp|corporation|gmbh|co)\b\.?', '', 'g'), '\s+', ' ', 'g'), ' .,-|')"
POSTING = "(seq % 8 IN (0, 1, 3, 4, 6))"

# Places of each posting as a list, then counts of the runs and the ladder of their states.
TOLD = """q AS (SELECT *, seq % 5 <= 2 AND seq % 10 <> 1 AS no_exp, status = 'verified' AND run_id <> 'run3' AS good, list_filter([CASE WHEN contains(lower(location), 'dubai') THEN 'Dubai' END, CASE WHEN regexp_matches(lower(location), 'saudi|arabia') THEN 'Saudi Arabia' END, CASE WHEN contains(lower(location), 'tokyo') THEN 'Tokyo' END, CASE WHEN contains(lower(location), 'remote') THEN 'Remote' END], lambda x: x IS NOT NULL) AS places FROM postings)"""
COVERAGE = TOLD + """, r AS (SELECT user_id % 8 AS k, 'run' || (user_id % 8) AS run_id, count(*) AS n, count(*) FILTER (user_id % 8 = 1 AND event_id % 2 = 1) AS pending FROM events GROUP BY 1, 2),
 t AS (SELECT *, CASE WHEN k IN (0, 4, 5, 6) THEN n WHEN k = 1 THEN n - pending ELSE 0 END AS completed, CASE k WHEN 2 THEN n ELSE 0 END AS partial, CASE k WHEN 7 THEN n ELSE 0 END AS blocked, CASE k WHEN 3 THEN n ELSE 0 END AS failed, CAST(n % 100 + CASE k WHEN 4 THEN 150 ELSE 0 END AS INT) AS search_calls, CASE k WHEN 6 THEN 400 ELSE 20 END AS fetch_calls FROM r),
 f AS (SELECT run_id, count(*) AS raw, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (good) AS qualified, count(*) FILTER (good AND no_exp) AS unknown_experience, count(*) FILTER (good AND posted_age_seconds IS NULL) AS unknown_date, flatten(list(CASE WHEN good THEN places ELSE [] END)) AS had FROM q GROUP BY 1),
 y AS (SELECT t.run_id AS run_id, search_calls, fetch_calls, coalesce(raw, 0) AS raw, coalesce(duplicates, 0) AS duplicates, coalesce(verified, 0) AS verified, coalesce(rejected, 0) AS rejected, coalesce(qualified, 0) AS qualified, coalesce(unknown_experience, 0) AS unknown_experience, coalesce(unknown_date, 0) AS unknown_date, n AS discovered, completed, partial, blocked, failed, pending, coalesce(raw - duplicates, 0) AS "unique",
  array_to_string(list_filter(['Dubai', 'Saudi Arabia', 'Tokyo', 'Remote'], lambda x: NOT list_contains(coalesce(had, []), x)), ',') AS weak_areas, array_to_string(list_filter([CASE WHEN search_calls >= 150 THEN 'max_search_calls' END, CASE WHEN k = 6 THEN 'max_fetch_calls' END, CASE WHEN k = 6 THEN 'deadline_exceeded' END], lambda x: x IS NOT NULL), ',') AS budgets_reached FROM t LEFT JOIN f ON f.run_id = t.run_id),
 z AS (SELECT *, CASE WHEN contains(budgets_reached, 'deadline') THEN 'interrupted' WHEN budgets_reached <> '' OR pending + partial > 0 THEN 'partial' WHEN qualified = 0 AND failed + blocked > 0 THEN 'failed' ELSE 'complete_within_scope' END AS run_status, run_status IN ('interrupted', 'partial') AS can_resume, qualified >= 1000000 OR weak_areas = '' AND qualified > 0 AS is_sufficient FROM y)"""

ORACLES = {
    "a11_document_upsert": f'''WITH {DOCS}, o AS (SELECT document_id, n % 2 AS side, max(retrieved_at) AS "at", min(n) AS id, max(http_status) AS status FROM docs GROUP BY 1, 2) SELECT document_id, max("at") AS "at", arg_min(id, "at") AS id, arg_max(status, "at") AS status FROM o GROUP BY 1''',
    "a12_record_upsert": oracle(f"WITH {DOCS}, k AS (SELECT DISTINCT run_id, document_id FROM docs), m AS (SELECT run_id, min(document_id) AS spare FROM k GROUP BY 1) SELECT p.record_id, coalesce(k.document_id, m.spare) AS document_id FROM postings p LEFT JOIN k ON k.run_id = p.run_id AND k.document_id = p.document_id LEFT JOIN m ON m.run_id = p.run_id", "postings"),
    "d1_listing_detail": oracle("SELECT p.record_id, coalesce(a.applied_status, 'not_applied') AS applied_status, coalesce(a.interview_status, 'none') AS interview_status, coalesce(e.n, 0) AS n_evidence FROM postings p LEFT JOIN applications a ON a.record_id = p.record_id LEFT JOIN (SELECT record_id, count(*) AS n FROM evidence GROUP BY 1) e ON e.record_id = p.record_id", "postings", "applications", "evidence"),
    "d2_saved_listings": oracle("SELECT a.record_id, user_id, title FROM applications a JOIN postings p ON p.record_id = a.record_id", "postings", "applications"),
    "d3_applications": oracle("SELECT a.record_id, user_id, company FROM applications a JOIN postings p ON p.record_id = a.record_id WHERE applied_status = 'applied'", "postings", "applications"),
    "d4_exclude_ignored": oracle("SELECT record_id FROM postings WHERE record_id NOT IN (SELECT record_id FROM applications WHERE user_id = 'u1')", "postings", "applications"),
    "d5_records_with_evidence": oracle("SELECT p.record_id, string_agg(e.field_name || '/' || e.doc || '/' || e.evidence_text, ';' ORDER BY e.field_name, e.doc, e.evidence_text, e.supports_value) AS nested FROM postings p LEFT JOIN (SELECT record_id AS r, document_id AS doc, field_name, evidence_text, supports_value FROM evidence) e ON e.r = p.record_id WHERE status = 'verified' GROUP BY 1", "postings", "evidence"),
    "d6_pending_changes": oracle("SELECT a.record_id, applied_status, title FROM applications a JOIN postings p ON p.record_id = a.record_id WHERE interview_status <> 'scheduled'", "postings", "applications"),
    "d8_profile_lookup": oracle(f"WITH k AS (SELECT record_id, lower({BARE}) AS k FROM postings) SELECT record_id, c_mktsegment AS profile FROM k LEFT JOIN customer ON lower(c_name) = k", "postings"),
    "d10_saved_listing_health": oracle(f"WITH {DOCS}, l AS (SELECT document_id, arg_max(http_status, retrieved_at) AS h, arg_max(text, retrieved_at) AS t FROM docs GROUP BY 1) SELECT p.record_id, p.document_id, CASE WHEN l.document_id IS NULL THEN 'missing' WHEN h IN (404, 410) THEN 'removed' WHEN contains(lower(t), 'this job has expired') THEN 'closed' ELSE 'open' END AS state FROM postings p LEFT JOIN l ON l.document_id = p.document_id", "postings"),
    "c19_listing_filters": oracle("SELECT record_id FROM postings WHERE status = 'verified' AND location IN ('Dubai, UAE', 'Remote') AND posted_age_seconds <= 60 * 86400 AND contains(lower(concat_ws(' ', title, company, location, salary, skills, source)), 'engineer') AND contains(lower(company), 'customer')", "postings"),
    "c20_listing_eligibility": oracle("SELECT record_id FROM postings WHERE status IN ('verified', 'needs_review') AND coalesce(confidence, 1) >= 0.5 AND seq % 16 NOT IN (3, 9)", "postings"),
    "e1_listing_count": oracle("WITH e AS (SELECT run_id, lower(trim(title)) || '|' || lower(trim(company)) AS k FROM postings WHERE status IN ('verified', 'needs_review') AND coalesce(confidence, 1) >= 0.5 AND seq % 16 NOT IN (3, 9)) SELECT run_id, count(DISTINCT k) AS total FROM e GROUP BY 1", "postings"),
    "e5_run_diagnostics": oracle("SELECT run_id, count(*) AS candidates, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (coalesce(salary, '') <> '') AS with_salary FROM postings GROUP BY 1", "postings"),
    "e6_coverage_report": oracle(f"WITH {TOLD}, j AS (SELECT unnest(places) AS place, posted_age_seconds IS NULL AS u, no_exp FROM q), g AS (SELECT place, count(*) AS n, count(*) FILTER (u) AS undated, count(*) FILTER (no_exp) AS unknown_experience FROM j GROUP BY 1) SELECT d.place AS place, coalesce(n, 0) AS n, coalesce(undated, 0) AS undated, coalesce(unknown_experience, 0) AS unknown_experience, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 5 THEN 'weak' ELSE 'covered' END AS status FROM (SELECT unnest({PLACES}) AS place) d LEFT JOIN g ON g.place = d.place", "postings"),
    "e6_run_coverage": oracle(f"WITH {COVERAGE} SELECT * FROM z", "postings"),
    "e9_facet_counts": oracle("""WITH s AS (SELECT CASE WHEN coalesce(trim(location), '') = '' THEN 'Remote / Unspecified' ELSE location END AS l, CASE WHEN trim(company) = '' THEN 'Direct Employer' ELSE trim(company) END AS c, status FROM postings),
 f AS (SELECT 'company' AS facet, c AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'location', l, count(*) FROM s WHERE NOT contains(lower(l), 'unspecified') GROUP BY 2 UNION ALL SELECT 'mode', CASE WHEN contains(lower(l), 'remote') THEN 'remote' ELSE 'onsite' END, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS place FROM f) SELECT * FROM r WHERE (facet <> 'company' OR place <= 120) AND (facet <> 'location' OR place <= 80 AND lower(value) <> 'remote')""", "postings"),
    "e10_status_totals": oracle("SELECT count(*) AS total, count(*) FILTER (applied_status = 'applied') AS applied, count(*) FILTER (interview_status = 'scheduled') AS interviewing FROM applications", "applications"),
    "e14_ops_metrics": "SELECT event_type AS tool, 'd' || (user_id % 5) AS domain, count(*) AS n, count(*) FILTER (event_id % 6 = 0) AS errors, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) FILTER (event_id % 6 = 0) / count(*), 9) AS error_rate FROM events GROUP BY ROLLUP (event_type, 'd' || (user_id % 5))",
    "e14_sketch_rollup": "SELECT event_type AS tool, 'd' || (user_id % 5) AS domain, count(*) AS n, count(*) FILTER (event_id % 6 = 0) AS errors, true AS p50_holds, true AS p95_holds FROM events GROUP BY ROLLUP (event_type, 'd' || (user_id % 5))",
    "e14_quality_metrics": oracle("""WITH f AS (SELECT record_id, field_name, bool_or(supports_value = 1) AND bool_or(supports_value = 0) AS x FROM evidence GROUP BY 1, 2), u AS (SELECT run_id, record_id, status, unnest(['title', 'company', 'location', 'salary']) AS field_name, unnest([title, company, location, salary]) AS v FROM postings),
 g AS (SELECT run_id, u.record_id AS record_id, any_value(status) AS status, count(*) FILTER (coalesce(trim(v), '') <> '') AS filled, count(*) FILTER (coalesce(trim(v), '') <> '' AND f.record_id IS NOT NULL) AS proved, coalesce(bool_or(x), false) AS bad FROM u LEFT JOIN f ON f.record_id = u.record_id AND f.field_name = u.field_name GROUP BY 1, 2)
 SELECT run_id, count(*) AS n, round(count(*) FILTER (status = 'verified') / count(*), 9) AS acceptance_rate, round(sum(filled) / (count(*) * 4), 9) AS field_completeness, round(sum(proved) / sum(filled), 9) AS evidence_coverage, round(count(*) FILTER (status = 'duplicate') / count(*), 9) AS duplicate_rate, round(count(*) FILTER (bad) / count(*), 9) AS conflict_rate FROM g GROUP BY 1""", "postings", "evidence"),
    "e14_run_rates": oracle(f"WITH {COVERAGE} SELECT count(*) AS runs, avg(CAST(run_status = 'complete_within_scope' AS INT)) AS success_rate, avg(CAST(run_status = 'partial' AS INT)) AS partial_rate, avg(CAST(run_status = 'interrupted' AS INT)) AS interrupted_rate, avg(CAST(run_status = 'failed' AS INT)) AS failure_rate, avg(CAST(can_resume AS INT)) AS resumable_rate FROM z", "postings"),
    "f1_latest_listing": oracle("WITH r AS (SELECT record_id, row_number() OVER (PARTITION BY lower(trim(title)), lower(trim(company)) ORDER BY CAST(status = 'duplicate' AS INT), confidence DESC NULLS LAST, created_at DESC, seq DESC) AS place FROM postings) SELECT record_id FROM r WHERE place = 1", "postings"),
    "g3_page_listings": oracle("SELECT record_id FROM postings ORDER BY created_at DESC, seq DESC LIMIT 50 OFFSET 100", "postings"),
    "g3_page_after": oracle("SELECT record_id FROM postings WHERE created_at < TIMESTAMP '1997-05-28' OR created_at = TIMESTAMP '1997-05-28' AND seq < 500 ORDER BY created_at DESC, seq DESC LIMIT 40", "postings"),
    "g4_recent_rows": oracle("SELECT record_id, run_id FROM postings ORDER BY created_at DESC, seq DESC LIMIT 20", "postings"),
    "g6_cap_results": oracle("WITH r AS (SELECT run_id, record_id, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC NULLS LAST, seq) AS place FROM postings) SELECT * FROM r WHERE place <= 10", "postings"),
    "h2_merge_sources": oracle("WITH r AS (SELECT record_id, row_number() OVER (PARTITION BY lower(trim(title)), lower(trim(company)) ORDER BY seq % 6, seq) AS place FROM postings) SELECT record_id FROM r WHERE place = 1", "postings"),
    "h3_unprocessed": oracle("SELECT record_id FROM postings WHERE status <> 'rejected' AND record_id NOT IN (SELECT record_id FROM applications WHERE applied_status = 'applied')", "postings", "applications"),
    "h5_cascade_delete": oracle(f"WITH c AS (SELECT record_id, seq, CASE WHEN length(trim(title)) >= 3 AND trim(company) <> '' THEN lower(trim(title)) || '|' || lower(trim(company)) END AS k, CASE WHEN {POSTING} THEN {CANON.format('url')} END AS u, CASE WHEN seq % 3 > 0 THEN document_id || source END AS i FROM postings), x AS (SELECT * FROM c WHERE seq % 1000 = 4), g AS (SELECT record_id FROM c WHERE k IN (SELECT k FROM x WHERE k IS NOT NULL) OR u IN (SELECT u FROM x WHERE u IS NOT NULL) OR i IN (SELECT i FROM x WHERE i IS NOT NULL) OR seq % 1000 = 4) SELECT field_name, count(*) AS n FROM evidence WHERE record_id NOT IN (SELECT record_id FROM g) GROUP BY 1", "postings", "evidence"),
    "h6_retention_sweep": "SELECT event_type, count(*) AS n FROM events WHERE NOT (event_type = 'view' AND date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 10 OR event_type = 'click' AND date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 3) GROUP BY 1",
    "a14_csv_escaping": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '''=cmd' || props WHEN 1 THEN '''@x' WHEN 2 THEN '''  -1' WHEN 3 THEN props WHEN 4 THEN '' END AS cell FROM events",
}
