"""Carrier tables: rows of the record model derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CARRIERS = {
    "postings": """
SELECT o.o_orderkey AS seq, CAST(o.o_orderkey AS STRING) AS record_id, 'run' || CAST(o.o_orderkey % 7 AS STRING) AS run_id,
  CASE o.o_orderkey % 16 WHEN 0 THEN 'Generative AI Engineer' WHEN 1 THEN 'Senior ML Engineer (Remote)' WHEN 2 THEN 'AI Product Manager' WHEN 3 THEN '18 Genai engineer jobs in Dubai'
    WHEN 4 THEN 'Data Scientist' WHEN 5 THEN 'Lead Applied Scientist - NLP' WHEN 6 THEN 'Sales Executive' WHEN 7 THEN 'Backend Developer' WHEN 8 THEN 'Staff Software Engineer, AI'
    WHEN 9 THEN 'View all jobs' WHEN 10 THEN 'LLM Researcher / Europe' WHEN 11 THEN 'Content Writer' WHEN 12 THEN 'Deep Learning Intern' ELSE p.p_name || ' ' || lower(p.p_type) || ' engineer' END AS title,
  c.c_name || CASE o.o_custkey % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', Ltd' WHEN 2 THEN ' GmbH' ELSE '' END AS company,
  CASE n.n_nationkey % 14 WHEN 0 THEN 'Riyadh, Saudi Arabia' WHEN 1 THEN 'Dubai, UAE' WHEN 2 THEN 'London, United Kingdom' WHEN 3 THEN 'Denver, CO (Remote)' WHEN 4 THEN 'Remote' WHEN 5 THEN 'Bangalore, India'
    WHEN 6 THEN 'Doha, Qatar' WHEN 7 THEN 'Timbuktu Province' WHEN 8 THEN '' WHEN 9 THEN NULL WHEN 10 THEN 'Gulf region' WHEN 11 THEN 'Berlin, Germany' WHEN 12 THEN 'Remote worldwide' ELSE n.n_name END AS location,
  CASE o.o_orderkey % 9 WHEN 0 THEN CAST(p.p_size AS STRING) || ' - ' || CAST(p.p_size + 10 AS STRING) || ' LPA' WHEN 1 THEN '$' || CAST(p.p_size + 90 AS STRING) || 'k - ' || CAST(p.p_size + 130 AS STRING) || 'k'
    WHEN 2 THEN '15,000 - 25,000 AED / month' WHEN 3 THEN CAST(p.p_size + 40 AS STRING) || 'k' WHEN 4 THEN '30,000 SAR / month' WHEN 5 THEN 'Competitive' WHEN 6 THEN NULL WHEN 7 THEN '' ELSE '£' || CAST(p.p_size * 1000 + 20000 AS STRING) END AS salary,
  CASE o.o_orderkey % 5 WHEN 0 THEN '3-5 years' WHEN 1 THEN CAST(p.p_size % 12 AS STRING) || '+ years' WHEN 2 THEN 'entry level' WHEN 3 THEN NULL ELSE '2 to 4 yrs' END AS experience,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'python, LangChain, SQL , Python' WHEN 1 THEN 'docker,k8s' WHEN 2 THEN '' ELSE 'Python-like syntax, azure, gen ai' END AS skills,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || CAST(o.o_orderkey % 50 AS STRING) WHEN 1 THEN 'http://www.linkedin.com/jobs/view/' || CAST(o.o_custkey AS STRING) || '?trk=x'
    WHEN 2 THEN 'https://jobs.lever.co/acme' WHEN 3 THEN 'https://jobs.lever.co/acme/' || CAST(o.o_custkey AS STRING) WHEN 4 THEN 'https://www.bayt.com/en/job-' || CAST(o.o_orderkey AS STRING) || '/?b=2&a=1&utm_source=z'
    WHEN 5 THEN 'https://acme.example.org/careers' WHEN 6 THEN 'https://apply.workable.com/acme/j/AB' || CAST(o.o_custkey AS STRING) ELSE NULL END AS url,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'bayt' WHEN 3 THEN 'careers' WHEN 4 THEN 'lever.co' ELSE 'indeed' END AS source,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE (o.o_orderkey % 97) * 86400 + o.o_orderkey % 3600 END AS posted_age_seconds,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'rejected' WHEN 3 THEN 'duplicate' ELSE 'verified' END AS status,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_orderkey % 101 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'https://jobs.ashbyhq.com/acme/' || CAST(o.o_custkey AS STRING) WHEN o.o_orderkey % 10 = 1 THEN 'https://www.indeed.com/viewjob?jk=' || CAST(o.o_custkey AS STRING) ELSE NULL END AS application_url,
  'd' || CAST(o.o_custkey AS STRING) AS document_id, o.o_orderdate AS created_at
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {part})""",
    "evidence": """
SELECT CAST(l_orderkey AS STRING) AS record_id, 'd' || CAST(l_suppkey AS STRING) AS document_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'company' WHEN 2 THEN 'location' ELSE 'salary' END AS field_name,
  l_returnflag || l_linestatus AS evidence_text, CASE WHEN l_discount > 0.02 THEN 1 ELSE 0 END AS supports_value FROM {lineitem}""",
    "bars": """
SELECT o_orderpriority AS symbol, o_orderdate AS ts, max(o_totalprice) AS high, min(o_totalprice) AS low, (max(o_totalprice) + min(o_totalprice)) / 2 AS close,
  CAST(count(*) * 100 AS DOUBLE) AS volume FROM {orders} GROUP BY o_orderpriority, o_orderdate""",
    "hits": """
SELECT page_id AS seq, url, 'wave' || CAST(page_id % 4 AS STRING) AS wave, CASE page_id % 5 WHEN 0 THEN 'https://boards.greenhouse.io/x/jobs/' || CAST(page_id AS STRING)
  WHEN 1 THEN 'https://www.bayt.com/en/uae/jobs/role-' || CAST(page_id AS STRING) || '/' WHEN 2 THEN 'https://www.linkedin.com/jobs/view/' || CAST(page_id AS STRING)
  WHEN 3 THEN 'https://www.googleadservices.com/pagead/aclk?x=1' ELSE url END AS link FROM {pages}""",
    "found": """
SELECT page_id AS seq, CASE page_id % 12 WHEN 0 THEN 'https://boards.greenhouse.io/co' || CAST(page_id % 40 AS STRING) || '/jobs/1' WHEN 1 THEN 'https://jobs.lever.co/Co' || CAST(page_id % 50 AS STRING) WHEN 2 THEN 'https://w' || CAST(page_id % 30 AS STRING) || '.workable.com/j/A'
    WHEN 3 THEN 'https://apply.workable.com/jobs/j/' WHEN 4 THEN 'https://b' || CAST(page_id % 20 AS STRING) || '.breezy.hr/p/1' WHEN 5 THEN 'https://m' || CAST(page_id % 20 AS STRING) || '.myworkdayjobs.com/x' WHEN 6 THEN 'https://www.linkedin.com/posts/' || CAST(page_id AS STRING)
    WHEN 7 THEN 'https://eg.linkedin.com/jobs/view/' || CAST(page_id AS STRING) WHEN 8 THEN 'https://www.site' || CAST(page_id % 60 AS STRING) || '.example.org/careers/' WHEN 9 THEN url || '/jobs' WHEN 10 THEN 'https://site' || CAST(page_id % 9 AS STRING) || '.de/vacancies' ELSE url || '/people/1' END AS url,
  CASE page_id % 11 WHEN 0 THEN 'GenAI Engineer at Acme Labs in Dubai' WHEN 1 THEN 'Beta Corp is hiring AI engineers' WHEN 2 THEN 'Full Stack Developer - Gamma Works' WHEN 3 THEN 'GenAI Full Stack Engineer' WHEN 4 THEN 'Sign in to continue' WHEN 5 THEN 'Delta & Co Careers'
    WHEN 6 THEN 'LLM Engineer | Epsilon Systems | Riyadh' WHEN 7 THEN 'Data role - 62 Vacancies Sep 2026' WHEN 8 THEN 'AI Engineer at Remote' WHEN 9 THEN 'Analyst - Co' || CAST(page_id % 50 AS STRING) ELSE 'Role ' || CAST(page_id AS STRING) || ' - Zeta ' || CAST(page_id % 30 AS STRING) END AS title,
  CASE page_id % 7 WHEN 0 THEN 'Posted 2 years ago' WHEN 1 THEN 'Based in Cairo, Egypt' WHEN 2 THEN 'Cairo or Dubai' WHEN 3 THEN 'Open to work and looking for a job' WHEN 4 THEN '5 months ago' WHEN 5 THEN 'Posted: March 3, 2023' ELSE 'Apply now, 12 days ago' END AS snippet FROM {pages}""",
    "facts": """
SELECT 'E' || CAST(o_custkey AS STRING) AS entity_id, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'revenue' ELSE 'headquarters' END AS field,
  CASE o_orderkey % 3 WHEN 2 THEN CASE o_orderkey % 4 WHEN 0 THEN 'Riyadh' WHEN 1 THEN 'Riyadh, KSA' ELSE 'Dubai' END ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 + 60 AS STRING) || '%' END AS value_text,
  'src' || CAST(o_orderkey % 4 AS STRING) AS source, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'day' || CAST(o_orderkey % 6 AS STRING) END AS published_at FROM {orders}""",
    "articles": """
SELECT doc_id AS seq, CASE doc_id % 7 WHEN 0 THEN 'Daily report ' WHEN 1 THEN '' ELSE 'Market update ' END || regexp_extract(text, '^([^ ]* ?[^ ]* ?[^ ]* ?[^ ]* ?[^ ]* ?[^ ]* ?[^ ]*)', 1) AS title,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Record profit and growth for ' || substr(text, 20, 60) WHEN 2 THEN ' A probe after the loss of ' || substr(text, 40, 90) ELSE substr(text, 30, 120) END || CASE WHEN doc_id % 9 = 0 THEN ' before the merger' ELSE '' END AS summary,
  CASE WHEN doc_id % 8 > 0 THEN 'https://n' || CAST(doc_id % 40 AS STRING) || '.example.org/' || CAST(doc_id % 300 AS STRING) END AS url, 'E' || CAST(doc_id % 6 AS STRING) || ',E' || CAST(doc_id % 10 AS STRING) AS names,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2026-03-10' WHEN 2 THEN '05/03/2026' WHEN 3 THEN 'soon' ELSE '2026-03-11T08:00:00Z' END AS date FROM {documents}""",
    "job_pages": """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://boards.greenhouse.io/acme-labs/jobs/' || CAST(page_id AS STRING) WHEN 1 THEN 'https://jobs.lever.co/beta/' || CAST(page_id AS STRING) WHEN 2 THEN 'https://careers.gammaworks.com/jobs/' || CAST(page_id AS STRING) || '?error=true&a=1'
    WHEN 3 THEN 'https://www.linkedin.com/jobs/view/' || CAST(page_id AS STRING) WHEN 4 THEN 'https://apply.workable.com/zeta_group/j/A' || CAST(page_id AS STRING) WHEN 5 THEN 'https://boards.greenhouse.io/acme?error=true' WHEN 6 THEN 'https://www.site.org/login' WHEN 7 THEN '' ELSE 'https://delta.org/role/ai-' || CAST(page_id AS STRING) END AS url,
  CASE page_id % 14 WHEN 0 THEN 'Acme Labs hiring Senior ML Engineer in Dubai | LinkedIn' WHEN 1 THEN 'Job Application for Data Scientist at Beta Corp' WHEN 2 THEN 'AI Engineer at Gamma Works' WHEN 3 THEN 'Forward Deployed Engineer - Delta' WHEN 4 THEN 'Beta - Research Intern'
    WHEN 5 THEN 'Platform Architect | Zeta Group' WHEN 6 THEN 'Zeta Group | Sales Manager' WHEN 7 THEN 'Sign in' WHEN 8 THEN 'Acme Labs Careers' WHEN 9 THEN '12 AI engineer jobs in Riyadh' WHEN 10 THEN 'Careers at Beta' WHEN 11 THEN '[Lead Designer](https://x.org) openings' WHEN 12 THEN 'About our mission' ELSE 'LLM Developer - Careers' END AS title,
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'A role based in Riyadh, SA for builders' WHEN 2 THEN NULL ELSE 'Join us' END AS description,
  CASE page_id % 5 WHEN 0 THEN 'Location: Cairo, Egypt Overview of the team. Pay: $90,000 - $120,000 per year. Posted 3 days ago' WHEN 1 THEN 'Our London, UK office. 60k - 80k, contract, posted yesterday' WHEN 2 THEN '' WHEN 3 THEN '# Staff Analyst' || chr(10) || 'An internship; AED 9,000 / month' ELSE 'Open Positions. Part-time in Berlin' END || ' ' || substr(html, 120, 200) AS text FROM {pages}""",
    "guides": """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://www.alpha.com/pricing' WHEN 1 THEN 'https://beta.io/x' WHEN 2 THEN '' ELSE 'https://docs.gamma.co.uk/y' END AS url, 'Delta Pricing - Plans | x' AS title, CASE WHEN doc_id % 5 = 4 THEN text ELSE
  '# Alpha ' || CAST(doc_id AS STRING) || chr(10) || CASE doc_id % 6 WHEN 0 THEN 'Free tier for developers, billed per seat' WHEN 1 THEN 'Open source under the MIT license' WHEN 2 THEN 'Usage-based at $19/month for enterprise teams' WHEN 3 THEN 'Contact sales for the compliance plan' WHEN 4 THEN 'Strengths: branches; $7 / user' ELSE 'Made for a small business' END
  || chr(10) || '- Fast branches for every team' || chr(10) || '* short' || chr(10) || '  ## 2. ' || regexp_extract(text, '^([^ ]* ?[^ ]* ?[^ ]*)', 1) || chr(10) || substr(text, 1, 400) || chr(10) || 'PIPELINE STREAM NOTES' || chr(10) || substr(text, 50, 200) || chr(10) || 'Key components:' || chr(10) || '• Retry and caching in production'
  || chr(10) || 'x = chain | step' || chr(10) || 'This and that for:' || chr(10) || '# Privacy' || chr(10) || 'words about the cookie' || chr(10) || '# docs / Key components' || chr(10) || 'Seen before, so this section is left out' || chr(10) || '# Empty' END AS text FROM {documents}""",
    "rivals": """
SELECT CAST(o_orderkey AS STRING) AS record_id, o_orderkey AS seq, 'Company ' || CAST(o_custkey AS STRING) AS company, CASE o_orderkey % 5 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Senior Data Engineer' WHEN 2 THEN 'Data Platform Engineer' WHEN 3 THEN 'Chef' ELSE 'Data Engineer, Riyadh' END AS title,
  CASE o_orderkey % 3 WHEN 0 THEN 'Riyadh' WHEN 1 THEN 'Dubai' END AS location, CASE WHEN o_orderkey % 4 < 3 THEN 'k' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 2 AS STRING) END AS identity_key,
  CASE o_orderkey % 6 WHEN 0 THEN 'Amman' WHEN 1 THEN 'Doha' END AS city, 'src' AS source, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey AS STRING) END AS job_id, CAST(NULL AS STRING) AS url, CAST(NULL AS STRING) AS application_url FROM {orders}""",
    "said": """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '--- STRUCTURED PAGE METADATA ---' || chr(10) || 'TITLE: a' || chr(10) || 'DESCRIPTION: ' || split_part(text, chr(10), 1) || chr(10) || '--- END PAGE METADATA ---' || chr(10) || chr(10) WHEN 1 THEN '--- STRUCTURED JOB SCHEMA (JSON-LD) ---' || chr(10) || '"JobPosting"' || chr(10) || '--- END STRUCTURED SCHEMA ---' || chr(10) ELSE '' END
  || replace(text, chr(10), CASE doc_id % 2 WHEN 0 THEN chr(10) || chr(10) ELSE chr(10) END) || CASE doc_id % 7 WHEN 0 THEN chr(10) || chr(10) || 'All rights reserved by the authors of this long line' WHEN 1 THEN chr(10) || chr(10) || repeat('Home and links' || chr(10), 8) || chr(10) || 'A known limitation of this  method is its cost in large rooms' ELSE '' END AS text FROM {documents}""",
    "reached": """
SELECT doc_id, 'E' || CAST(doc_id % 50 AS STRING) AS entity_id, CASE doc_id % 6 WHEN 0 THEN 'https://e' || CAST(doc_id % 50 AS STRING) || '.org/Contact' WHEN 1 THEN 'https://x.org/about-us/' || CAST(doc_id % 9 AS STRING) WHEN 2 THEN NULL ELSE 'https://x.org/' || CAST(doc_id AS STRING) END AS url,
  CASE WHEN doc_id % 50 % 3 > 0 THEN 'e' || CAST(doc_id % 50 AS STRING) || '.org/' END AS own, text || ' Info@d' || CAST(doc_id % 9 AS STRING) || '.example.org; sales@x.example.org' AS text FROM {documents}""",
    "telemetry": """
SELECT event_id AS seq, 'source' || CAST(user_id % 12 AS STRING) AS source, 'run' || CAST(user_id AS STRING) AS run_id, ts, event_type,
  CAST(floor(value) AS BIGINT) AS n, event_id % 7 AS k FROM {events}""",
    "applications": """
SELECT CAST(o_orderkey AS STRING) AS record_id, CASE o_orderkey % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'not_applied' ELSE 'interviewing' END AS applied_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'scheduled' ELSE 'none' END AS interview_status, o_orderdate AS updated_at, 'u' || CAST(o_custkey % 5 AS STRING) AS user_id FROM {orders} WHERE o_orderkey % 3 < 2 AND o_orderkey % 4 < 3""",
    "mentions": """
SELECT s_suppkey AS seq, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Limited' ELSE '' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'www.c' || CAST(s_suppkey % 10 AS STRING) || '.example.com' ELSE NULL END AS domain,
  CASE WHEN s_suppkey % 5 = 0 THEN 'SYM' || CAST(s_suppkey % 15 AS STRING) ELSE NULL END AS symbol FROM {supplier}
UNION ALL SELECT 100000 + c_custkey AS seq, 'Supplier#' || substr(c_name, 10) AS name, NULL AS domain, NULL AS symbol FROM {customer}""",
}


def tables_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = CARRIERS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables_in(sql)})


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL over the named carriers."""
    ctes = [f"{n} AS ({CARRIERS[n].format(**{t: t for t in TABLES})})" for n in names]
    head = ("WITH " + ",\n".join(ctes)) if ctes else ""
    body = sql.strip()
    if ctes and body.upper().startswith("WITH "):
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"
