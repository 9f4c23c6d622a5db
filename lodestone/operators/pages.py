"""Postings from single pages: competing readings of a page's title are ranked, the first that holds wins and is kept as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.operators.postings import posted_age
from lodestone.operators.web import posting_urls

# Platforms that are no employer, titles that name no role, words in titles of other pages, and role words.
PLATFORMS = ["greenhouse", "lever", "ashby", "workable", "smartrecruiters", "breezy", "careers", "linkedin", "indeed", "glassdoor"]
NO_TITLES = ["jobs", "careers", "404", "not found", "access denied", "home", "sign in", "log in", "gulftalent", "bayt", "naukri"]
PROFILE_WORDS = ["curriculum vitae", "candidate profile", "resume", "view profile", "user profile"]
BRANDS = ["gulftalent", "bayt", "bayt.com", "naukrigulf", "indeed", "glassdoor", "linkedin"]
LOGIN_WORDS = ["sign in", "log in", "login", "mygreenhouse", "user sign in", "candidate login"]
ROLE_WORDS = [
    "engineer", "developer", "scientist", "architect", "lead", "manager", "analyst", "specialist", "consultant", "designer", "director", "intern",
    "researcher", "officer", "associate", "technician", "administrator", "programmer", "representative", "coordinator", "executive", "head", "vp", "staff", "fellow",
]
SYSTEMS = ["greenhouse.io", "lever.co", "ashbyhq.com", "workable.com"]
# Patterns of titles, places, pay and age.
HIRING = r"(?i)^([A-Z][a-zA-Z0-9\s&.,'–-]+?)\s+hiring\s+(.+?)(?:\s+in\s+([^|\-\n\r]+?))?(?:\s*[|\-•·].*)?$"
APPLICATION = r"(?i)job application for\s+(.*?)\s+at\s+([^|\-\n\r]+)"
AT = r"(?i)^([^\n\r]+?)\s+at\s+([^|\-\n\r]+)$"
DASH = r"^([^\n\r]+?)\s+-\s+([^|\-\n\r]+)$"
PIPE = r"^([^\n\r]+?)\s+\|\s+([^|\-\n\r]+)$"
LINK = r"\[\s*\[?([^\]]+)\]?\s*\](?:\([^)]+\)|\[\d+\])?"
PHRASES = r"(?i)\b(job application for|apply for|careers at|careers|openings?)\b"
NAMED_PLACE = r"\b(?:in|location:|based in|at)\s+([A-Z][a-zA-Z\s]+(?:,\s*[A-Z]{2}|,\s*[A-Z][a-zA-Z\s]+)?)"
PLACE_LINE = r"(?i)(?:Location|Office|Workplace|Based):\s*([^\n\r]+)"
CITIES = r"(?i)\b(San Francisco(?:,\s*(?:CA|California))?|New York(?:,\s*(?:NY|New York))?|Dubai(?:,\s*UAE)?|London(?:,\s*UK)?|Remote|Seattle(?:,\s*(?:WA|Washington))?|Austin(?:,\s*(?:TX|Texas))?|Boston(?:,\s*(?:MA|Massachusetts))?|Toronto|Berlin|Singapore|Chicago(?:,\s*(?:IL|Illinois))?|Los Angeles(?:,\s*(?:CA|California))?)\b"
PLACE_END = r"(?is)\b(?:overview|work week|working hours|about us|job description|responsibilities)\b.*$"
PAY = r"(?i)((?:\$|USD|EUR|GBP|AED|CAD)\s*[\d,]+(?:\s*-\s*(?:\$|USD|EUR|GBP|AED|CAD)?\s*[\d,]+)?(?:\s*(?:/|per)\s*(?:year|yr|month|mo|hour|hr|annum))?|\b\d{2,3}k\s*-\s*\d{2,3}k\b)"
AGE = r"(?i)\b(0\s*(?:sec|seconds?|s)\s*ago|just\s*now|moments?\s*ago|just\s*posted|\d+\s*(?:seconds?|secs?|minutes?|mins?|m|hours?|hrs?|h|days?|d)\s*ago|today|yesterday|\bnew\b)"


def stripped(col: Column, marks: str) -> Column:
    """Without these characters at both ends (marks: inside of a character class)."""
    return F.regexp_replace(col, f"^[{marks}]+|[{marks}]+$", "")


def slug(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[ _]", "")


def company_of_url(url: Column) -> Column:
    """The board's name on a hiring system, else the second-level name of the host."""
    board = F.regexp_extract(url, r"(?:greenhouse\.io|lever\.co|ashbyhq\.com|workable\.com)/([^/?#]+)", 1)
    host = c.url_host(url)
    parts = F.split(host, r"\.")
    second = F.get(parts, F.size(parts) - 2)
    own = F.when(F.size(parts) >= 2, F.concat(F.upper(F.substring(second, 1, 1)), F.substring(second, 2, 1000))).otherwise(host)
    return F.when(board != "", F.initcap(F.regexp_replace(board, "[-_]", " "))).otherwise(own)


def title_readings(title: Column, url: Column, inferred: Column) -> Column:
    """Readings of a page's title in order of rank: structs of convention, title, company, location.

    A convention that doesn't match, or leaves no title, is out. `A - B` and `A | B` name the role first unless A is the company
    that the URL names (or the board is one that puts it first).
    """
    part = lambda pattern, k: F.trim(F.regexp_extract(title, pattern, k))
    none = F.lit("")
    one = lambda name, role, company, place=none: F.struct(F.lit(name).alias("convention"), role.alias("title"), company.alias("company"), place.alias("location"))
    known = slug(inferred)
    names = lambda x: (known != "") & (F.contains(slug(x), known) | F.contains(known, slug(x)))

    def two(name: str, pattern: str, company_first: Column) -> Column:
        a, b = part(pattern, 1), part(pattern, 2)
        return one(name, F.when(company_first, b).otherwise(a), F.when(company_first, a).otherwise(b))

    dash, pipe = part(DASH, 1), part(PIPE, 1)
    ranked = F.array(
        one("company hiring role", part(HIRING, 2), part(HIRING, 1), part(HIRING, 3)), one("job application for role", part(APPLICATION, 1), part(APPLICATION, 2)), one("role at company", part(AT, 1), part(AT, 2)),
        two("role - company", DASH, F.contains(F.lower(url), F.lit("lever.co")) | names(dash)), two("role | company", PIPE, names(pipe)), one("whole title", title, none),
    )
    return F.filter(ranked, lambda r: r["title"] != "")


def listing_title(title: Column, fallback: Column) -> Column:
    """Role of a title that reads like a list of jobs."""
    ends = r" \-|:\n\r"
    x = stripped(F.regexp_replace(title, r"(?is)\s*salary\s*search.*$", ""), ends)
    x = stripped(F.regexp_replace(x, r"(?i)^[a-zA-Z\s,]+jobs\s*[-–—]\s*", ""), ends)
    low = F.lower(title)
    x = stripped(
        F.when(F.contains(low, F.lit("jobs in ")), F.regexp_replace(x, r"(?i)\s+jobs in\s+.*$", "")).when(F.contains(low, F.lit("job vacancies")), F.regexp_replace(x, r"(?i)\s+job vacancies.*$", ""))
        .otherwise(F.regexp_replace(x, r"(?i)^\d+\+?\s+([a-zA-Z\s]+?)\s+jobs.*$", "$1")), r" \-|:",
    )
    x = stripped(F.regexp_replace(x, r"(?i)\s+jobs\s*$", ""), r" \-|:")
    return F.when((x == "") | F.lower(x).isin("jobs", "careers"), fallback).otherwise(x)


def posting_from_page(pages: DataFrame, as_of: str, topic: str = "", key: str = "page_id", lead: int | None = None) -> DataFrame:
    """At most one posting a page: key, title, company, location, salary, posted, posted_age_seconds, employment_type, application_url, source, convention.

    pages: key, url, title, text; used if there: meta_title, description, meta_url (before what the page shows). Nulls count
    as empty. Pages whose URL is no posting's go, unless a board or the page itself says more; so do sign-in pages, profiles,
    platforms, a company's own front page, and pages without a role word in the title or first heading outside hiring
    systems. lead: characters of the text that place and employment type are read from (default: all).
    """
    has = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) if name in pages.columns else F.lit("")
    rows = pages.select(key, has("url").alias("url"), F.coalesce(F.nullif(has("meta_title"), F.lit("")), has("title")).alias("shown"), has("description").alias("description"), has("meta_url").alias("meta_url"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.col("text") if lead is None else F.substring("text", 1, lead)
    single = posting_urls(rows.filter("url <> ''").select("url").distinct(), mock_hosts=False).withColumn("single", F.lit(True))
    told = (F.col("description") != "") | (F.col("meta_url") != "") | F.contains("text", F.lit("Open Positions")) | F.contains("url", F.lit("boards.greenhouse.io"))
    rows = rows.join(single, "url", "left").filter((F.col("url") == "") | F.col("single") | told)
    rows = rows.withColumn("inferred", company_of_url(F.col("url")))
    rows = rows.withColumn("r", F.get(title_readings(F.col("shown"), F.col("url"), F.col("inferred")), F.lit(0))).filter("r is not null")
    clean = stripped(F.regexp_replace(F.regexp_replace("r.title", LINK, "$1"), PHRASES, ""), r" \-|:\[\]")
    company = F.when((F.col("r.company") == "") | F.lower("r.company").isin(PLATFORMS), F.coalesce(F.nullif(F.col("inferred"), F.lit("")), F.lit("Direct Employer"))).otherwise(F.col("r.company"))
    rows = rows.withColumns({"clean": clean, "company": company})
    low, letters = F.lower(F.trim("clean")), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    own = letters(F.col("company"))
    front = (letters(F.col("clean")) != "") & (own != "") & letters(F.col("clean")).isin(own, F.concat(own, F.lit("careers")), F.concat(own, F.lit("jobs")))
    rows = rows.filter((low != "") & ~low.isin(NO_TITLES + BRANDS) & ~c.contains_any(low, PROFILE_WORDS + LOGIN_WORDS) & ~front)
    words = [w for w in topic.lower().split() if len(w) > 3]
    says = c.contains_any(low, ROLE_WORDS)
    by_topic = c.contains_any(low, words) if words else F.lit(False)
    heading = F.coalesce(F.nullif(F.regexp_extract("text", r"<h1[^>]*>([^<]+)</h1>", 1), F.lit("")), F.regexp_extract("text", r"(?m)^#\s+([^\n\r]+)", 1))
    heading = stripped(F.regexp_replace(F.trim(heading), LINK, "$1"), r" \-|:\[\]")
    by_heading = ~says & ~by_topic & c.contains_any(F.lower(heading), ROLE_WORDS)
    rows = rows.filter(says | by_heading | c.contains_any(F.lower("url"), SYSTEMS))
    title = F.when(by_heading, heading).otherwise(listing_title(F.col("clean"), F.lit(topic or "Open Role")))
    found = [F.regexp_extract("description", NAMED_PLACE, 1), F.col("r.location"), F.regexp_extract(head, PLACE_LINE, 1), F.regexp_extract(head, CITIES, 1)]
    place = F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in found])
    place = F.coalesce(stripped(F.regexp_replace(place, PLACE_END, ""), r" ,\-|:"), F.lit("Remote / Unspecified"))
    kind = F.when(F.contains(F.lower("clean"), F.lit("intern")) | F.contains(F.lower(head), F.lit("internship")), "Internship").when(F.contains(F.lower(head), F.lit("contract")), "Contract").when(F.contains(F.lower(head), F.lit("part-time")), "Part-time").otherwise("Full-time")
    link = F.coalesce(F.nullif(F.col("meta_url"), F.lit("")), F.col("url"))
    bare = F.regexp_replace(F.regexp_replace(link, r"([?&])error=[^&#]*&?", "$1"), r"[?&]+(#|$)", "$1")
    board = F.contains(bare, F.lit("greenhouse.io")) & ~bare.rlike(r"/jobs/\d+|gh_jid=\d+|/job\b")
    link = F.when(F.contains(link, F.lit("error=")), F.when(~board, bare)).otherwise(link)
    out = rows.select(
        key, title.alias("title"), "company", place.alias("location"), F.nullif(F.trim(F.regexp_extract("text", PAY, 1)), F.lit("")).alias("salary"), F.nullif(F.regexp_extract("text", AGE, 0), F.lit("")).alias("posted"),
        kind.alias("employment_type"), link.alias("application_url"), c.url_host(F.col("url")).alias("source"), F.when(by_heading, "first heading").otherwise(F.col("r.convention")).alias("convention"),
    )
    return posted_age(out, "posted", as_of).withColumn("posted_age_seconds", F.coalesce("age_seconds", F.lit(86400).cast("long"))).drop("age_seconds", "label")
