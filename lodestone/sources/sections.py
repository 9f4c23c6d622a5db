"""Sections of texts: one index of headed sections in the row, and the readers of postings, concepts and competitors on it.

A rule names the heading of a line or gives null. The index holds, for each text, its sections as heading and body lines; it
is built inside the row from the places of the headings, without a shuffle, and can be stored once and read by several readers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.operators.pages import LINK, NAMED_PLACE, PAY, stripped

HeadingRule = Callable[[Column], Column]


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def hash_heading(longest: int, level: str = "#+", space: str = r"\s*") -> HeadingRule:
    """Lines that begin with #; the rest of the line, if it has 1 to `longest` characters."""

    def rule(line: Column) -> Column:
        name = trimmed(F.regexp_replace(line, f"^{level}{space}", ""))
        return F.when(line.rlike(f"^{level}{space}") & F.length(name).between(1, longest), name)

    return rule


# Beginnings and ends of lines with a colon that are clauses.
CLAUSE_STARTS = [
    "that", "this", "these", "those", "for example", "such as", "note", "why", "how", "what", "which", "where", "when", "in this", "we ", "you ", "if ",
    "also", "because", "and ", "or ", "as ", "to ", "with ", "agree & join",
]
CLAUSE_ENDS = [" for", " with", " in", " of", " to", " and", " is", " are", " by", " from", " about", " between", " including", " like", " such as", " that"]


def starts_with_any(x: Column, words: list[str]) -> Column:
    return x.rlike("^(?:" + "|".join(words) + ")")


def ends_with_any(x: Column, words: list[str]) -> Column:
    return x.rlike("(?:" + "|".join(words) + ")$")


def document_heading(line: Column) -> Column:
    """A line with #, one in capitals, or a short name before a colon."""
    hashed = trimmed(F.regexp_replace(line, r"^#+\s*", ""))
    name = F.regexp_replace(line, ":+$", "")
    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}") & F.length(line).between(5, 59)
    named = line.endswith(":") & F.length(line).between(5, 49) & name.rlike(r"^\p{Lu}") & (F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) <= 6) & ~starts_with_any(F.lower(name), CLAUSE_STARTS) & ~ends_with_any(F.lower(name), CLAUSE_ENDS)
    found = F.when(line.startswith("#"), hashed).when(capitals, line).when(named, name)
    return F.when(F.length(found) > 2, found)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: a lambda that names a column anew works it out for each element wherever the optimizer merges the two."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exploded(index: DataFrame, array: str, *others: str) -> DataFrame:
    """others, pos and s: a row for each element. The outer form keeps Spark from working the array out a second time in a filter on its size."""
    return index.select(*others, F.posexplode_outer(array).alias("pos", "s")).filter(F.col("pos").isNotNull())


def section_index(docs: DataFrame, rule: HeadingRule, text: str = "text") -> DataFrame:
    """Adds sections: an array of heading and body (lines without white space around, none empty), in order. Null texts have none."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), trimmed), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), rule(x).alias("heading")))

    def cut(m: Column) -> Column:
        places = F.filter(F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)), lambda i: F.get(m, i)["heading"].isNotNull())

        def sections(at: Column) -> Column:
            body = lambda i, k: F.transform(F.slice(m, i + 2, F.coalesce(F.get(at, k + 1), F.size(m)) - i - 1), lambda x: x["line"])
            return F.transform(at, lambda i, k: F.struct(F.get(m, i)["heading"].alias("heading"), body(i, k).alias("body")))

        return bound(places, sections)

    return docs.withColumn("sections", bound(marked, cut))


def first_of_each(sections: Column) -> Column:
    """The first section of each heading in any case, in order."""

    def first(found: Column) -> Column:
        by_name = F.sort_array(F.transform(found, lambda s, i: F.struct(F.lower(s["heading"]).alias("name"), i.alias("at"))))
        at = bound(by_name, lambda b: F.sort_array(F.transform(F.filter(b, lambda e, j: (j == 0) | (F.get(b, j - 1)["name"] != e["name"])), lambda e: e["at"])))
        return F.transform(at, lambda i: F.get(found, i))

    return bound(sections, first)


def numbered(rows: DataFrame, key: str, most: int | None) -> DataFrame:
    """Adds place, counted over the rows that are left of a text."""
    placed = rows.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY pos)"))
    return placed if most is None else placed.filter(F.col("place") <= most)


# --- postings -----------------------------------------------------------------------------------------------------

# Words of a topic that name no role, places, synonyms of one field, addresses and titles of profiles, and regions.
TOPIC_STOPS = ["find", "jobs", "with", "years", "experience", "for", "and", "the", "about", "from", "looking"]
PLACE_WORDS = ["saudi", "arabia", "ksa", "uae", "dubai", "riyadh", "abu", "dhabi", "jeddah", "qatar", "doha", "kuwait", "oman", "muscat", "bahrain", "manama", "cairo", "egypt", "india", "usa", "uk", "london", "remote", "worldwide", "global"]
FIELD_WORDS = ["genai", "generative", "llm", "gpt", "openai", "chatgpt", "nlp", "rag", "agentic", "foundational"]
FIELD_SYNONYMS = ["llm", "genai", "gen", "gpt", "nlp", "rag", "applied", "scientist", "researcher"]
PROFILE_PATHS = ["/people/", "/candidates/", "/talent/", "/profiles/", "/profile/", "/resume/", "/cv/"]
PROFILE_TITLES = ["gulftalent", "candidate profile", "curriculum vitae", "resume"]
GULF = ["saudi", "uae", "dubai", "riyadh", "abu dhabi", "jeddah", "ksa"]
ABROAD = ["united states", "usa", "mexico", "budapest", "hungary", "india", "pune", "delhi", "bengaluru", "bangalore", "germany", "france", "canada", "brazil", "poland"]
ROLE_NOISE = ["about us", "cookie", "join our", "privacy", "how we", "what we", "equal opportunity"]
ROLE_LINE = r"^([A-Z][a-zA-Z0-9\s/\-—,]{3,70}(?:Engineer|Scientist|Developer|Architect|Researcher|Lead|Manager|Intern|Specialist|Analyst|Consultant)[a-zA-Z0-9\s/\-—,]*)"


def on_topic(topic: str, title: Column, whole: Column) -> Column:
    """Role words of the topic have to be in the title, else any word of it in the whole."""
    tokens = [w for w in re.findall(r"\b[a-z]{3,}\b", topic.lower()) if w not in TOPIC_STOPS]
    roles = [w for w in tokens if w not in PLACE_WORDS]
    if any(w in FIELD_WORDS for w in roles):
        roles = sorted({*roles, *FIELD_SYNONYMS})
    if roles:
        return c.contains_any(F.lower(title), roles)
    return c.contains_any(F.lower(whole), tokens) if tokens else F.lit(True)


def in_region(geography: str, topic: str, location: Column) -> Column:
    """A search in the Gulf leaves out postings of other regions."""
    if not any(w in f"{geography} {topic}".lower() for w in GULF):
        return F.lit(True)
    return ~c.contains_any(F.lower(location), ABROAD)


def section_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: str = "", geography: str = "", most: int | None = None) -> DataFrame:
    """key, pos, place, title, location, url, posted_at of texts that list roles as `## ` sections with Location, Apply or Posted lines.

    Sections without a Location or Apply line are no postings; profiles, titles under 3 characters, other regions and other
    topics go too. most: postings kept of a text, counted after all of that (default: all). A missing place is `Remote`.
    """
    index = section_index(docs.select(key, text), hash_heading(100_000, level="##(?!#)", space=r"\s+"), text)
    rows = exploded(index, "sections", key)

    def line(name: str) -> Column:
        hits = F.filter("s.body", lambda x: F.lower(x).startswith(name + ":"))
        return F.nullif(trimmed(F.regexp_replace(F.element_at(F.when(F.size(hits) > 0, hits), -1), "^[^:]*:", "")), F.lit(""))

    title = stripped(F.regexp_replace("s.heading", LINK, "$1"), r" \-|:\[\]")
    rows = rows.select(key, (F.col("pos") + 1).alias("pos"), title.alias("title"), line("location").alias("place_line"), line("apply").alias("url"), line("posted").alias("posted_at")).withColumn("location", F.coalesce("place_line", F.lit("Remote")))
    single = (F.length("title") >= 3) & (F.col("place_line").isNotNull() | F.col("url").isNotNull())
    person = c.contains_any(F.lower(F.coalesce("url", F.lit(""))), PROFILE_PATHS) | c.contains_any(F.lower("title"), PROFILE_TITLES)
    kept = rows.filter(single & ~person & in_region(geography, topic, F.col("location")) & on_topic(topic, F.col("title"), F.concat_ws(" ", "title", "location")))
    return numbered(kept, key, most).select(key, "pos", "place", "title", "location", "url", "posted_at")


def role_heading(line: Column) -> Column:
    """A heading or bullet that names a role of 6 to 80 characters."""
    name = stripped(F.regexp_extract(F.regexp_replace(line, r"^(?:#{1,4}\s*|[-*•]\s*)", ""), ROLE_LINE, 1), r" \-—:|#")
    return F.when(line.rlike(r"^(?:#{1,4}|[-*•])") & F.length(name).between(6, 80) & ~c.contains_any(F.lower(name), ROLE_NOISE), name)


def heading_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: str = "", geography: str = "", rule: HeadingRule = role_heading, most: int | None = None) -> DataFrame:
    """key, pos, place, title, location, salary: one posting for each distinct role among the headings and bullets of texts that have two or more.

    Place and pay come from the lines below, up to the next role. Other regions and topics go. most: postings kept of a
    text, counted after all of that (default: all).
    """
    index = section_index(docs.select(key, text), rule, text)
    several = bound(first_of_each(F.col("sections")), lambda f: F.when(F.size(f) >= 2, f))
    rows = exploded(index.withColumn("sections", several), "sections", key)
    below = F.array_join("s.body", "\n")
    said = F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (F.regexp_extract(below, r"(?i)\blocation\W+([^\n]+)", 1), F.regexp_extract(below, NAMED_PLACE, 1))])
    rows = rows.select(key, (F.col("pos") + 1).alias("pos"), F.col("s.heading").alias("title"), said.alias("location"), F.nullif(F.trim(F.regexp_extract(below, PAY, 1)), F.lit("")).alias("salary"), below.alias("below"))
    place = F.coalesce("location", F.lit(""))
    kept = rows.filter(in_region(geography, topic, place) & on_topic(topic, F.col("title"), F.concat_ws(" ", "title", place, "below")))
    return numbered(kept, key, most).drop("below")


# --- concepts -----------------------------------------------------------------------------------------------------

# Words of sections that say nothing, of advertising, beginnings and ends of names that are none, labels, and words of categories.
EMPTY_TALK = [
    "cookie", "privacy policy", "terms of use", "terms of service", "terms", "sign in", "subscribe", "all rights reserved", "navigation", "footer", "menu", "search", "skip to content", "skip navigation", "agree & join", "user agreement", "log in", "sign up",
    "advertisement", "newsletter", "linkedin", "share this", "share on", "leave a reply", "table of contents", "author", "related articles", "related posts", "categories", "trending posts", "structured page metadata", "end page metadata", "page metadata", "metadata", "breadcrumb",
    "sidebar", "comments", "copyright", "back to top",
]
SELLING = ["course", "curriculum", "certification", "enroll", "enrollment", "discount", "coupon", "fees", "voucher", "batch starts", "lifetime access", "training program", "aws cloud", "cloud computing", "masterclass", "become a certified"]
NAME_STARTS = ["that", "this", "these", "for example", "such as", "note", "why", "agree", "here is", "so "]
NAME_ENDS = [" for", " with", " in", " of", " to", " and", " is", " are"]
LABELS = ["last indexed", "last updated", "last modified", "active community", "published on", "posted on", "written by", "read time", "table of contents", "author", "share on", "related articles", "quick links", "structured page metadata", "end page metadata", "page metadata", "metadata", "navigation", "footer", "header"]
NO_NAMES = ["leo", "xl", "metadata"]
CATEGORIES = [
    ("Execution Protocols & Methods", ["protocol", "invoke", "stream", "batch", "astream", "execution", "lifecycle", "async"]),
    ("Composition Patterns & Syntax", ["pipe", "syntax", "sequence", "parallel", "passthrough", "composition", "chaining", "|"]),
    ("Comparative Analysis & Trade-offs", ["benchmark", "performance", "latency", "comparison", "vs", "tradeoff", "limitation"]),
    ("Production & Observability", ["tracing", "langsmith", "fallback", "retry", "caching", "production", "observability", "error"]),
]
TOPIC_FILLERS = ["what", "is", "how", "does", "the", "a", "an", "and", "or", "in", "on", "at", "for", "with", "to", "of", "about", "overview", "architecture"]
BULLETS = r"(?m)^\s*[-*•]\s*(.+)$"


def long_sentences(body: Column, over: int) -> Column:
    return F.filter(F.transform(F.split(body, r"[.\n]"), trimmed), lambda x: F.length(x) > over)


def technical_sections(docs: DataFrame, topic: str, key: str = "doc_id", text: str = "text", most: int | None = None, body_lines: int | None = None) -> DataFrame:
    """key, pos, place, heading, category, definition, points, code: headed sections that explain something of the topic.

    Headings: lines with #, in capitals, or short names before a colon. Sections of empty talk or advertising, under 30
    characters, without a word of the topic, and names that are clauses, labels or seen before in the text go. most:
    sections kept of a text, body_lines: lines read of a section (default: all). Texts without a heading give none.
    """
    wanted = sorted({w for w in re.findall(r"\w+", topic.lower()) if w not in TOPIC_FILLERS and len(w) > 2})
    index = section_index(docs.select(key, text), document_heading, text)
    lines = F.col("s.body") if body_lines is None else F.slice("s.body", 1, body_lines)
    rows = exploded(index, "sections", key).select(key, (F.col("pos") + 1).alias("pos"), F.col("s.heading").alias("heading"), lines.alias("lines"), F.array_join(lines, "\n").alias("body"))
    whole = F.lower(F.concat_ws(" ", "heading", "body"))
    last = F.filter(F.transform(F.split("heading", "/"), trimmed), lambda x: x != "")
    name = trimmed(F.regexp_replace(F.coalesce(F.get(last, F.size(last) - 1), F.col("heading")), r"^[0-9.\-\s]+", ""))
    rows = rows.filter((F.length("body") >= 30) & ~c.contains_any(whole, EMPTY_TALK + SELLING)).withColumns({"name": name, "whole": whole}).withColumn("low", F.lower("name"))
    named = (F.col("name") != "") & (F.length("name") <= 80) & ~starts_with_any(F.col("low"), NAME_STARTS + LABELS) & ~ends_with_any(F.col("low"), NAME_ENDS) & ~F.col("low").isin(NO_NAMES)
    rows = rows.filter(named & (c.contains_any(F.col("low"), wanted) | c.contains_any(F.lower("body"), wanted) if wanted else F.lit(True)))
    rows = rows.withColumn("again", F.expr(f"row_number() OVER (PARTITION BY `{key}`, low ORDER BY pos)")).filter("again = 1")
    category = F.lit("Architecture & Primitives")
    for label, words in reversed(CATEGORIES):
        category = F.when(c.contains_any(F.col("whole"), words), label).otherwise(category)
    said = long_sentences(F.col("body"), 20)
    first = F.coalesce(F.get(said, F.lit(0)), F.substring("body", 1, 150))
    bullets = F.filter(F.transform(F.slice(F.regexp_extract_all("body", F.lit(BULLETS), 1), 1, 4), trimmed), lambda x: F.length(x).between(11, 139))
    fenced = F.regexp_extract("body", r"(?s)```(?:python)?\s*(.+?)```", 1)
    coded = F.filter("lines", lambda x: x.rlike(r"import |from | = |\||runnable|chain"))
    code = F.when(fenced != "", trimmed(fenced)).when(F.col("body").rlike(r"def |import |from |class | = |\|") & (F.size(coded) > 0), F.array_join(F.slice(coded, 1, 6), "\n"))
    out = rows.withColumns({
        "category": category, "definition": F.when(F.length(first) > 240, F.concat(F.substring(first, 1, 237), F.lit("..."))).otherwise(first),
        "points": F.when(F.size(bullets) > 0, bullets).otherwise(F.transform(F.slice(said, 2, 3), lambda x: F.substring(x, 1, 120))), "code": code,
    })
    return numbered(out, key, most).select(key, "pos", "place", F.col("name").alias("heading"), "category", "definition", "points", "code")


# --- competitors --------------------------------------------------------------------------------------------------

# Headings of no competitor; words of pricing models and audiences in order; patterns of prices and strengths.
NO_RIVALS = [
    "cookie", "privacy", "terms", "sign in", "login", "subscribe", "footer", "header", "navigation", "search", "table of contents", "faq", "frequently asked", "resources", "related posts", "about us",
    "contact us", "author", "categories", "user agreement", "disclaimer", "structured page metadata", "end page metadata", "page metadata", "metadata", "breadcrumb", "sidebar", "advertisement", "share on", "share this", "comments",
]
PRICING = [
    ("Open Source / Self-Hosted", ["open source", "apache 2", "mit license", "self-hosted", "github.com"]), ("Usage-Based / Pay-As-You-Go", ["per token", "usage-based", "pay as you go", "metered", "per request", "per gb"]),
    ("Freemium / Tiered", ["free tier", "freemium", "free plan"]), ("Per-Seat / User SaaS", ["per seat", "per user", "/user/month", "/seat/mo", "user/month"]), ("Enterprise Custom", ["contact sales", "custom pricing", "enterprise only"]),
]
AUDIENCES = [
    ("Enterprise & High-Growth Scaleups", ["enterprise", "fortune 500", "soc2", "sso", "compliance", "large scale"]), ("Developers & Technical Teams", ["developer", "api-first", "engineers", "technical teams", "code-first"]),
    ("SMBs, Creators & Marketers", ["creator", "marketer", "small business", "solopreneur", "smb"]),
]
PRICE_TAG = r"(?i)(\$\d+(?:\.\d+)?(?:\s*(?:/\s*(?:mo|month|user|seat|token|1k tokens|year))?)|\bfree\b)"
STRENGTH_LINE = r"(?i)(?:advantages|pros|strengths|differentiator|why choose):\s*([^\n\r]+)"
PRODUCT_NOISE = r"(?i)\b(pricing|features|software|platform|alternatives|vs|review)\b"


def ladder(text: Column, steps: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first step with a word in the text."""
    out = F.lit(default)
    for label, words in reversed(steps):
        out = F.when(c.contains_any(text, words), label).otherwise(out)
    return out


def competitor_profiles(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """key, place, company_name, pricing_model, starting_price, target_audience, key_features, strengths, website_url.

    docs: key, text and, if there, url and title. Each `#` section of 3 to 50 characters that is no page furniture is a
    competitor; texts with one such section or none are about a single one, named by the host, else by the title. most:
    competitors kept of a text (default: all). Null and empty texts give no row.
    """
    has = lambda name: F.coalesce(F.col(name), F.lit("")) if name in docs.columns else F.lit("")
    rows = docs.filter(F.coalesce(text, F.lit("")) != "").select(key, text, has("url").alias("website_url"), has("title").alias("page_title"))
    index = section_index(rows, hash_heading(59), text)
    clean = lambda s: trimmed(F.regexp_replace(s["heading"], r"^[0-9.\-\s]+", ""))

    def rival(s: Column) -> Column:
        return (F.size(s["body"]) > 0) & ~c.contains_any(F.lower(s["heading"]), NO_RIVALS) & F.length(s["heading"]).between(3, 50) & (clean(s) != "") & ~F.lower(clean(s)).isin(NO_NAMES)

    found = F.transform(F.filter("sections", rival), lambda s: F.struct(clean(s).alias("name"), F.array_join(s["body"], "\n").alias("body")))
    parts = F.split(c.url_host(F.col("website_url")), r"\.")
    second = F.get(parts, F.size(parts) - 2)
    host = F.when(c.url_host(F.col("website_url")) != "", F.initcap(F.when((F.size(parts) >= 2) & ~second.isin("co", "com", "org", "io"), second).otherwise(F.get(parts, F.lit(0)))))
    shown = F.trim(F.split(F.split("page_title", "-")[0], r"\|")[0])
    bare = lambda x: stripped(F.regexp_replace(x, PRODUCT_NOISE, ""), r" :|\-")
    alone = F.coalesce(F.nullif(bare(F.coalesce(host, F.nullif(shown, F.lit("")), F.lit("Competitor Solution"))), F.lit("")), host, F.lit("SaaS Solution"))
    kept = bound(found, lambda f: F.when(F.size(f) > 1, f).otherwise(F.array(F.struct(alone.alias("name"), F.col(text).alias("body")))))
    index = index.withColumn("found", kept if most is None else F.slice(kept, 1, most))
    each = exploded(index, "found", key, "website_url").select(key, (F.col("pos") + 1).alias("place"), "website_url", F.col("s.name").alias("company_name"), F.col("s.body").alias("body"))
    low = F.lower("body")
    each = each.withColumns({"pricing_model": ladder(low, PRICING, "Subscription / Tiered"), "target_audience": ladder(low, AUDIENCES, "Startups & Engineering Teams"), "tag": F.trim(F.regexp_extract("body", PRICE_TAG, 1))})
    price = F.when(F.lower("tag") == "free", "Free / $0").when(F.col("tag") != "", F.col("tag")).when(F.col("pricing_model") == PRICING[0][0], "Free (Open Source)").otherwise("Free Tier Available")
    bullets = F.filter(F.transform(F.regexp_extract_all("body", F.lit(BULLETS), 1), trimmed), lambda x: F.length(x).between(11, 139) & ~c.contains_any(F.lower(x), NO_RIVALS))
    short = F.filter(long_sentences(F.col("body"), 20), lambda x: F.length(x) < 150)
    each = each.withColumn("features", F.when(F.size(bullets) > 0, bullets).otherwise(F.slice(short, 1, 4)))
    line = F.trim(F.regexp_extract("body", STRENGTH_LINE, 1))
    strengths = F.when(line != "", line).when(F.size("features") > 0, F.concat(F.lit("Key capabilities include "), F.get("features", F.lit(0)))).otherwise(F.concat(F.lit("Authoritative architecture, transparent "), F.lower("pricing_model"), F.lit(", and dedicated developer ergonomics.")))
    named = F.when(F.size("features") > 0, F.slice("features", 1, 5)).otherwise(F.array(F.concat("company_name", F.lit(" core capability")), F.lit("API access"), F.lit("Team collaboration")))
    return each.select(key, "place", "company_name", "pricing_model", price.alias("starting_price"), "target_audience", named.alias("key_features"), strengths.alias("strengths"), "website_url")
