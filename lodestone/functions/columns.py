"""Column builders used by the operators. All are built-in functions, so they stay in generated code or at least in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import rules


def contains_any(col: Column, terms: list[str]) -> Column:
    """Whether the column has one of the substrings."""
    return col.rlike("|".join(re.escape(t).replace("/", "/") for t in terms))


def words_any(col: Column, terms: list[str]) -> Column:
    return col.rlike(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b")


WORD_END = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with each \b as the edge of a run of ASCII word characters. Java's own \b counts other letters too, or not, by its version."""
    return re.sub(r"\\(.)", lambda m: WORD_END if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


def empty_as_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


# --- URLs ---------------------------------------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    """Lower-case host with its port, without user part or a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column) -> Column:
    """https for http(s), lower host without www., no trailing slash, no fragment, tracking and blank parameters dropped, the rest sorted."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = url_path(url)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    pairs = F.transform(F.split(url_query(url), "&"), lambda p, i: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), i.alias("i"), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: (F.coalesce(p["v"], F.lit("")) != "") & ~F.lower(p["k"]).isin(rules.TRACKING_PARAMS))
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    built = F.concat(F.when(scheme.isin("http", "https", ""), "https").otherwise(scheme), F.lit("://"), url_host(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "").otherwise(built)


def is_board_url(url: Column) -> Column:
    """Board root, directory or listing page rather than one posting; null counts as one."""
    low = F.lower(F.trim(url))
    host, path = F.regexp_replace(url_host(low), ":.*$", ""), F.regexp_replace(url_path(low), "/+$", "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    posting = path.rlike(r"/jobs/\d+") | url_query(low).rlike(r"gh_jid=\d+") | path.rlike(r"/job\b")
    rule = (
        F.when(F.size(parts) == 0, True)
        .when(F.contains(host, F.lit("greenhouse.io")), ~posting)
        .when(contains_any(host, ["lever.co", "ashbyhq.com"]), F.size(parts) < 2)
        .when(F.contains(host, F.lit("workable.com")), ~path.rlike(r"/j/[a-z0-9]+"))
        .otherwise(F.element_at(parts, -1).isin(rules.BOARD_SEGMENTS))
    )
    return F.when(F.coalesce(url, F.lit("")) == "", True).otherwise(rule)


def search_tier(url: Column) -> Column:
    out = F.lit(4)
    for tier in sorted(rules.SEARCH_TIERS, reverse=True):
        out = F.when(contains_any(F.lower(url), rules.SEARCH_TIERS[tier]), tier).otherwise(out)
    return out


def source_category(url: Column, source: Column | None = None) -> Column:
    text = F.lower(F.concat_ws(" ", url, source if source is not None else F.lit("")))
    out = F.lit("company_careers")
    for name in reversed(rules.SOURCE_CATEGORIES):
        out = F.when(contains_any(text, rules.SOURCE_CATEGORIES[name]), name).otherwise(out)
    return out


def market_tier(url: Column) -> Column:
    """struct(tier, name)."""
    out = F.struct(F.lit(4).alias("tier"), F.lit("External Web Source").alias("name"))
    for tier, mark, name in reversed(rules.MARKET_TIERS):
        out = F.when(F.contains(F.lower(url), F.lit(mark)), F.struct(F.lit(tier).alias("tier"), F.lit(name).alias("name"))).otherwise(out)
    return out


def is_ad_url(url: Column) -> Column:
    return F.coalesce(contains_any(F.lower(url), rules.AD_MARKS), F.lit(False))


def prefers_apply_url(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(contains_any(low, rules.PREFERRED_APPLY), True).when(contains_any(low, rules.AGGREGATORS), False).otherwise(contains_any(low, ["/careers", "/jobs"]))


# --- postings -----------------------------------------------------------------------------------------------------


def alnum(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]", "")


def fingerprint(company: Column, title: Column, location: Column) -> Column:
    return F.concat(alnum(company), F.lit("::"), alnum(title), F.lit("::"), alnum(location))


def clean_company(company: Column) -> Column:
    bare = F.regexp_replace(company, r"(?i)\b(inc|llc|ltd|pvt|limited|corp|corporation|gmbh|co)\b\.?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ .,\-|]+|[ .,\-|]+$", "")
    return F.when(bare != "", bare).otherwise(company)


def clean_title(title: Column) -> Column:
    bare = F.regexp_replace(title, r"(?i)\b(senior|sr\.?|junior|jr\.?|lead|principal|staff|associate)\b", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[\(\[\{].*?[\)\]\}]", ""), r"[-/|].*$", "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(bare != "", bare).otherwise(title)


def remote_status(title: Column, location: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, location))
    return F.when(contains_any(text, ["remote", "wfh", "work from home", "anywhere", "virtual"]), "remote").when(F.contains(text, F.lit("hybrid")), "hybrid").otherwise("onsite")


def clean_location(location: Column, status: Column) -> Column:
    low = F.lower(location)
    bare = F.when(F.contains(low, F.lit("remote")) & (low != "remote"), F.regexp_replace(F.regexp_replace(location, r"(?i)\b(remote|wfh)\b", ""), r"^[ ,\-|]+|[ ,\-|]+$", "")).otherwise(location)
    return F.when((F.coalesce(bare, F.lit("")) == "") & (status == "remote"), "Remote").otherwise(F.coalesce(bare, F.lit("")))


def experience_range(text: Column) -> Column:
    """struct(lo, hi) in years."""
    lo, hi = (F.regexp_extract(text, r"(\d+)\s*[-–to]+\s*(\d+)", i).try_cast("int") for i in (1, 2))
    return F.struct(F.coalesce(lo, F.regexp_extract(text, r"(\d+)", 1).try_cast("int")).alias("lo"), hi.alias("hi"))


NUMBER = r"(\d{1,3}(?:,\d{3})+|\d+)"


def salary_range(text: Column) -> Column:
    """struct(lo, hi, currency, period); lo and hi a year."""
    low = F.lower(text)
    number = lambda pattern, i: F.regexp_replace(F.regexp_extract(text, "(?i)" + pattern, i), ",", "").try_cast("double")
    lakh = r"(\d+(?:\.\d+)?)\s*(?:lpa|lakh|lac)"
    lakh2 = r"(\d+(?:\.\d+)?)\s*[-–to]+\s*" + lakh
    k2 = r"[\$]?(\d+)\s*k?\s*[-–to]+\s*[\$]?(\d+)\s*k"
    n2 = NUMBER + r"\s*[-–to]+\s*" + NUMBER
    k1, n1 = r"[$€£₹]?\s*(\d+(?:\.\d+)?)\s*k\b", r"(\d{1,3}(?:,\d{3})+|\b\d{4,}\b)"
    monthly = low.rlike(r"/\s*mo(?:nth)?|per\s*month|\bmonth(?:ly)?\b|p\.?m\.?")
    times = F.when(monthly, 12.0).otherwise(1.0)
    full = lambda v: F.when(v < 1000, v * 1000).otherwise(v)
    is_lakh = low.rlike(lakh)
    pick = lambda i: (
        F.when(low.rlike(lakh2), number(lakh2, i) * 100000)
        .when(is_lakh, number(lakh, 1) * 100000)
        .when(low.rlike(k2), full(number(k2, i)) * times)
        .when(low.rlike(n2), number(n2, i) * times)
        .when(low.rlike(k1), number(k1, 1) * 1000 * times)
        .when(low.rlike(n1), number(n1, 1) * times)
    )
    currency = (
        F.when(contains_any(low, ["₹", "inr", "lpa", "lakh"]), "INR").when(contains_any(low, ["£", "gbp"]), "GBP").when(contains_any(low, ["€", "eur"]), "EUR")
        .when(contains_any(low, ["aed", "dirham", "dhs"]), "AED").when(contains_any(low, ["sar", "riyal", "sr"]), "SAR").when(contains_any(low, ["qar"]), "QAR").when(contains_any(low, ["kwd"]), "KWD")
        .when(contains_any(low, ["cad", "c$"]), "CAD").when(contains_any(low, ["aud", "a$"]), "AUD").when(contains_any(low, ["sgd", "s$"]), "SGD").when(contains_any(low, ["$", "usd"]), "USD")
    )
    lo = pick(1)
    return F.struct(lo.alias("lo"), pick(2).alias("hi"), F.when(is_lakh, "INR").otherwise(currency).alias("currency"), F.when(monthly & ~is_lakh & lo.isNotNull(), "monthly").otherwise("annual").alias("period"))


def is_listing_title(title: Column) -> Column:
    """Count headings, banners and search-result titles."""
    low = F.lower(F.trim(title))
    counted = low.rlike(r"^\s*[\d,]+\+?\s+.*(?:jobs?|openings?|vacancies?|positions?|engineers?|developers?|roles?)\b")
    place = low.rlike(r"\b(?:jobs?|vacancies?|openings?)\s+in\s+[a-zA-Z\s]+") & ~contains_any(low, ["head of", "lead", "director", "manager of"])
    named = low.rlike(r"\bjobs\s+in\s+(?:dubai|uae|saudi|riyadh|abu dhabi|middle east|qatar|kuwait|egypt|india|london|us|singapore|remote)\b")
    return F.coalesce(counted | contains_any(low, rules.TITLE_BANNERS) | (place & named), F.lit(False))


def has_skill(skill: str, text: Column) -> Column:
    """A skill by any alias as a whole term, not after non- and not before -like."""
    name = skill.lower().strip()
    found = next((c for c, aliases in rules.SKILL_ALIASES.items() if name in aliases), name)
    each = [("" if len(a) <= 2 else "(?<!non-)") + "(?<![a-z0-9])" + re.escape(a) + "(?![a-z0-9])" + r"(?!\s*[-–]?\s*like\b)" for a in rules.SKILL_ALIASES.get(found, [found])]
    return F.lower(text).rlike("|".join(each))


def geo_cluster(place: Column) -> Column:
    """Cluster of the first alias, in declared order, that the place has as a whole term; exact aliases first."""
    out = F.lit(None).cast("string")
    for name in reversed(rules.GEO_ALIASES):
        out = F.when(words_any(place, rules.GEO_ALIASES[name]), name).otherwise(out)
    return out
