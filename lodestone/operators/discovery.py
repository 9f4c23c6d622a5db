"""Triage of hits before they are fetched, and new sources that hits reveal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URLs and titles that are no postings.
JUNK_URLS = ["/jobs/search", "/browse/", "/tag/", "/category/", "/login", "/signup", "/people/", "/candidate/"]
JUNK_TITLES = ["people directory", "candidate profile", "sign in", "log in", "create account"]
# Titles of other trades, for requests that name one of the AI terms.
AI_REQUESTS = ["genai", "generative ai", "llm", "ai engineer"]
OTHER_TRADES = ["cybersecurity", "cyber security", "infosec", "soc analyst", "full stack", "fullstack", "front end", "frontend", "ui developer", "accountant", "bookkeeper", "sales manager", "recruiter", "talent acquisition"]
# Gulf names in a request, foreign hosts and places, and names that excuse a foreign place.
GULF = ["saudi", "uae", "dubai", "riyadh", "jeddah", "dammam", "gulf", "gcc", "qatar", "kuwait", "bahrain", "oman"]
FOREIGN_HOSTS = ["eg.linkedin.com", "wuzzuf.net", "forasna.com", "in.linkedin.com", "naukri.com", "foundit.in", "pk.linkedin.com", "rozee.pk", "bd.linkedin.com", "uk.linkedin.com", "reed.co.uk"]
FOREIGN_PLACES = [
    "cairo, egypt", "alexandria, egypt", "egypt only", "based in egypt", "cairo", "london, uk", "london, united kingdom", "bangalore, india", "bengaluru, india", "pune, india", "mumbai, india", "hyderabad, india", "delhi, india",
    "karachi, pakistan", "lahore, pakistan", "islamabad, pakistan", "denver, co", "san francisco, ca", "new york, ny",
]
EXCUSES = ["saudi", "uae", "dubai", "riyadh", "doha", "qatar", "kuwait", "bahrain", "oman", "worldwide", "global remote"]
# Posts of people who look for work, and the paths of posts.
POSTS = ["/posts/", "/feed/update/", "/pulse/"]
SEEKERS = [
    "open to work", "#opentowork", "looking for a job", "looking for new opportunities", "seeking new opportunities", "seeking a role", "seeking a job", "seeking opportunity", "open for new opportunities",
    "happy to announce that i've joined", "happy to announce i joined", "thrilled to announce that i've joined", "thrilled to announce i joined", "started a new position", "started a new role", "celebrating 5 years",
    "celebrating 10 years", "promoted to", "congratulations to",
]
# Marks of old postings.
STALE = [
    r"\b(?:[1-9]|\d{2})\s+years?\s+ago\b",
    r"\b(?:over\s+|more\s+than\s+)?1\s+year\s+ago\b",
    r"\b(?:[3-9]|1[0-2])\s+months?\s+ago\b",
    r"\b(?:1[0-9]{2}|[2-9][0-9]{2})\s+days?\s+ago\b",
    r"\bposted[:\s]+(?:\w+\s+\d{1,2},\s+)?(2020|2021|2022|2023|2024)\b",
]
# Hiring platforms with the patterns of an employer's name in their URLs.
PLATFORMS = [
    ("greenhouse", r"boards\.greenhouse\.io/([^/?#]+)"), ("greenhouse", r"job-boards\.greenhouse\.io/([^/?#]+)"), ("lever", r"jobs\.lever\.co/([^/?#]+)"), ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)"),
    ("workable", r"apply\.workable\.com/([^/?#]+)"), ("workable", r"([a-zA-Z0-9-]+)\.workable\.com"), ("smartrecruiters", r"jobs\.smartrecruiters\.com/([^/?#]+)"), ("breezy", r"([a-zA-Z0-9-]+)\.breezy\.hr"),
    ("workday", r"([a-zA-Z0-9-]+)\.myworkdayjobs\.com"), ("bamboohr", r"([a-zA-Z0-9-]+)\.bamboohr\.com"),
]
# Words that are no employers.
NO_EMPLOYERS = [
    "job", "jobs", "career", "careers", "hiring", "apply", "search", "post", "positions", "view", "index", "feed", "linkedin", "indeed", "glassdoor", "bayt", "baytcom", "bayt.com", "gulftalent", "naukrigulf", "naukri", "monster",
    "tanqeeb", "dubai", "saudi", "riyadh", "remote", "general", "fulltime", "parttime", "internship", "login", "register", "candidate", "applicant", "apply now", "click here", "read more", "view job", "work in", "vacancies", "vacancy",
    "openings", "opening", "requirements", "requirement", "salary", "salaries", "opportunity", "opportunities", "middle east", "middleeast", "united arab emirates", "saudi arabia", "uae", "abu dhabi",
]
# Parts of a name that mark it as no employer.
NO_EMPLOYER_PARTS = [
    "vacanc", "opening", "hiring", "apply now", "click here", "view job", "read more", "job opening", "find job", "salary", "salaries", "bayt", "naukri", "gulftalent", "linkedin", "indeed", "glassdoor", "january", "february", "march",
    "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan 20", "feb 20", "mar 20", "apr 20", "jun 20", "jul 20", "aug 20", "sep 20", "oct 20", "nov 20", "dec 20",
]
# Where a title names the employer.
NAME = r"[A-Z0-9][A-Za-z0-9\s&.]{1,30}?"
EMPLOYER_PATTERNS = [rf"(?:at|@)\s+({NAME})(?:\s+in|\s+[-|–—]|\s+\(|$)", rf"({NAME})\s+is hiring\b", rf"({NAME})\s+Careers\b", rf"[-|–—]\s+({NAME})(?:\s+[-|–—]|\s+Careers|\s+Jobs|$)"]
# Hosts of search and social sites, hosts of aggregators, paths of boards, and marks of foreign hosts.
SOCIAL_HOSTS = ["google", "duckduckgo", "bing", "yahoo", "facebook", "twitter", "x.com", "instagram", "wikipedia", "youtube", "medium.com"]
AGGREGATOR_HOSTS = ["linkedin.com", "indeed.com", "glassdoor.com", "monster.com", "ziprecruiter.com", "bayt.com", "gulftalent.com", "naukrigulf.com"]
BOARD_PATHS = ["/jobs", "/careers", "/career", "/vacancies", "/job-opening"]
FOREIGN_STARTS = [
    "ru", "au", "sg", "in", "pe", "de", "fr", "uk", "ca", "br", "jp", "mx", "es", "it", "nl", "pl", "ch", "se", "no", "fi",
    "ie", "nz", "za", "ph", "pk", "bd", "vn", "th", "my", "id", "eg", "tr", "cn", "hk", "tw", "kr",
]
FOREIGN_ENDS = [
    "fr", "de", "it", "es", "ru", "in", "co.uk", "ca", "com.br", "pl", "nl", "jp", "cn", "au", "uk", "br", "ch", "se", "no", "fi",
    "ie", "nz", "za", "ph", "pk", "bd", "vn", "th", "my", "id", "tr", "kr",
]


def has_any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def triage(hits: DataFrame, request: str = "", locations: tuple[str, ...] = (), jobs: bool = True) -> DataFrame:
    """hits (url, title, snippet) with promising: no junk, and for job requests no other trade, foreign place, seeker or old posting."""
    url, title, snippet = (F.lower(F.coalesce(x, F.lit(""))) for x in ("url", "title", "snippet"))
    text = F.concat_ws(" ", url, title, snippet)
    junk = has_any(url, JUNK_URLS) | has_any(title, JUNK_TITLES)
    if jobs:
        if any(k in request.lower() for k in AI_REQUESTS):
            junk = junk | (has_any(title, OTHER_TRADES) & ~has_any(title, AI_REQUESTS))
        if any(k in place.lower() for place in locations for k in GULF):
            junk = junk | has_any(url, FOREIGN_HOSTS) | (has_any(text, FOREIGN_PLACES) & ~has_any(text, EXCUSES))
        post = F.contains(url, F.lit("linkedin.com")) & has_any(url, POSTS)
        old = "|".join(STALE)
        junk = junk | (post & has_any(text, SEEKERS)) | snippet.rlike(old) | title.rlike(old)
    return hits.withColumn("promising", ~junk)


def employer_name(title: Column) -> Column:
    """Employer in a title, by the first pattern that gives an acceptable name; null if none does."""

    def accepted(pattern: str) -> Column:
        name = F.trim(F.regexp_replace(F.trim(F.regexp_extract(title, pattern, 1)), r"[^\w\s&]", ""))
        low = F.lower(name)
        return F.when((F.length(name) > 2) & ~name.rlike(r"^\d") & ~has_any(low, NO_EMPLOYER_PARTS) & ~low.isin(NO_EMPLOYERS), name)

    return F.coalesce(*[accepted(p) for p in EMPLOYER_PATTERNS])


def discover_sources(hits: DataFrame, known_boards: DataFrame | None = None, locations: tuple[str, ...] = ()) -> DataFrame:
    """kind (platform, employer, board), key, detail, url, seq: what hits (seq, url, title) reveal, each by its first hit.

    known_boards: board domains (domain) that are left out. One scan marks all hits; three small aggregates follow.
    """
    slug = [F.lower(F.regexp_extract("url", "(?i)" + p, 1)) for _, p in PLATFORMS]
    found = F.coalesce(*[F.when(s != "", F.struct(F.lit(n).alias("platform"), s.alias("slug"))) for (n, _), s in zip(PLATFORMS, slug)])
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)), r"www\.", "")
    foreign = host.rlike("^(" + "|".join(FOREIGN_STARTS) + r")\.") | host.rlike(r"\.(" + "|".join(x.replace(".", r"\.") for x in FOREIGN_ENDS) + ")$")
    gulf = any(k in place.lower() for place in locations for k in [*GULF, "middle east"])
    board = F.col("platform").isNull() & (F.col("host") != "") & ~has_any(F.col("host"), SOCIAL_HOSTS + AGGREGATOR_HOSTS) & has_any(F.lower("url"), BOARD_PATHS)
    marked = hits.filter(F.coalesce("url", F.lit("")) != "").select("seq", "url", found.alias("platform"), host.alias("host"), employer_name(F.trim("title")).alias("employer"), (foreign if gulf else F.lit(False)).alias("foreign"))
    first = lambda df, key, detail, kind: df.groupBy(key.alias("key")).agg(F.min_by(F.struct(detail.alias("detail"), "url", "seq"), "seq").alias("r")).select(F.lit(kind).alias("kind"), "key", "r.*")
    of_platform = marked.filter("length(platform.slug) > 1").filter(~F.col("platform.slug").isin(NO_EMPLOYERS))
    platforms = first(of_platform, F.col("platform.slug"), F.col("platform.platform"), "platform")
    employers = first(marked.filter("employer is not null"), F.lower("employer"), F.col("employer"), "employer").join(platforms.select("key"), "key", "left_anti").select("kind", "key", "detail", "url", "seq")
    boards = first(marked.filter(board & ~F.col("foreign")), F.col("host"), F.col("host"), "board")
    if known_boards is not None:
        boards = boards.join(known_boards.select(F.col("domain").alias("key")), "key", "left_anti").select("kind", "key", "detail", "url", "seq")
    return platforms.unionByName(employers).unionByName(boards)
