"""Jobs over hits, URLs and pages: labels, filters, unseen hits, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import columns as c


def canonical_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("canonical_url", c.canonical_url(F.col(url)))


def url_kind(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("is_board", c.is_board_url(F.col(url)))


def label_sources(df: DataFrame, url: str = "url") -> DataFrame:
    """Search tier, source category, market tier and name."""
    market = c.market_tier(F.col(url))
    return df.withColumns({"search_tier": c.search_tier(F.col(url)), "source_category": c.source_category(F.col(url)), "market_tier": market["tier"], "market_name": market["name"]})


def source_domains(df: DataFrame, url: str = "url") -> DataFrame:
    """Distinct hosts."""
    return df.select(c.url_host(F.col(url)).alias("domain")).filter("domain <> ''").distinct()


def drop_ads(df: DataFrame, url: str = "url") -> DataFrame:
    return df.filter(~c.is_ad_url(F.col(url)))


def posting_urls(df: DataFrame, url: str = "url", mock_hosts: bool = True) -> DataFrame:
    """Keeps URLs of single postings: no sign-in, profile or search pages; job ids where a hiring system has them."""
    low = F.lower(F.trim(F.col(url)))
    host, path, query = c.url_host(low), c.url_path(low), c.url_query(low)
    parts = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    sign_in = c.contains_any(low, ["/users/sign_in", "/users/login", "/sign_in", "/signin", "/login", "/auth/", "/session", "/saml", "/sso", "login.", "signin.", "auth."])
    people = c.contains_any(low, ["/people/", "/candidates/", "/talent/", "/profiles/", "/profile/", "/resume/", "/resumes/", "/cv/", "/members/", "/confirmation", "/submitted", "/thank-you", "/thanks", "/applied"])
    specific = path.rlike(r"/(?:view|jobs?|job-listing|careers?|position|role)/[a-z0-9_\-]+|[-_/](?:jid|jl|job)[-_/]?\d+|-\d+/?$|/\d+/?$|viewjob|job-listings|-jid-|job-detail") | query.rlike(r"\b(?:vjk|jk|jid|jl|jobid|job_id|gh_jid|joblistingid)=[a-z0-9_\-]+")
    searching = c.contains_any(path, ["/search", "/skill", "/skills", "/category", "/browse", "/tags"])
    boards = host.rlike(r"(^|\.)(bayt|naukrigulf|gulftalent|indeed|glassdoor|ziprecruiter|monster|wellfound|dice|remoteok|weworkremotely)\.com$")
    listing = (searching | F.contains(path, F.lit("/jobs/"))) & path.rlike(r"-\d+-jobs|jobs-in-|\b\d+-|-jobs")
    linkedin = F.when(c.contains_any(path, ["/in/", "/company/"]), False).when(c.contains_any(path, ["/posts/", "/feed/update/", "/pulse/"]), True).when(c.contains_any(path, ["/jobs/search", "/jobs/collections", "-jobs"]), False).otherwise(path.rlike("/jobs/[a-z0-9_-]+"))
    mock = c.contains_any(host, ["example.com", "localhost"]) if mock_hosts else F.lit(False)
    ok = (
        F.when(F.coalesce(low, F.lit("")) == "", False)
        .when(sign_in | people | mock | host.rlike("^(people|talent|candidates?)\\.") | path.isin("", "/") | F.contains(low, F.lit("expired_jd_redirect")), False)
        .when(F.contains(host, F.lit("greenhouse.io")), (path.rlike(r"/jobs/\d+|/job\b|^/v1/boards") | query.rlike(r"gh_jid=\d+")) & ~F.contains(low, F.lit("error=true")))
        .when(c.contains_any(host, ["lever.co", "ashbyhq.com", "smartrecruiters.com"]), parts >= 2)
        .when(F.contains(host, F.lit("workable.com")), F.contains(path, F.lit("/j/")))
        .when(F.contains(host, F.lit("myworkdayjobs.com")), path.rlike("/jobs?/"))
        .when(boards, specific & ~searching & ~listing)
        .when(F.contains(host, F.lit("linkedin.com")), linkedin)
        .otherwise(~path.rlike("/(search|skills?)/") | specific)
    )
    return df.filter(ok)


def domain_policy(df: DataFrame, allow: list[str] | None, block: list[str] | None, url: str = "url") -> DataFrame:
    """Keeps rows whose host is, or is below, an allowed domain and no blocked one. The lists are parameters of the call."""
    host = c.url_host(F.col(url))

    def below(domains: list[str]) -> Column:
        tests = [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    if block:
        df = df.filter(~below(block))
    return df.filter(below(allow)) if allow else df


def unseen(hits: DataFrame, seen: DataFrame, order: str = "seq", url: str = "url") -> DataFrame:
    """First hit of each canonical URL that seen (a table with canonical_url) does not have."""
    named = canonical_urls(hits, url).filter("canonical_url <> ''")
    first = named.groupBy("canonical_url").agg(F.min_by(F.struct(*named.drop("canonical_url").columns), order).alias("r")).select("canonical_url", "r.*")
    return first.join(seen.select("canonical_url").distinct(), "canonical_url", "left_anti")


def source_distribution(df: DataFrame, url: str = "url") -> DataFrame:
    return df.groupBy(c.source_category(F.col(url)).alias("category")).agg(F.count("*").alias("n"))


def coverage_matrix(hits: DataFrame, url: str = "url", region: str = "region") -> DataFrame:
    """Per category: regions searched and hits, zero-filled over the categories."""
    spark = hits.sparkSession
    dim = spark.createDataFrame([(x,) for x in (*c.rules.SOURCE_CATEGORIES, "company_careers")], "category string")
    told = hits.groupBy(c.source_category(F.col(url)).alias("category")).agg(F.count("*").alias("n"), F.count_distinct(region).alias("regions"))
    return dim.join(told, "category", "left").fillna(0)


def tiered_top(hits: DataFrame, n: int, group: str = "wave", order: str = "seq", url: str = "url") -> DataFrame:
    """First n hits of each wave by tier, then order."""
    ranked = hits.withColumn("tier", c.search_tier(F.col(url)))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("tier", order))).filter(F.col("place") <= n)


def location_first(hits: DataFrame, place: str, text: str, n: int, order: str = "seq") -> DataFrame:
    """A batch of n with hits that name the place first."""
    return hits.withColumn("local", F.contains(F.lower(F.col(text)), F.lit(place.lower())).cast("int")).orderBy(F.desc("local"), order).limit(n)


def page_links(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Distinct absolute http(s) targets of the anchors of each page."""
    hrefs = pages.select(key, url, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"#]+)'), 1))).alias("href"))
    root = F.regexp_extract(F.col(url), r"^([a-z]+://[^/?#]*)", 1)
    absolute = F.when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(F.lit("https:"), "href")).when(F.startswith("href", F.lit("/")), F.concat(root, "href")).otherwise(F.concat(root, F.lit("/"), "href"))
    return hrefs.select(key, absolute.alias("link")).filter(F.col("link").rlike("^https?://")).distinct()


def page_titles(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Title (title, else h1) and number of links, by built-in functions."""
    title = F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    h1 = F.regexp_replace(F.regexp_extract(F.col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", "")
    return pages.select(key, F.trim(F.coalesce(c.empty_as_null(title), h1)).alias("title"), F.regexp_count(html, F.lit("<a ")).cast("long").alias("n_links"))


def business_contacts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Distinct role mailboxes in texts."""
    mails = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), 0)).alias("email"))
    return mails.filter(F.split("email", "@")[0].isin(c.rules.ROLE_MAILBOXES)).distinct()


def emails(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Distinct mailboxes with their policy verdict and the hash by which suppression lists name them."""
    mails = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), 0)).alias("email")).distinct()
    return mails.withColumns({"is_role": F.split("email", "@")[0].isin(c.rules.ROLE_MAILBOXES), "digest": F.sha2("email", 256)})


def suppress(contacts: DataFrame, suppressions: DataFrame, as_of: str) -> DataFrame:
    """Drops contacts whose digest is listed and unexpired."""
    live = suppressions.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp"))).select("digest").distinct()
    return contacts.join(live, "digest", "left_anti")
