"""Readers of stored hiring-system payloads and pages: JSON or HTML in, postings out.

A kind of payload is a JSON schema and a mapping; register_source() adds one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTING = ("title", "location", "url", "posted_at", "department")
SOURCES: dict[str, tuple[str, str | None, Callable[[Column, Column], dict[str, Column]]]] = {}


def register_source(kind: str, schema: str, rows: str | None, mapping: Callable[[Column, Column], dict[str, Column]]) -> None:
    """schema: of the whole payload; rows: the array in it (None: the payload is the array); mapping: (row, company) to columns."""
    SOURCES[kind] = (schema, rows, mapping)


register_source(
    "greenhouse", "jobs array<struct<title:string,location:struct<name:string>,absolute_url:string,updated_at:string,departments:array<struct<name:string>>>>", "jobs",
    lambda j, c: {"title": j["title"], "location": j["location"]["name"], "url": j["absolute_url"], "posted_at": j["updated_at"], "department": F.try_element_at(j["departments"], F.lit(1))["name"]},
)
register_source(
    "lever", "array<struct<text:string,title:string,categories:struct<location:string,team:string>,hostedUrl:string,applyUrl:string,createdAt:bigint>>", None,
    lambda j, c: {"title": F.coalesce(j["text"], j["title"]), "location": j["categories"]["location"], "url": F.coalesce(j["hostedUrl"], j["applyUrl"]), "posted_at": j["createdAt"].cast("string"), "department": j["categories"]["team"]},
)
register_source(
    "ashby", "jobs array<struct<title:string,location:string,jobUrl:string,applyUrl:string,publishedAt:string,department:string>>", "jobs",
    lambda j, c: {"title": j["title"], "location": j["location"], "url": F.coalesce(j["jobUrl"], j["applyUrl"]), "posted_at": j["publishedAt"], "department": j["department"]},
)
register_source(
    "workable", "results array<struct<title:string,city:string,country:string,shortcode:string,published:string,department:string>>", "results",
    lambda j, c: {"title": j["title"], "location": F.coalesce(j["city"], j["country"]), "url": F.format_string("https://apply.workable.com/%s/j/%s/", c, j["shortcode"]), "posted_at": j["published"], "department": j["department"]},
)
register_source(
    "smartrecruiters", "content array<struct<id:string,name:string,releasedDate:string,location:struct<city:string,country:string>,department:struct<label:string>>>", "content",
    lambda j, c: {"title": j["name"], "location": F.concat_ws(", ", j["location"]["city"], j["location"]["country"]), "url": F.format_string("https://jobs.smartrecruiters.com/%s/%s", c, j["id"]), "posted_at": j["releasedDate"], "department": j["department"]["label"]},
)


def read_payloads(payloads: DataFrame, kind: str) -> DataFrame:
    """company and the columns of POSTING from payloads (company, payload); broken JSON gives no rows."""
    schema, rows, mapping = SOURCES[kind]
    parsed = F.from_json("payload", schema)
    each = payloads.select("company", F.explode(parsed[rows] if rows else parsed).alias("j"))
    columns = mapping(F.col("j"), F.col("company"))
    return each.select("company", *[columns[n].alias(n) for n in POSTING]).filter(F.coalesce(F.trim("title"), F.lit("")) != "")


JSONLD = "`@type` string, title string, datePosted string, hiringOrganization struct<name:string>, jobLocation array<struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>>, baseSalary struct<currency:string,value:struct<minValue:double,maxValue:double>>, `@graph` array<string>"


def jsonld_postings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """schema.org postings in ld+json scripts, as an object, in a list or in @graph."""
    scripts = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)).alias("text"))
    listed = F.when(F.trim("text").startswith("["), F.from_json("text", "array<string>")).otherwise(F.array("text"))
    items = scripts.select(key, F.explode(listed).alias("text")).withColumn("d", F.from_json("text", JSONLD))
    whole = items.select(key, F.explode(F.when(F.col("d.`@graph`").isNotNull(), F.transform("d.`@graph`", lambda g: F.from_json(g, JSONLD))).otherwise(F.array("d"))).alias("p")).filter("p.`@type` = 'JobPosting'")
    place = F.try_element_at("p.jobLocation", F.lit(1))["address"]
    return whole.select(key, F.col("p.title").alias("title"), F.col("p.hiringOrganization.name").alias("company"), F.concat_ws(", ", place["addressLocality"], place["addressRegion"], place["addressCountry"]).alias("location"), F.col("p.datePosted").alias("posted_at"), F.col("p.baseSalary.value.minValue").alias("salary_min"), F.col("p.baseSalary.value.maxValue").alias("salary_max"), F.col("p.baseSalary.currency").alias("currency"))


# Elements without main text, marks of clutter in a class or an id, and of the part with the content.
SKIPPED = {"script", "style", "nav", "footer", "header", "noscript", "svg", "iframe", "aside", "form"}
CLUTTER = re.compile("sidebar|ad-|ads-|advertisement|banner|newsletter|cookie|popup|modal|social-share|share-buttons|author-box|related-posts|comments|menu-main|navbar", re.IGNORECASE)
CONTENT = re.compile("content|markdown-body|documentation|post-content", re.IGNORECASE)
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
# The metas that a value is taken from, and the words that make a JSON-LD script a posting's.
METAS = {"og:title": "title", "twitter:title": "title", "og:description": "description", "twitter:description": "description", "description": "description", "og:url": "url", "twitter:url": "url"}
SCHEMA_WORDS = ("JobPosting", "datePosted", "hiringOrganization")


LONE = re.compile(r"&(?!#?[0-9A-Za-z]+;)")


class Element(NamedTuple):
    tag: str
    hidden: bool
    parts: tuple[int, ...]  # the content parts it lies in


class PageReader(HTMLParser):
    """One pass over a page: title, metas, JSON-LD scripts, and its text as a whole and by parts with content.

    Parts are numbered as they begin and ranked by what marks them: a main or article element, the main role, a class.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lone = "&#38;"
        self.open: list[Element] = []
        self.ranks: list[int] = []
        self.said: dict[int, list[str]] = {-1: []}  # -1: the whole page
        self.title: list[str] = []
        self.titles = 0
        self.h1: list[str] = []
        self.h1s = 0
        self.meta: dict[str, str] = {}
        self.snippets: list[str] = []
        self.script: list[str] | None = None
        self.code: list[str] | None = None

    def feed(self, data: str) -> None:
        """A whole page. References count only with their semicolon, so any other & is written out as one that the page lacks."""
        while self.lone in data:
            self.lone = self.lone.replace("#", "#0")
        super().feed(LONE.sub(self.lone, data))

    def add(self, text: str) -> None:
        here = self.open[-1] if self.open else Element("", False, ())
        if not here.hidden:
            for part in (-1, *here.parts):
                self.said[part].append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            name, value = METAS.get((named.get("property") or named.get("name", "")).lower()), named.get("content", "").strip()
            if name and value:
                self.meta.setdefault(name, value)
        if tag in VOID:
            return
        above = self.open[-1] if self.open else Element("", False, ())
        hidden = above.hidden or tag in SKIPPED or bool(CLUTTER.search(named.get("class", "")) or CLUTTER.search(named.get("id", "")))
        rank = 0 if tag in ("main", "article") else 1 if named.get("role") == "main" else 2 if CONTENT.search(named.get("class", "")) else None
        parts = above.parts
        if rank is not None and not hidden:
            parts = (*parts, len(self.ranks))
            self.said[len(self.ranks)] = []
            self.ranks.append(rank)
        self.open.append(Element(tag, hidden, parts))
        self.titles += tag == "title"
        self.h1s += tag == "h1"
        if tag == "script" and named.get("type") == "application/ld+json":
            self.script = []
        if tag == "pre" and self.code is None:
            self.code = []

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag), None)
        if at is None:
            return
        if tag == "script" and self.script is not None:
            content = "".join(self.script).strip()
            if any(w in content for w in SCHEMA_WORDS):
                self.snippets.append(content)
            self.script = None
        if self.code is not None and not any(e.tag == "pre" for e in self.open[:at]) and any(e.tag == "pre" for e in self.open[at:]):
            self.end_code()
        del self.open[at:]

    def end_code(self) -> None:
        code = "".join(self.code or []).strip()
        if code:
            self.add(f"\n\n```python\n{code}\n```\n\n")
        self.code = None

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in self.CDATA_CONTENT_ELEMENTS:  # read as it stands, without references
            data = data.replace(self.lone, "&")
        tag = self.open[-1].tag if self.open else ""
        if self.script is not None:
            self.script.append(data)
        if tag == "title" and self.titles == 1:
            self.title.append(data)
        if self.h1s == 1 and any(e.tag == "h1" for e in self.open):
            self.h1.append(data)
        if self.code is not None:
            self.code.append(data)
        else:
            self.add(data)

    def close(self) -> None:
        super().close()
        if self.code is not None:
            self.end_code()

    def lines(self, part: int) -> list[str]:
        return [x for line in "\n".join(self.said[part]).splitlines() if (x := line.strip())]

    def text(self) -> str:
        first = min(range(len(self.ranks)), key=lambda i: (self.ranks[i], i), default=-1)
        lines = self.lines(first)
        return "\n".join(lines if sum(map(len, lines)) > 200 else self.lines(-1))


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html", snippets: int | None = None) -> DataFrame:
    """Title (title, meta title or first h1), metas (title, description, url), JSON-LD of postings and main text of each page.

    The main text is that of the first main or article element (else of the main role, else of a class for content) if it has
    over 200 characters in its lines, else the page's, without clutter, a line for each line of it; code blocks are fenced. snippets: JSON-LD
    scripts kept (by default all). A null page gives empty values.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, page in zip(pdf[key], pdf[html].fillna("")):
                p = PageReader()
                p.feed(page)
                p.close()
                title = "".join(p.title).strip() or p.meta.get("title") or "".join(p.h1).strip()
                rows.append((k, title, p.meta, p.snippets if snippets is None else p.snippets[:snippets], p.text()))
            yield pd.DataFrame(rows, columns=[key, "title", "meta", "snippets", "text"])

    return pages.select(key, html).mapInPandas(run, T.StructType([pages.schema[key], *T.StructType.fromDDL("title string, meta map<string,string>, snippets array<string>, text string")]))


def with_metadata(pages: DataFrame) -> DataFrame:
    """Rows of page_text() with the metas and JSON-LD as blocks before the text, as claim_passages() reads them."""
    block = lambda name, end, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"--- STRUCTURED {name} ---\n"), F.array_join(lines, "\n"), F.lit(f"\n--- END {end} ---\n\n"))).otherwise("")
    metas = F.array_compact(F.transform(F.array(*map(F.lit, ("title", "description", "url"))), lambda k: F.concat(F.upper(k), F.lit(": "), F.try_element_at("meta", k))))
    return pages.withColumn("text", F.concat(block("JOB SCHEMA (JSON-LD)", "STRUCTURED SCHEMA", F.col("snippets")), block("PAGE METADATA", "PAGE METADATA", metas), "text"))


# Words that mark a section as no answer, and titles that are none.
NO_ANSWER = [
    "cookie", "privacy", "terms", "sign in", "login", "subscribe", "footer", "header", "navigation", "search", "table of contents", "faq", "frequently asked", "resources", "related posts", "about us", "contact us", "author", "categories", "user agreement", "disclaimer",
    "structured page metadata", "end page metadata", "page metadata", "metadata", "advertisement", "share on", "share this", "comments", "leave a reply", "breadcrumb", "sidebar", "copyright", "back to top",
]
NO_TITLE = ["leo", "xl", "metadata"]


def answer_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: str = "", most: int | None = None, paragraphs: int | None = None) -> DataFrame:
    """Headed sections that answer something: key, place, topic, section_title, summary, key_points.

    A heading is a line of one or more # and 1 to 89 characters. Texts without a headed section give their paragraphs of over
    80 characters, named by their first 60. Sections with a noise word in the heading, a title outside 3 to 80 characters or a
    body under 30 go, and so does a title seen before in the document. All work stays in the row: no shuffle. most: sections
    kept of a document, paragraphs: those tried of one without headings (default: all). Null and empty texts give no row.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    noisy = lambda x: F.lower(x).rlike("|".join(NO_ANSWER))
    of = lambda heading, body: F.struct(heading.alias("heading"), body.alias("body"))
    head = r"[^\S\n]*#+[^\S\n]*[^\s#](?:[^\n]{0,87}\S)?[^\S\n]*(?:\n|$)"
    parts = F.filter(F.split(text, rf"(?d)(?<![^\n])(?={head})"), lambda p: p.rlike(rf"(?d)\A{head}"))
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != "")
    headed = F.transform(parts, lambda p: of(strip(F.regexp_extract(p, r"(?d)^\s*#+([^\n]*)", 1)), F.array_join(F.slice(lines(p), 2, F.size(lines(p))), "\n")))
    headed = F.filter(headed, lambda s: s["body"] != "")
    blocks = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > 80)
    blocks = blocks if paragraphs is None else F.slice(blocks, 1, paragraphs)
    plain = F.transform(blocks, lambda p: of(F.substring(F.substring_index(p, "\n", 1), 1, 60), p))

    def titled(s):
        return F.struct(F.regexp_replace(s["heading"], r"^[0-9.\-\s]+", "").alias("title"), s["body"].alias("body"), noisy(s["heading"]).alias("noisy"))

    def kept(s):
        return ~s["noisy"] & F.length(s["title"]).between(3, 80) & ~F.lower(s["title"]).isin(NO_TITLE) & (F.length(s["body"]) >= 30)

    found = docs.select(key, headed.alias("headed"), plain.alias("plain")).select(key, F.when(F.size("headed") > 0, F.col("headed")).otherwise(F.col("plain")).alias("s"))
    found = found.select(key, F.filter(F.transform("s", titled), kept).alias("s")).withColumn("names", F.transform("s", lambda s: F.lower(s["title"])))
    first = F.filter("s", lambda s, i: F.array_position(F.col("names"), F.lower(s["title"])) == i + 1)
    rows = found.select(key, F.posexplode(first if most is None else F.slice(first, 1, most)).alias("at", "s"))
    rows = rows.select(key, (F.col("at") + 1).alias("place"), F.col("s.title").alias("section_title"), F.col("s.body").alias("body"))
    rows = rows.withColumn("sentences", F.filter(F.transform(F.split("body", r"[.\n]"), strip), lambda x: F.length(x) > 20))
    whole = F.coalesce(F.get("sentences", F.lit(0)), F.substring("body", 1, 200))
    rows = rows.withColumn("summary", F.when(F.length(whole) > 300, F.concat(F.substring(whole, 1, 297), F.lit("..."))).otherwise(whole))
    points = F.filter(F.transform(F.regexp_extract_all("body", F.lit(r"(?md)^[-*\u2022]\s*(.+)$"), 1), strip), lambda p: F.length(p).between(16, 179) & ~noisy(p))
    later = F.slice("sentences", 2, 3)
    picked = F.when(F.size(points) > 0, F.slice(points, 1, 5)).when(F.size(later) > 0, later).otherwise(F.array("summary"))
    return rows.select(key, "place", (F.lit(topic) if topic else F.col("section_title")).alias("topic"), "section_title", "summary", picked.alias("key_points"))


def people_roles(hits: DataFrame, roles: list[tuple[str, str]], most: int = 5) -> DataFrame:
    """Name and role from profile titles (Name - Role - Company), distinct names per company."""
    parts = F.split("title", r"\s+[-–|]\s+")
    low = F.lower(F.try_element_at(parts, F.lit(2)))
    role = F.lit(None).cast("string")
    for name, pattern in reversed(roles):
        role = F.when(low.rlike(pattern), name).otherwise(role)
    rows = hits.select("company", "seq", F.trim(parts[0]).alias("name"), role.alias("role"), "url").filter("role is not null and name <> ''")
    first = rows.groupBy("company", "name").agg(F.min("seq").alias("seq"), F.min_by("role", "seq").alias("role"), F.min_by("url", "seq").alias("url"))
    return first.withColumn("place", F.expr("row_number() OVER (PARTITION BY company ORDER BY seq)")).filter(F.col("place") <= most)
