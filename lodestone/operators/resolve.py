"""Deduplication and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.plans.components import cut

# Words that don't tell titles apart, and companies that name none.
TITLE_NOISE = ["and", "or", "in", "at", "the", "of", "for", "a", "an", "to", "with", "on", "by", "senior", "sr", "junior", "jr", "lead", "staff", "principal", "intern", "remote", "hybrid", "onsite", "fulltime", "parttime"]
NO_COMPANY = ["linkedin hiring post", "linkedin post", "hiring post", "job post", "unknown", "n/a", "confidential", "stealth", "various", "multiple companies"]


def title_parts(title: Column) -> Column:
    """What a comparison of titles reads, to be worked out once for each title before a join: letters, words, missing."""
    words = F.array_except(F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: w != "")), F.array(*map(F.lit, TITLE_NOISE)))
    return F.struct(c.alnum(title).alias("letters"), words.alias("words"), (F.coalesce(title, F.lit("")) == "").alias("missing"))


def compatible_parts(a: Column, b: Column) -> Column:
    """Same or close titles, as title_parts(): equal in letters, contained with a length ratio of 0.75, or half their words shared."""
    x, y = a["letters"], b["letters"]
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
    p, q = a["words"], b["words"]
    shared = F.size(F.array_intersect(p, q)) / F.greatest(F.size(F.array_union(p, q)), F.lit(1))
    return a["missing"] | b["missing"] | (x == y) | ((F.contains(x, y) | F.contains(y, x)) & (ratio >= 0.75)) | (F.size(p) == 0) | (F.size(q) == 0) | (shared >= 0.5)


def compatible_titles(a: Column, b: Column) -> Column:
    """compatible_parts() of two titles."""
    return compatible_parts(title_parts(a), title_parts(b))


PIECE = 4096  # rows of one title in one list, on average
MEET = 256  # lists of a group that meet all its lists in one task


def title_pairs(rows: DataFrame, key: str, title: str, by: list[str]) -> DataFrame:
    """a, b, ok: all pairs a < b of keys that are equal in the columns by, and whether their titles are compatible.

    Rows of a group with the same title are one kind, and the rule is worked out once for two kinds. Keys come in as lists of a
    kind, opened behind the rule, so a pair costs no more than its row. A large kind is cut into several lists, and the lists of a
    large group are dealt over tasks.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = rows.groupBy(*by, F.col(title).alias("title")).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).withColumn("kind", F.struct(*by, "title"))
    dealt = rows.select(*by, F.col(title).alias("title"), F.col(key).alias("id"))
    large = kinds.filter("pieces > 1").select("kind", "pieces")  # few
    dealt = dealt.join(large, F.struct(*by, "title").eqNullSafe(F.col("kind")), "left").withColumn("piece", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int"))
    lists = dealt.groupBy(*by, "title", "piece").agg(F.collect_list("id").alias("ids")).withColumn("parts", title_parts(F.col("title"))).drop("title", "piece")
    lists = cut(lists.withColumn("no", F.monotonically_increasing_id()), "title-lists")
    sizes = lists.groupBy(*by).agg(F.ceil(F.count("*") / MEET).cast("int").alias("deals"))
    lists = lists.join(sizes, by)
    x = lists.select(*by, F.pmod(F.xxhash64("no"), "deals").cast("int").alias("deal"), F.struct("no", "parts", "ids").alias("x")).repartition(tasks, *by, "deal")
    y = lists.select(*by, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.struct("no", "parts", "ids").alias("y")).repartition(tasks, *by, "deal")
    met = x.hint("merge").join(y, [*by, "deal"]).filter(F.col("x.no") <= F.col("y.no"))
    judged = met.select((F.col("x.no") == F.col("y.no")).alias("one"), F.col("x.ids").alias("p"), F.col("y.ids").alias("q"), compatible_parts(F.col("x.parts"), F.col("y.parts")).alias("ok"))
    opened = judged.select("one", "ok", "q", F.explode("p").alias("p")).select("one", "ok", "p", F.explode("q").alias("q"))
    return opened.filter((F.col("p") < F.col("q")) | (~F.col("one") & (F.col("p") > F.col("q")))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "ok")


def said(tag: str, *values: Column) -> Column:
    """A key of that kind, null where a value is missing or blank."""
    filled = F.lit(True)
    for v in values:
        filled = filled & (F.coalesce(v, F.lit("")) != "")
    return F.when(filled, F.concat_ws("::", F.lit(tag), *values))


def with_keys(records: DataFrame, keys: list[Column]) -> DataFrame:
    """Adds the distinct keys in order; a record without any has its id as its key. The parts they are made of are dropped."""
    found = F.array_distinct(F.array_compact(F.array(*keys)))
    return records.withColumn("keys", F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("id::"), F.col("record_id").cast("string"))))).drop("__made")


def key_parts(records: DataFrame):
    """The records, dealt over the tasks, with what their keys are made of; links and letters stand behind an explode, so each is worked out once."""
    low = lambda x: F.lower(F.trim(F.col(x))) if x in records.columns else F.lit(None).cast("string")
    link = lambda x: F.when(~c.is_board_url(F.col(x)), c.canonical_url(F.col(x)))
    named = (F.coalesce(low("company"), F.lit("")) != "") & (F.coalesce(low("title"), F.lit("")) != "") & ~low("company").isin(NO_COMPANY)
    who = F.when(named, F.concat(c.alnum(F.col("company")), F.lit("::"), c.alnum(F.col("title")), F.lit("::")))
    made = F.struct(link("url").alias("url"), link("application_url").alias("application_url"), who.alias("who"))
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.repartition(tasks, "record_id").withColumn("__made", F.explode_outer(F.array(made)))
    mark = lambda tag, place: F.concat(F.lit(tag + "::"), F.col("__made.who"), c.alnum(place))
    return rows, low, lambda x: F.col(f"__made.{x}"), mark


def record_keys(records: DataFrame) -> DataFrame:
    """Keys of records in order: identity, source id, page URL, application URL (each also as a link), fingerprints; else the id."""
    rows, low, link, mark = key_parts(records)
    links = [said(tag, link(x)) for x, own in (("url", "url"), ("application_url", "app")) for tag in (own, "link")]
    return with_keys(rows, [said("ident", low("identity_key")), said("sid", low("source"), low("job_id")), *links, mark("fp", F.col("location")), mark("fpt", F.lit(""))])


def posting_keys(postings: DataFrame) -> DataFrame:
    """Keys of typed postings in order: source id, application URL, page URL, fingerprints with location, city and neither."""
    rows, low, link, mark = key_parts(postings)
    city = F.when(F.coalesce(low("city"), F.lit("")) != "", mark("fp_city", F.col("city"))) if "city" in postings.columns else F.lit(None).cast("string")
    return with_keys(rows, [said("sid", low("source"), low("job_id")), said("app", link("application_url")), said("url", link("url")), mark("fp", F.col("location")), city, mark("fpt", F.lit(""))])


HOT = 4096  # rows of a key from which on it is read in slices
SLICES = 64


def dedupe_by_keys(keyed: DataFrame, order: str = "seq") -> DataFrame:
    """record_id, primary_id from records with keys in order of priority; `order` tells records apart.

    The rule, in order: a record belongs to the holder of its first key whose holder's title is compatible; else it is a
    primary and takes all its keys over. Keys without a holder go to the primary of the first record that brings them.

    Who holds a key thus follows from who is primary before. The statuses of all records are worked out anew from those of
    the last round until none changes. That end is the ordered result, whatever the start: the first records in order are
    right after one round, and each record as soon as all before it that share a key are. Most settle in a few rounds; long
    chains of titles, each compatible with its neighbours only, take more.

    Titles are taken apart once, and keys are numbered, before the rounds: texts that begin alike sort slowly. Each round is a window per key and a grouping per record. Records that share no key take no part. A key of HOT records or
    more is read in slices of order: every slice's last primary and first owner are carried to the slices behind it, so no
    task holds a whole hot key. State is cut by tables in the shared folder.
    """
    base = cut(keyed.select("record_id", F.col(order).alias("ord"), title_parts(F.coalesce("title", F.lit(""))).alias("title"), "keys"), "dedupe-keys")
    each = base.select("ord", F.posexplode("keys").alias("pos", "k"))
    counts = cut(each.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").withColumn("number", F.monotonically_increasing_id()), "dedupe-counts")
    bounds = [x for x in base.agg(F.percentile_approx("ord", [i / SLICES for i in range(1, SLICES)], 10000)).first()[0] or []]
    slice_of = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("ord")))
    shared = each.join(counts, "k").select("ord", F.struct("pos", F.col("number").alias("k"), F.when(F.col("n") >= HOT, slice_of).otherwise(F.lit(-1)).alias("slice")).alias("key"))
    known = shared.groupBy("ord").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    start = F.struct(F.lit(True).alias("head"), F.col("ord").alias("primary"), F.col("title").alias("named"))
    state = cut(base.select("ord", "title").join(known, "ord").select("ord", "title", "keys", start.alias("now")), "dedupe-state")
    while True:
        after = cut(dedupe_round(state), "dedupe-state")
        moved = after.filter("moved").limit(1).count()
        state = after
        if not moved:
            break
    names = base.select(F.col("ord").alias("primary"), F.col("record_id").alias("primary_id"))
    settled = state.select("ord", F.col("now.primary").alias("primary"))
    owned = base.select("record_id", "ord").join(settled, "ord", "left").withColumn("primary", F.coalesce("primary", "ord"))
    return owned.join(names, "primary").select("record_id", "primary_id")


def dedupe_round(state: DataFrame) -> DataFrame:
    """The state after working out every record from the state of those before it."""
    rows = state.select("ord", "title", "now", F.inline("keys"))
    own = F.when(F.col("now.head"), F.struct("ord", "title"))  # a primary holds its keys from its place on
    owner = F.struct(F.col("now.primary").alias("ord"), F.col("now.named").alias("title"))
    whole = rows.filter("slice >= 0").groupBy("k", "slice").agg(F.max_by(own, F.when(F.col("now.head"), F.col("ord"))).alias("last"), F.min_by(owner, "ord").alias("first"))
    earlier = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("k", "slice", F.last("last", ignorenulls=True).over(earlier).alias("last_before"), F.first("first").over(earlier).alias("first_before"))
    before = Window.partitionBy("k", "slice").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(carried, ["k", "slice"], "left")
    last, first = F.coalesce(F.last(own, ignorenulls=True).over(before), "last_before"), F.coalesce("first_before", F.first(owner).over(before))
    met = met.withColumn("holder", F.coalesce(last, first))
    fits = F.col("holder").isNotNull() & compatible_parts(F.col("title"), F.col("holder.title"))
    found = met.groupBy("ord").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("pos", "k", "slice"))).alias("keys"), F.first("now").alias("was"), F.min_by("holder", F.when(fits, F.col("pos"))).alias("holder"))
    now = F.struct(F.col("holder").isNull().alias("head"), F.coalesce("holder.ord", "ord").alias("primary"), F.coalesce("holder.title", "title").alias("named"))
    return found.select("ord", "title", "keys", now.alias("now"), F.col("was").alias("was")).withColumn("moved", (F.col("now.primary") != F.col("was.primary")) | (F.col("now.head") != F.col("was.head"))).drop("was")


def dedupe_records(records: DataFrame, order: str = "seq") -> DataFrame:
    """record_id, primary_id by the keys of record_keys()."""
    return dedupe_by_keys(record_keys(records), order)


def dedupe_postings(postings: DataFrame, order: str = "seq") -> DataFrame:
    """record_id, primary_id by the keys of posting_keys(), which know the city."""
    return dedupe_by_keys(posting_keys(postings), order)


def primary_url(clusters: DataFrame, records: DataFrame, order: str = "seq") -> DataFrame:
    """Application URL of each cluster: a hiring system's or a careers page before an aggregator, then order."""
    url = F.coalesce("application_url", "url")
    rows = clusters.join(records.select("record_id", F.col(order).alias("ord"), url.alias("u")), "record_id").filter("u is not null")
    return rows.groupBy("primary_id").agg(F.min_by("u", F.struct((~c.prefers_apply_url(F.col("u"))).cast("int"), "ord")).alias("primary_url"), F.count("*").alias("n"))


def merge_evidence(clusters: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of duplicates under their primary, distinct by field, document and text."""
    moved = evidence.join(clusters, "record_id")
    return moved.select(F.col("primary_id").alias("record_id"), "field_name", "document_id", "evidence_text").distinct()


def strip_legal(name: Column) -> Column:
    bare = F.regexp_replace(name, r"(?i)\b(ltd|limited|inc|incorporated|corp|corporation|llc|pvt|private|co|company|plc|sa)\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[.,\-]", " "), r"\s+", " "))


def resolve_companies(mentions: DataFrame, order: str = "seq") -> DataFrame:
    """One entity per domain, else symbol, else bare name: first name, aliases, domain."""
    domain = F.regexp_replace(F.lower(F.trim("domain")), r"^(https?://)?(www\.)?", "")
    key = F.when(F.coalesce(domain, F.lit("")) != "", F.concat(F.lit("domain::"), domain)).when(F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit("symbol::"), F.lower("symbol"))).otherwise(F.concat(F.lit("name::"), F.lower(strip_legal(F.col("name")))))
    rows = mentions.withColumns({"key": key, "d": domain})
    return rows.groupBy("key").agg(F.min_by("name", order).alias("canonical"), F.sort_array(F.collect_set("name")).alias("aliases"), F.first("d", ignorenulls=True).alias("domain"), F.count("*").alias("n"))


def resolve_by_key(rows: DataFrame, key: Column, name: str, order: str) -> DataFrame:
    return rows.withColumn("key", key).groupBy("key").agg(F.min_by(name, order).alias("canonical"), F.count_distinct(name).alias("n_names"), F.count("*").alias("n"))


def resolve_postings(postings: DataFrame) -> DataFrame:
    """Key: application URL without its query, else fingerprint."""
    url = F.regexp_replace(F.col("application_url"), r"\?.*$", "")
    return resolve_by_key(postings, F.coalesce(url, c.fingerprint(F.col("company"), F.col("title"), F.col("location"))), "title", "seq")


def resolve_people(people: DataFrame) -> DataFrame:
    """Profile URL, else name and company: never merged across companies; roles become aliases."""
    key = F.coalesce(F.regexp_replace(F.lower("profile"), "/+$", ""), F.concat_ws("@", F.lower(F.trim("name")), F.lower(F.trim("company"))))
    return people.withColumn("key", key).groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.min_by("company", "seq").alias("company"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def resolve_stocks(mentions: DataFrame, universe: DataFrame, banned: list[str]) -> DataFrame:
    """Symbol of each mention: exact symbol, exact alias, contained alias of four letters or more; publishers are dropped.

    Aliases meet mentions by their first word, then containment is checked.
    """
    low = F.lower(F.trim("name"))
    rows = mentions.filter(~c.contains_any(low, banned)).withColumns({"low": low, "up": F.trim(F.split(F.upper(F.trim("name")), r"\.")[0])})
    symbols = universe.select(F.col("symbol").alias("up"), F.col("symbol").alias("s1")).distinct()
    aliases = universe.select("alias", "symbol", F.col("ord")).filter("alias is not null")
    words = rows.select("seq", "low", F.explode(F.array_distinct(F.split("low", " "))).alias("w"))
    inside = words.join(aliases.filter(F.length("alias") >= 4).withColumn("w", F.split("alias", " ")[0]), "w").filter(F.contains("low", "alias")).groupBy("seq").agg(F.min_by("symbol", "ord").alias("s3"))
    exact = aliases.select(F.col("alias").alias("low"), F.col("symbol").alias("s2")).distinct()
    out = rows.join(symbols, "up", "left").join(exact, "low", "left").join(inside, "seq", "left")
    return out.withColumn("symbol", F.coalesce("s1", "s2", "s3")).filter("symbol is not null").select("seq", "name", "symbol")


def merge_candidates(cands: DataFrame, order: str = "seq") -> DataFrame:
    """One row per symbol: first value that is not null of each number, distinct sources, distinct claims."""
    first = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias(x)
    return cands.groupBy("symbol").agg(*[first(x) for x in ("current_price", "change_1w", "volume", "sector")], F.count_distinct("source").alias("sources"), F.count_distinct(F.lower("claim")).alias("claims"))


def validate_symbols(df: DataFrame, universe: DataFrame, sources: list[str], indexes: list[str]) -> DataFrame:
    """Kind of each name: source, index, IPO, listed stock or company."""
    bare = F.upper(F.regexp_replace(F.trim("name"), r"(?i)\.(ns|bo)$", ""))
    joined = df.withColumn("bare", bare).join(universe.select(F.col("symbol").alias("bare"), F.lit(True).alias("listed")).distinct(), "bare", "left")
    low = F.lower("name")
    kind = F.when(c.contains_any(low, sources), "source").when(c.contains_any(low, indexes), "index").when(low.rlike(r"\bipo\b"), "ipo").when(F.col("listed"), "stock").otherwise("company")
    return joined.withColumn("kind", kind)


def latest_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
