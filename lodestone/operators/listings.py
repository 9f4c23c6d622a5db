"""The listing store: upserts, joins, facets, paging, deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.plans.components import cut


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], order: str) -> DataFrame:
    """Latest row of each key by order (new wins ties); the columns in keep come from the oldest row of the key."""
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    rest = [x for x in old.columns if x not in keys]
    at = F.struct(F.col(order), "side")
    aggs = [F.min_by(x, at).alias(x) if x in keep else F.max_by(x, at).alias(x) for x in rest]
    return both.groupBy(*keys).agg(*aggs).select(*old.columns)


def upsert_records(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Repairs dangling document ids to a document of the run (the smallest), else null."""
    docs = documents.select("run_id", F.col("document_id").alias("live")).distinct()
    spare = docs.groupBy("run_id").agg(F.min("live").alias("spare"))
    found = records.join(docs, (records["run_id"] == docs["run_id"]) & (records["document_id"] == docs["live"]), "left").drop(docs["run_id"])
    return found.join(spare, "run_id", "left").withColumn("document_id", F.coalesce("live", "spare")).drop("live", "spare")


def live_evidence(evidence: DataFrame, records: DataFrame) -> DataFrame:
    return evidence.join(records.select("record_id").distinct(), "record_id", "left_semi")


def with_evidence(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Nests the evidence of each record, ordered."""
    nested = evidence.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("field_name", "document_id", "evidence_text", "supports_value"))).alias("evidence"))
    return records.join(nested, "record_id", "left")


def listing_detail(records: DataFrame, status: DataFrame, evidence: DataFrame) -> DataFrame:
    told = status.groupBy("record_id").agg(F.max_by("applied_status", "updated_at").alias("applied_status"), F.max_by("interview_status", "updated_at").alias("interview_status"))
    out = with_evidence(records, evidence).join(told, "record_id", "left")
    return out.withColumns({"applied_status": F.coalesce("applied_status", F.lit("not_applied")), "interview_status": F.coalesce("interview_status", F.lit("none")), "n_evidence": F.coalesce(F.size("evidence"), F.lit(0))})


def latest_listing(records: DataFrame) -> DataFrame:
    """Best row of each title and company: no duplicate first, then confidence and creation."""
    w = Window.partitionBy(F.lower(F.trim("title")), F.lower(F.trim("company"))).orderBy((F.col("status") == "duplicate").cast("int"), F.desc_nulls_last("confidence"), F.desc("created_at"), F.desc("seq"))
    return records.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def eligible_listings(records: DataFrame) -> DataFrame:
    """Verified or reviewable rows with a title that can be shown."""
    low = F.lower(F.trim("title"))
    return records.filter(F.col("status").isin("verified", "needs_review") & (F.coalesce("confidence", F.lit(1.0)) >= 0.5) & (F.length(low) >= 3) & ~low.isin("unknown", "n/a", "none", "null") & ~c.is_listing_title(F.col("title")))


def listing_count(records: DataFrame) -> DataFrame:
    return eligible_listings(records).groupBy("run_id").agg(F.count_distinct(F.lower(F.trim("title")), F.lower(F.trim("company"))).alias("total"))


def page(records: DataFrame, limit: int, offset: int) -> DataFrame:
    return records.orderBy(F.desc("created_at"), F.desc("seq")).offset(offset).limit(limit)


def page_after(records: DataFrame, created_at: str, seq: int, limit: int) -> DataFrame:
    """Keyset paging: rows behind the last one seen, without the cost of a deep offset."""
    last = F.lit(created_at).cast("timestamp")
    return records.filter((F.col("created_at") < last) | ((F.col("created_at") == last) & (F.col("seq") < seq))).orderBy(F.desc("created_at"), F.desc("seq")).limit(limit)


def cap(ranked: DataFrame, n: int, group: str, order: list) -> DataFrame:
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def shown_place(location: Column) -> Column:
    """A location as it is shown: the address parts of an object given as text, no brackets or quotes around it, a word for none."""
    part = lambda name: F.regexp_extract(location, rf"(?i){name}['\"]\s*:\s*['\"]([^'\"]+)['\"]", 1)
    parts = F.concat_ws(", ", *[c.empty_as_null(F.trim(part(name))) for name in ("addressLocality", "addressRegion", "addressCountry")])
    plain = F.regexp_replace(location, r"""^['"{}\[\]\s]+|['"{}\[\]\s]+$""", "")
    none = F.lower(F.trim(F.coalesce(location, F.lit("")))).isin("", "unspecified")
    return F.when(none, "Remote / Unspecified").when(parts != "", parts).when(plain != "", plain).otherwise("Remote / Unspecified")


def facets(records: DataFrame, tops: dict[str, int] | None = None) -> DataFrame:
    """Listings by company, place, work mode and status in one pass over the rows, the largest first: facet, value, n, place.

    A blank company is a direct employer. A listing whose location says remote, or says nothing, is remote, any other on-site.
    Places without a name get no row, nor does the place "remote", though it keeps its number. tops: rows kept of a facet (by
    default all).
    """
    here = shown_place(F.col("location"))
    remote = F.contains(F.lower(F.coalesce("location", F.lit(""))), F.lit("remote")) | F.contains(F.lower(here), F.lit("remote"))
    shown = records.select(F.coalesce(c.empty_as_null(F.trim("company")), F.lit("Direct Employer")).alias("company"), here.alias("location"), F.when(remote, "remote").otherwise("onsite").alias("mode"), "status")
    names = ["company", "location", "mode", "status"]
    sets = shown.groupingSets([[x] for x in names], *names).agg(F.count("*").alias("n"), F.grouping_id(*names).alias("g"))
    facet = F.when(F.col("g") == 7, "company").when(F.col("g") == 11, "location").when(F.col("g") == 13, "mode").otherwise("status")
    named = sets.select(facet.alias("facet"), F.coalesce(*names).alias("value"), "n").filter((F.col("facet") != "location") | ~F.contains(F.lower("value"), F.lit("unspecified")))
    out = named.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")))
    for name, most in (tops or {}).items():
        out = out.filter((F.col("facet") != name) | (F.col("place") <= most))
    return out.filter((F.col("facet") != "location") | (F.lower("value") != "remote"))


def status_totals(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("total"), F.count_if(F.col("applied_status") == "applied").alias("applied"), F.count_if(F.col("interview_status") == "scheduled").alias("interviewing"))


def saved_listings(saved: DataFrame, records: DataFrame) -> DataFrame:
    return saved.join(records, "record_id").orderBy(F.desc("updated_at"), "record_id")


def drop_ignored(records: DataFrame, ignored: DataFrame) -> DataFrame:
    return records.join(ignored.select("record_id").distinct(), "record_id", "left_anti")


def pending_changes(changes: DataFrame, records: DataFrame) -> DataFrame:
    return changes.filter(~F.col("notified")).join(records, "record_id")


def profile_lookup(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """Latest profile by normalized company name."""
    key = lambda x: F.lower(c.clean_company(F.col(x)))
    latest = profiles.groupBy(key("company").alias("key")).agg(F.max_by("profile", F.struct("updated_at", "profile")).alias("profile"))
    return names.withColumn("key", key("company")).join(latest, "key", "left")


def listing_health(saved: DataFrame, docs: DataFrame) -> DataFrame:
    """State of each saved listing by the newest document fetched for it."""
    newest = docs.groupBy("document_id").agg(F.max_by(F.struct("http_status", "text"), "retrieved_at").alias("d"))
    gone = c.contains_any(F.lower(F.col("d.text")), c.rules.EXPIRED_SIGNALS)
    state = F.when(F.col("d").isNull(), "missing").when(F.col("d.http_status").isin(404, 410), "removed").when(gone, "closed").otherwise("open")
    return saved.join(newest, "document_id", "left").withColumn("state", state).drop("d")


def unprocessed(raw: DataFrame, *done: DataFrame) -> DataFrame:
    """Rows whose id no terminal set has."""
    for ids in done:
        raw = raw.join(ids.select("record_id").distinct(), "record_id", "left_anti")
    return raw


def merge_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of source tables in order; the first row of each identity key, and every row without one."""
    both = first.withColumn("side", F.lit(0))
    for k, df in enumerate(others, 1):
        both = both.unionByName(df.withColumn("side", F.lit(k)), allowMissingColumns=True)
    keyed = both.withColumn("merge_key", F.when(F.col("crawl_key") != "", F.col("crawl_key")).otherwise(F.concat_ws("#", F.lit(""), "side", "seq")))
    w = Window.partitionBy("merge_key").orderBy("side", "seq")
    return keyed.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place", "merge_key")


def cascade_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids and their clones: same title (3 characters or more) and company, same posting URL, or same identity key.

    Every record has up to three keys; keys and records meet once. Blank titles, companies, URLs and keys never match.
    """
    title, company = F.lower(F.trim("title")), F.lower(F.trim("company"))
    keys = [
        F.when((F.length(title) >= 3) & (company != ""), F.concat_ws("|", F.lit("name"), title, company)),
        F.when((F.length("url") > 12) & ~c.is_board_url(F.col("url")), F.concat_ws("|", F.lit("url"), c.canonical_url(F.col("url")))),
    ]
    if "identity_key" in records.columns:
        keys.append(F.when(F.col("identity_key") != "", F.concat_ws("|", F.lit("identity"), "identity_key")))
    chosen = ids.select("record_id").distinct()
    keyed = records.select("record_id", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    wanted = keyed.join(chosen, "record_id", "left_semi").select("key").distinct()
    return keyed.join(wanted, "key", "left_semi").select("record_id").unionByName(records.select("record_id").join(chosen, "record_id", "left_semi")).distinct()


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the ids' closure, which is computed once and kept in the shared folder."""
    gone = cut(cascade_ids(tables["records"], ids), "closure")
    return {name: df.join(gone, "record_id", "left_anti") for name, df in tables.items()}


def retention(df: DataFrame, ts: str, classes: dict[str, int], kind: str, as_of: str) -> DataFrame:
    """Drops rows older than the days of their class."""
    days = F.lit(None).cast("int")
    for name, n in classes.items():
        days = F.when(F.col(kind) == name, n).otherwise(days)
    return df.filter(days.isNull() | (F.datediff(F.lit(as_of).cast("date"), F.col(ts)) <= days))


def listing_filters(records: DataFrame, query: str = "", statuses: list[str] | None = None, locations: list[str] | None = None, max_age_days: int | None = None) -> DataFrame:
    """Text search over the shown columns and multi-select filters."""
    if query:
        blob = F.lower(F.concat_ws(" ", "title", "company", "location", "salary", "skills", "source"))
        for word in query.lower().split():
            records = records.filter(F.contains(blob, F.lit(word)))
    if statuses:
        records = records.filter(F.col("status").isin(statuses))
    if locations:
        records = records.filter(F.col("location").isin(locations))
    if max_age_days is not None:
        records = records.filter(F.col("posted_age_seconds") <= max_age_days * 86400)
    return records


def run_diagnostics(records: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return records.groupBy("run_id").agg(F.count("*").alias("candidates"), *map(count, ("verified", "needs_review", "rejected", "duplicate")), F.count_if(F.col("salary").isNotNull() & (F.col("salary") != "")).alias("with_salary"))


def is_at(place: str) -> Column:
    """Whether a location has the wanted place or a word of it; a null has none."""
    low = F.coalesce(F.lower("location"), F.lit(""))
    words = sorted({place.lower(), *place.lower().split()})
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


NO_EXPERIENCE = "experience_min IS NULL AND experience_max IS NULL"


def coverage_report(records: DataFrame, locations: list[str]) -> DataFrame:
    """Per wanted place: listings, how many of them lack a date or an experience, and a status. Places without any have zeros.

    The places are columns of one aggregate, so the rows are read once and never joined.
    """
    undated, unknown = F.col("posted_age_seconds").isNull(), F.expr(NO_EXPERIENCE)
    one = lambda p: F.struct(F.lit(p).alias("place"), F.count_if(is_at(p)).alias("n"), F.count_if(is_at(p) & undated).alias("undated"), F.count_if(is_at(p) & unknown).alias("unknown_experience"))
    told = records.agg(F.array(*map(one, locations)).alias("told")).select(F.inline("told"))
    return told.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") < 5, "weak").otherwise("covered"))


def run_coverage(runs: DataFrame, records: DataFrame, tasks: DataFrame, locations: list[str], target: int, as_of: str, max_search_calls: int = 150, max_fetch_calls: int = 300) -> DataFrame:
    """One row a run: what was found, what the crawl left, which budgets were reached, and how far the run may be trusted.

    runs: run_id, search_calls, fetch_calls, deadline. records: run_id, status, qualified, location, experience_min,
    experience_max, posted_age_seconds. tasks: run_id, state (completed, partial, blocked, failed or pending). A run past its
    deadline is interrupted; else one with a budget reached, work left or a partial task is partial; else one without a
    qualified row but with failed or blocked tasks has failed; any other is complete within its scope. Wanted places without
    a qualified row are weak areas. A run without records or tasks has zeros.
    """
    good, count = F.coalesce("qualified", F.lit(False)), lambda s: F.count_if(F.col("status") == s)
    found = records.groupBy("run_id").agg(
        F.count("*").alias("raw"), count("duplicate").alias("duplicates"), count("verified").alias("verified"), count("rejected").alias("rejected"), F.count_if(good).alias("qualified"),
        F.count_if(good & F.expr(NO_EXPERIENCE)).alias("unknown_experience"), F.count_if(good & F.col("posted_age_seconds").isNull()).alias("unknown_date"),
        F.array_compact(F.array(*[F.when(F.count_if(good & is_at(p)) > 0, F.lit(p)) for p in locations])).alias("reached"),
    )
    states = ("completed", "partial", "blocked", "failed", "pending")
    crawl = tasks.groupBy("run_id").agg(F.count("*").alias("discovered"), *[F.count_if(F.col("state") == s).alias(s) for s in states])
    none = F.array().cast("array<string>")
    out = runs.join(found, "run_id", "left").join(crawl, "run_id", "left").fillna(0, ["raw", "duplicates", "verified", "rejected", "qualified", "unknown_experience", "unknown_date", "discovered", *states])
    over = [("max_search_calls", F.col("search_calls") >= max_search_calls), ("max_fetch_calls", F.col("fetch_calls") >= max_fetch_calls), ("deadline_exceeded", F.col("deadline") <= F.lit(as_of).cast("timestamp"))]
    out = out.withColumns({
        "unique": F.col("raw") - F.col("duplicates"), "weak_areas": F.array_except(F.array(*map(F.lit, locations)), F.coalesce("reached", none)) if locations else none,
        "budgets_reached": F.array_compact(F.array(*[F.when(reached, F.lit(name)) for name, reached in over])),
    }).drop("reached")
    status = (
        F.when(F.array_contains("budgets_reached", "deadline_exceeded"), "interrupted").when((F.size("budgets_reached") > 0) | (F.col("pending") + F.col("partial") > 0), "partial")
        .when((F.col("qualified") == 0) & (F.col("failed") + F.col("blocked") > 0), "failed").otherwise("complete_within_scope")
    )
    enough = (F.col("qualified") >= target) | ((F.size("weak_areas") == 0) & (F.col("qualified") > 0))
    return out.withColumn("run_status", status).withColumns({"can_resume": F.col("run_status").isin("interrupted", "partial"), "is_sufficient": enough})


def csv_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """Cells that a spreadsheet would run as formulas get a leading quote."""
    return df.select(*[x if x not in names else F.when(F.ltrim(F.regexp_replace(x, r"^\s+", "")).rlike(r"^[=+\-@%]") | F.col(x).rlike(r"^[\t\r]"), F.concat(F.lit("'"), x)).otherwise(F.col(x)).alias(x) for x in df.columns])


def ops_metrics(calls: DataFrame) -> DataFrame:
    """Errors and durations by tool and domain, with subtotals."""
    out = calls.rollup("tool", "domain").agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"), F.percentile("duration", 0.5).alias("p50"), F.percentile("duration", 0.95).alias("p95"))
    return out.withColumn("error_rate", F.col("errors") / F.col("n"))


def ops_sketches(calls: DataFrame, k: int = 200) -> DataFrame:
    """A quantile sketch of the durations, calls and errors of each tool and domain, to be stored and added up later.

    A quantile of a sketch is off by some 1.65 % of the rows in rank for k = 200, with 99 % confidence.
    """
    return calls.groupBy("tool", "domain").agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"), F.kll_sketch_agg_double("duration", F.lit(k)).alias("sketch"))


def ops_rollup(sketches: DataFrame) -> DataFrame:
    """Calls, errors and durations by tool and domain with subtotals, out of the sketches of ops_sketches() alone."""
    out = sketches.rollup("tool", "domain").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return out.select("tool", "domain", "n", "errors", F.try_divide("errors", "n").alias("error_rate"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def quality_metrics(records: DataFrame, evidence: DataFrame, required: list[str]) -> DataFrame:
    """Per run: acceptance, required fields filled, filled fields with evidence, duplicates, and records with a field whose evidence disagrees.

    records: run_id, record_id, status and the required columns (text); evidence: record_id, field_name, supports_value. A rate
    without anything to count is null.
    """
    told = evidence.filter(F.col("field_name").isin(required)).groupBy("record_id", "field_name").agg((F.min("supports_value") != F.max("supports_value")).alias("disagrees"))
    told = told.groupBy("record_id").agg(F.collect_set("field_name").alias("told"), F.bool_or("disagrees").alias("conflict"))
    filled = {x: F.coalesce(F.trim(x), F.lit("")) != "" for x in required}
    add = lambda tests: reduce(lambda a, b: a + b, [t.cast("int") for t in tests])
    has = lambda x: F.coalesce(F.array_contains("told", x), F.lit(False))
    rows = records.join(told, "record_id", "left").select("run_id", "status", add(filled.values()).alias("filled"), add([f & has(x) for x, f in filled.items()]).alias("proved"), F.coalesce("conflict", F.lit(False)).alias("conflict"))
    rate = lambda a, b: F.try_divide(a, b)
    n = F.count("*")
    return rows.groupBy("run_id").agg(
        n.alias("n"), rate(F.count_if(F.col("status") == "verified"), n).alias("acceptance_rate"), rate(F.sum("filled"), n * len(required)).alias("field_completeness"), rate(F.sum("proved"), F.sum("filled")).alias("evidence_coverage"),
        rate(F.count_if(F.col("status") == "duplicate"), n).alias("duplicate_rate"), rate(F.count_if("conflict"), n).alias("conflict_rate"),
    )


def run_rates(covered: DataFrame) -> DataFrame:
    """Shares of the runs of run_coverage() that are complete, partial, interrupted, failed and able to go on."""
    n = F.count("*")
    share = lambda s: F.try_divide(F.count_if(F.col("run_status") == s), n)
    return covered.agg(n.alias("runs"), share("complete_within_scope").alias("success_rate"), share("partial").alias("partial_rate"), share("interrupted").alias("interrupted_rate"), share("failed").alias("failure_rate"), F.try_divide(F.count_if("can_resume"), n).alias("resumable_rate"))
