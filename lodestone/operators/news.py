"""News events: articles on one event, found by first fit over their titles, with the event's facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.postings import freshness_rating
from lodestone.plans.components import cut

# Words of good and bad news, and terms of high impact.
GOOD = ["surge", "jump", "rally", "profit", "growth", "expansion", "beat", "strong", "upgrade", "record", "order", "contract", "breakthrough", "partnership", "success"]
BAD = ["fall", "drop", "slump", "loss", "decline", "probe", "lawsuit", "penalty", "downgrade", "debt", "miss", "weak", "resignation", "investigation", "layoff", "cut"]
IMPACT = ["acquisition", "merger", "earnings", "quarterly results", "regulatory probe", "sebi", "sec", "bankruptcy", "default", "ipo", "delisting", "dividend"]
UNTITLED = "Corporate / Market Development"
DATES = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd"]


def title_tokens(title: Column) -> Column:
    """Distinct words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{4,}(?![\p{L}\p{N}_])"), 0))


def subsets(tokens: Column, size: int) -> Column:
    """All subsets of that size of a sorted array, as strings."""
    if size == 1:
        return tokens
    one = lambda t, i: F.transform(subsets(F.slice(tokens, i + 2, F.size(tokens)), size - 1), lambda rest: F.concat_ws(" ", t, rest))
    return F.flatten(F.transform(tokens, one))


def cluster_news(articles: DataFrame, order: str = "seq") -> DataFrame:
    """order, cluster: an article joins the earliest cluster whose first article shares 3 tokens or half of its own.

    An article of n tokens joins a first article that has some 3 of them (n of 5 or more), 2 (n of 3 or 4) or 1 (n of 1 or 2).
    So articles meet on such subsets as keys, never in pairs: it joins the smallest first article over its keys. Tokens
    that only one title has are left out of the keys. Titles with the same tokens are one item, as a copy always joins what its original
    joined or the original itself.

    Rounds settle items: one is a first article if no key of it has an earlier item that is open or first, and a member if some
    key has an earlier first article. Settled members leave the keys. A round is two groupings with partial aggregates, so a
    key that all titles have costs one row per task; rounds end when nothing is open, after as many as the longest chain of
    items that wait for each other. A title of n tokens that others have too has n^3 / 6 keys at most. Titles without a token are clusters of their own.
    """
    rows = cut(articles.select(F.col(order).alias("seq"), F.sort_array(title_tokens(F.coalesce("title", F.lit("")))).alias("tokens")), "news-tokens")
    items = cut(rows.filter(F.size("tokens") > 0).groupBy("tokens").agg(F.min("seq").alias("item")), "news-items")
    spread = items.select("item", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    common = spread.groupBy("t").agg(F.count("*").alias("items")).filter("items > 1")
    kept = spread.join(common, "t").groupBy("item", "n").agg(F.sort_array(F.collect_list("t")).alias("tokens"))
    need = F.when(F.col("n") >= 5, 3).when(F.col("n") >= 3, 2).otherwise(1)
    asks = lambda c: kept.filter(need == c).select("item", F.explode(subsets(F.col("tokens"), c)).alias("k"), F.lit(True).alias("asks"))
    gives = lambda c: kept.select("item", F.explode(subsets(F.col("tokens"), c)).alias("k"), F.lit(False).alias("asks"))
    keys = None
    for c in (1, 2, 3):
        some = asks(c).unionByName(gives(c)).groupBy("item", "k").agg(F.max("asks").alias("asks")).withColumn("k", F.concat_ws(":", F.lit(c), "k"))
        keys = some if keys is None else keys.unionByName(some)
    met = keys.groupBy("k").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).filter("n > 1 and asked").select("k")
    keys = cut(keys.join(met, "k"), "news-keys")  # those that two items have, one of which asks
    first = keys.select("item").distinct().select("item", F.lit(None).cast("boolean").alias("head"))
    state = cut(first, "news-state")
    while True:
        holders = keys.join(state.filter("head is null or head"), "item")
        least = holders.groupBy("k").agg(F.min(F.when(F.col("head"), F.col("item"))).alias("head_at"), F.min(F.when(F.col("head").isNull(), F.col("item"))).alias("open_at"))
        opened = state.filter("head is null")
        seen = keys.filter("asks").join(opened.select("item"), "item").join(least, "k").groupBy("item").agg(F.min("head_at").alias("head_at"), F.min("open_at").alias("open_at"))
        decided = F.when(F.col("head_at") < F.col("item"), F.lit(False)).when(F.coalesce(F.col("open_at") >= F.col("item"), F.lit(True)), F.lit(True))
        told = opened.select("item").join(seen, "item", "left").select("item", decided.alias("head"))
        state = cut(state.filter("head is not null").unionByName(told), "news-state")
        if not state.filter("head is null").limit(1).count():
            break
    heads = keys.join(state.filter("head"), "item").groupBy("k").agg(F.min("item").alias("head_at"))
    joined = keys.filter("asks").join(state.filter("not head").select("item"), "item").join(heads, "k").groupBy("item").agg(F.min("head_at").alias("joined"))
    named = items.join(joined, "item", "left").select("tokens", F.coalesce("joined", "item").alias("cluster"))
    return rows.filter(F.size("tokens") > 0).join(named, "tokens").select(F.col("seq").alias(order), "cluster").unionByName(rows.filter(F.size("tokens") == 0).select(F.col("seq").alias(order), F.col("seq").alias("cluster")))


def in_order(value: Column, place: Column) -> Column:
    """Distinct values by first place (for small groups of them: one row each)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), value.alias("v")))), lambda x: x["v"])


def news_events(articles: DataFrame, as_of: str, order: str = "seq") -> DataFrame:
    """One row per event: title, summary, entities, date, sources, sentiment, impact, freshness, confidence.

    articles: order, title, summary, url, date (text), entities. Title and date are the first article's; the summary is the
    longest (the first among equals), and the first article's title where there is none. Sources and entities are distinct, in order of
    appearance; an event's list is as long as its sources. Nulls count as empty.
    """
    text = lambda x: F.trim(F.coalesce(x, F.lit("")))
    rows = articles.select(F.col(order).alias("seq"), text("title").alias("title"), text("summary").alias("summary"), F.coalesce("url", F.lit("")).alias("url"), "date", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))
    rows = cut(rows.join(cluster_news(articles, order).select(F.col(order).alias("seq"), "cluster"), "seq"), "news-rows")
    own = F.when((F.col("summary") == "") & (F.col("seq") == F.col("cluster")), F.col("title")).otherwise(F.col("summary"))
    events = rows.withColumn("summary", own).groupBy("cluster").agg(
        F.min_by("title", "seq").alias("head_title"), F.min_by("date", "seq").alias("date"), F.min_by("summary", F.struct(-F.length("summary"), "seq")).alias("summary"), F.count("*").alias("articles"),
    )
    urls = rows.filter("url <> ''").groupBy("cluster", "url").agg(F.min("seq").alias("at")).groupBy("cluster").agg(in_order(F.col("url"), F.col("at")).alias("sources"))
    named = rows.select("cluster", "seq", F.posexplode("entities").alias("pos", "entity")).groupBy("cluster", "entity").agg(F.min(F.struct("seq", "pos")).alias("at")).groupBy("cluster").agg(in_order(F.col("entity"), F.col("at")).alias("entities"))
    out = events.join(urls, "cluster", "left").join(named, "cluster", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"sources": F.coalesce("sources", none), "entities": F.coalesce("entities", none), "title": F.when(F.col("head_title") == "", F.lit(UNTITLED)).otherwise(F.col("head_title"))})
    full = F.lower(F.concat_ws(" ", "title", "summary"))
    hits = lambda words: sum((F.contains(full, F.lit(w)).cast("int") for w in words), F.lit(0))
    mood = F.when(hits(GOOD) > hits(BAD), "positive").when(hits(BAD) > hits(GOOD), "negative").otherwise("neutral")
    high = F.exists(F.array(*map(F.lit, IMPACT)), lambda w: F.contains(full, w))
    moment = F.coalesce(*[F.try_to_timestamp(F.trim("date"), F.lit(p)) for p in DATES])
    out = out.withColumns({"sentiment": mood, "impact": F.when(high, "high").when(F.size("sources") >= 2, "medium").otherwise("low"), "moment": moment, "confidence": F.round(F.least(F.lit(1.0), 0.7 + 0.1 * F.size("sources")), 2)})
    out = freshness_rating(out, "moment", "market_news", as_of).withColumnRenamed("rating", "freshness")
    return out.select("cluster", "title", "summary", "entities", "date", "sources", "sentiment", "impact", "freshness", "confidence", "articles")
