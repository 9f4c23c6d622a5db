"""Technical indicators over price series, candidate scores, streaks and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(bars: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Adds i (from 1) and n (bars of the symbol)."""
    own = Window.partitionBy(symbol)
    return bars.withColumns({"i": F.row_number().over(own.orderBy(ts)), "n": F.count("*").over(own)})


def seeded_average(value: Column, i: Column, n: Column, seed: int, keep: float) -> Column:
    """Last value of the recursion a = keep * a + (1 - keep) * x that starts at the mean of the first seed values.

    Written out, each value has a fixed weight, so one aggregate per series is enough.
    """
    weight = F.when(i <= seed, F.pow(F.lit(keep), n - seed) / seed).otherwise((1 - keep) * F.pow(F.lit(keep), n - i))
    return F.when(F.max(n) >= seed, F.sum(value * weight))


def sma(bars: DataFrame, n: int) -> DataFrame:
    """Rolling mean of n closes; null where fewer have been seen."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - n, 0)
    return bars.withColumn("sma", F.when(F.count("close").over(w) == n, F.avg("close").over(w)))


def ema(bars: DataFrame, n: int) -> DataFrame:
    return numbered(bars).groupBy("symbol").agg(seeded_average(F.col("close"), F.col("i"), F.col("n"), n, 1 - 2 / (n + 1)).alias("ema"))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index; 100 where nothing was lost."""
    w = Window.partitionBy("symbol").orderBy("ts")
    moved = numbered(bars).withColumn("d", F.col("close") - F.lag("close").over(w)).filter("i > 1")
    i, m, keep = F.col("i") - 1, F.col("n") - 1, (n - 1) / n
    out = moved.groupBy("symbol").agg(seeded_average(F.greatest("d", F.lit(0.0)), i, m, n, keep).alias("gain"), seeded_average(F.greatest(-F.col("d"), F.lit(0.0)), i, m, n, keep).alias("loss"))
    return out.select("symbol", F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss"))).alias("rsi"))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts")
    last = F.lag("close").over(w)
    ranged = numbered(bars).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))).filter("i > 1")
    return ranged.groupBy("symbol").agg(seeded_average(F.col("tr"), F.col("i") - 1, F.col("n") - 1, n, (n - 1) / n).alias("atr"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Line, signal and histogram of each series (nulls where it has under slow + signal closes).

    Line and signal are written out as fixed weights of the closes, as in seeded_average(): the line is the difference of two
    averages, and its own average is a geometric sum of them. A close of age a (0 for the last) counts in an average of n with
    keep k as (1 - k) k^a behind its seed and k^(ends - n) / n inside; summing that over the ages of the signal's steps has a closed form,
    so one aggregate per series is enough and series spread over tasks by partial sums.
    """
    i, n = F.col("i"), F.col("n")
    k = (signal - 1) / (signal + 1)
    start = slow + signal - 1  # the close whose line value ends the signal's seed

    def geometric(ratio: float, count: Column) -> Column:
        return count.cast("double") if abs(1 - ratio) < 1e-12 else (1 - F.pow(F.lit(ratio), count)) / (1 - ratio)

    def weight(size: int) -> tuple[Column, Column]:
        """Of a close in the last average, and in the signal's mix of the averages at closes slow..n."""
        keep = (size - 1) / (size + 1)
        share = F.when(i <= size, F.lit(1.0 / size)).otherwise(F.lit(1 - keep))  # times keep ** (t - max(i, size)) in the average at close t
        first = F.greatest(i, F.lit(size))
        last = share * F.pow(F.lit(keep), n - first)
        # seed of the signal: the mean of the averages at slow..start; behind it (1 - k) * k ** (n - t) each, and the seed times k ** (n - start)
        from_t = F.greatest(first, F.lit(slow))
        seeded = F.when(from_t <= start, F.pow(F.lit(keep), from_t - first) * geometric(keep, start - from_t + 1)).otherwise(0.0) * F.pow(F.lit(k), n - start) / signal
        later = F.greatest(first, F.lit(start + 1))
        behind = F.when(later <= n, (1 - k) * F.pow(F.lit(keep), later - first) * F.pow(F.lit(k), n - later) * geometric(keep / k, n - later + 1)).otherwise(0.0)
        return last, share * (seeded + behind)

    (fast_last, fast_mix), (slow_last, slow_mix) = weight(fast), weight(slow)
    enough = n >= slow + signal
    total = lambda w: F.sum(F.when(enough, F.col("close") * w))
    out = numbered(bars).groupBy("symbol").agg(total(fast_last - slow_last).alias("line"), total(fast_mix - slow_mix).alias("signal"))
    return out.withColumn("histogram", F.col("line") - F.col("signal"))


def volume_ratio(bars: DataFrame) -> DataFrame:
    """Last volume over the mean volume."""
    out = bars.groupBy("symbol").agg(F.max_by("volume", "ts").alias("last"), F.avg("volume").alias("mean"))
    return out.select("symbol", F.when(F.col("mean") > 0, F.col("last") / F.col("mean")).alias("ratio"))


def weekly_return(bars: DataFrame) -> DataFrame:
    """Last close against the close four bars before (the first one of a shorter series), in percent."""
    named = numbered(bars)
    back = F.max(F.when(F.col("i") == F.greatest(F.col("n") - 4, F.lit(1)), F.col("close")))
    out = named.groupBy("symbol").agg(F.max(F.when(F.col("i") == F.col("n"), F.col("close"))).alias("last"), back.alias("before"), F.max("n").alias("n"))
    return out.select("symbol", F.when((F.col("n") > 1) & (F.col("before") != 0), (F.col("last") / F.col("before") - 1) * 100).alias("change"))


def low_yield_streak(rows: DataFrame, run: str, order: str, low: Column, limit: int = 5) -> DataFrame:
    """Length of the running streak of low rows at each row, and whether it reached the limit."""
    w = Window.partitionBy(run).orderBy(order)
    marked = rows.withColumn("low", low).withColumn("island", F.sum((~F.col("low")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("low").cast("int")).over(Window.partitionBy(run, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", streak.cast("long")).withColumn("alert", F.col("streak") >= limit).drop("island")


def latest_state(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def search_yield(rows: DataFrame, group: list[str], hits: str, new: str) -> DataFrame:
    out = rows.groupBy(*group).agg(F.sum(hits).alias("hits"), F.sum(new).alias("new"))
    return out.withColumn("yield", F.when(F.col("hits") > 0, F.bround(F.col("new") / F.col("hits"), 3)).otherwise(0.0))


def productivity_columns(unique: Column, qualified: Column, duplicate: Column, rejected: Column, verified: Column) -> dict[str, Column]:
    one = lambda x: F.greatest(x, F.lit(1))
    good, dup, bad = qualified / one(unique), duplicate / one(unique + duplicate), rejected / one(verified + rejected)
    base = F.when(qualified > 0, 1 + 2 * good).when((duplicate > 0) & (unique == 0), 0.05).when((rejected > 0) | (duplicate > 0), 0.20).otherwise(1.0)
    return {"qualified_yield": good, "duplicate_rate": dup, "rejection_rate": bad, "productivity": F.greatest(base - 0.4 * dup - 0.3 * bad, F.lit(0.05))}


def source_productivity(events: DataFrame, source: str = "source", kind: str = "event_type", kinds: dict[str, str] | None = None) -> DataFrame:
    """Per source: sums by outcome, rates and a score that rewards qualified rows and punishes duplicates and rejections."""
    names = kinds or {"unique": "view", "qualified": "purchase", "duplicate": "click", "rejected": "error", "verified": "signup"}
    out = events.groupBy(F.lower(F.trim(source)).alias("source")).agg(*[F.count_if(F.col(kind) == v).alias(k) for k, v in names.items()])
    return out.withColumns(productivity_columns(*[F.col(k) for k in ("unique", "qualified", "duplicate", "rejected", "verified")]))


def source_health(calls: DataFrame) -> DataFrame:
    """Per source: calls, results, error classes and mean latency."""
    text = F.lower(F.coalesce("error", F.lit("")))
    kind = F.when(text == "", "ok").when(text.rlike("timeout|timed out"), "timeout").when(text.rlike("403|blocked|denied"), "blocked").when(text.rlike("429|rate"), "rate_limited").otherwise("error")
    out = calls.withColumn("kind", kind).groupBy("source").agg(F.count("*").alias("queries"), F.sum("results").alias("results"), F.count_if(F.col("kind") != "ok").alias("errors"), F.sort_array(F.collect_set(F.when(F.col("kind") != "ok", F.col("kind")))).alias("kinds"), F.avg("latency").alias("latency"))
    return out.withColumn("state", F.when(F.col("errors") == 0, "healthy").when(F.col("errors") < F.col("queries"), "degraded").otherwise("failing"))


def prioritize(tasks: DataFrame, productivity: DataFrame) -> DataFrame:
    """Tasks by priority, the more productive source first (1.0 where unknown)."""
    joined = tasks.join(productivity.select("source", "productivity"), "source", "left").fillna({"productivity": 1.0})
    return joined.orderBy("priority", F.desc("productivity"), "seq")


def dedupe_tasks(tasks: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in tasks.columns if c not in keys]
    return tasks.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def crawl_telemetry(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Counts by window, source and event type."""
    return events.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "source", "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "source", "event_type", "events")


def snapshot_changes(rows: DataFrame, target: str, ts: str, state: str, price: str, least: float = 0.001) -> DataFrame:
    """Rows whose state differs from the snapshot before, or whose price differs by more than least (an amount, not a share)."""
    w = Window.partitionBy(target).orderBy(ts)
    told = rows.withColumns({"old_state": F.lag(state).over(w), "old_price": F.lag(price).over(w)}).filter("old_state is not null")
    change = F.when(F.col(state) != F.col("old_state"), "status").when(F.abs(F.col(price) - F.col("old_price")) > least, "price")
    return told.withColumn("change", change).filter("change is not null")


def new_headlines(rows: DataFrame, target: str, order: str, news: str) -> DataFrame:
    """target, order, headline: the headlines (array column news) that the snapshot before did not have."""
    before = F.coalesce(F.lag(news).over(Window.partitionBy(target).orderBy(order)), F.array().cast("array<string>"))
    first = F.row_number().over(Window.partitionBy(target).orderBy(order)) == 1
    told = rows.withColumns({"__before": before, "__first": first}).filter(~F.col("__first"))
    return told.select(target, order, F.explode(F.array_except(news, "__before")).alias("headline"))


def score_candidates(cands: DataFrame, evidence: DataFrame) -> DataFrame:
    """Eight components, total, confidence and direction. Evidence is aggregated per symbol before the join.

    cands: symbol, sector, change_1w, volume_ratio, rsi, price, sma20, histogram, revenue_growth, profit_growth, pe_ratio and,
    where there are any, the arrays risk_factors, conflicts, corporate_actions and news_events.
    evidence: symbol, tier, sentiment, claim_type, claim, is_counter, source, is_placeholder (placeholders don't count as risk).
    """
    said = lambda *words: F.bool_or(F.lower("claim").rlike("|".join(words)))
    real = ~F.col("is_placeholder")
    told = evidence.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_if(F.col("tier") == 1).alias("t1"), F.count_if(F.col("tier") == 2).alias("t2"),
        F.count_if((F.col("sentiment") == "bullish") & F.col("claim_type").isin("COMPANY_FACT", "NEWS")).alias("good"), F.count_if(((F.col("sentiment") == "bearish") | F.col("is_counter")) & real).alias("bad"),
        said("momentum", "gain").alias("of_momentum"), said("volume", "breakout").alias("of_volume"), said("breakout", "support").alias("of_level"), said("sector").alias("of_sector"),
    )
    j = cands.join(told, "symbol", "left").fillna(0, ["n", "sources", "t1", "t2", "good", "bad"])
    c = F.col
    claimed = lambda flag, value, other=0.0: F.when(c(flag), value).otherwise(other)
    length = lambda name: F.coalesce(F.array_size(name), F.lit(0)) if name in cands.columns else F.lit(0)
    move, vol, r = c("change_1w"), c("volume_ratio"), c("rsi")
    momentum = F.when(move.isNull(), claimed("of_momentum", 10.0)).when(move.between(1, 8), 16 + F.least(F.lit(4.0), (move - 1) / 7 * 4)).when((move > 8) & (move <= 15), 15.0).when(move > 15, 10.0).when(move >= 0, 8.0).when(move >= -3, 4.0).otherwise(0.0)
    volume = F.when(vol.isNull(), claimed("of_volume", 7.0)).when(vol >= 2, 15.0).when(vol >= 1.5, 12.0).when(vol >= 1.1, 8.0).when(vol >= 0.8, 5.0).otherwise(2.0)
    strength = F.when(r.isNull(), 0.0).when(r.between(50, 68), 10.0).when((r >= 40) & (r < 50), 6.0).when((r > 68) & (r <= 75), 5.0).otherwise(2.0)
    known = F.coalesce(c("price") != 0, F.lit(False)) & F.coalesce(c("sma20") != 0, F.lit(False))
    technical = F.least(F.lit(20.0), strength + F.when(~known, claimed("of_level", 6.0)).when(c("price") > c("sma20"), 7.0).otherwise(1.0) + F.when(c("histogram") > 0, 3.0).otherwise(0.0))
    sector = F.when(F.coalesce(c("sector"), F.lit("")) == "", claimed("of_sector", 8.0, 4.0)).when(F.lower("sector").rlike("it|bank|auto|metal|energy|pharma"), 12.0).otherwise(8.0)
    growth = lambda x, up: F.when(c(x) > 15, up).when(c(x) < 0, -2.0).otherwise(0.0)
    fundamentals = F.greatest(F.lit(0.0), F.least(F.lit(10.0), 5 + growth("revenue_growth", 3.0) + growth("profit_growth", 2.0) + F.when(c("pe_ratio").between(10, 40), 1.0).otherwise(0.0)))
    events = length("corporate_actions") * 5.0 + length("news_events") * 3.0
    catalyst = F.least(F.lit(15.0), F.when(events > 0, events).otherwise(c("good") * 4.0))
    risk = F.least(F.lit(20.0), length("risk_factors") * 4.0 + c("bad") * 3.0 + length("conflicts") * 5.0)
    quality = F.least(F.lit(5.0), F.when(c("t1") > 0, 2.5).otherwise(0.0) + F.when(c("t2") >= 2, 2.0).when(c("t2") == 1, 1.0).otherwise(0.0) + F.when(c("sources") >= 3, 0.5).otherwise(0.0))
    out = j.withColumns({"momentum": momentum, "volume_score": volume, "technical": technical, "sector_strength": sector, "catalyst": catalyst, "fundamentals": fundamentals, "risk": risk, "evidence_quality": quality, "in_conflict": length("conflicts") > 0})
    total = c("momentum") + c("volume_score") + c("technical") + c("sector_strength") + c("catalyst") + c("fundamentals") - c("risk") + c("evidence_quality")
    out = out.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(total, 1))), "confidence": F.when(((c("t1") > 0) | (c("t2") >= 2)) & (c("sources") >= 3) & (c("n") >= 3), "HIGH").when((c("sources") >= 2) & (c("n") >= 2), "MEDIUM").otherwise("LOW")})
    direction = F.when(c("n") < 2, "INSUFFICIENT_EVIDENCE").when(c("risk") >= 16, "HIGH_RISK").when((c("risk") >= 12) | c("in_conflict"), "MIXED").when((c("score") >= 65) & c("confidence").isin("HIGH", "MEDIUM"), "POSITIVE").when(c("score") < 40, "NEGATIVE").otherwise("MIXED")
    out = out.withColumn("direction", direction)
    return out.withColumns({x: F.bround(x, 1) for x in ("momentum", "volume_score", "technical", "sector_strength", "catalyst", "fundamentals", "evidence_quality")})


def rank_candidates(scored: DataFrame) -> DataFrame:
    bonus = F.when(F.col("confidence") == "HIGH", 10).when(F.col("confidence") == "MEDIUM", 5).otherwise(0)
    return scored.withColumn("rank_score", F.col("score") + bonus).orderBy(F.desc("rank_score"), "symbol")


def watchlist_split(scored: DataFrame, n: int) -> DataFrame:
    """watch: qualified rows, or the best n if none qualifies."""
    fit = F.col("confidence").isin("HIGH", "MEDIUM") | (F.col("score") >= 45)
    any_fit = scored.agg(F.max(fit.cast("int")).alias("any_fit"))
    best = scored.orderBy(F.desc("score"), "symbol").limit(n).select("symbol", F.lit(True).alias("best"))
    return scored.crossJoin(F.broadcast(any_fit)).join(F.broadcast(best), "symbol", "left").withColumn("watch", F.when(F.col("any_fit") == 1, fit).otherwise(F.coalesce("best", F.lit(False)))).drop("any_fit", "best")


def coverage_verdict(scored: DataFrame, requested: int) -> DataFrame:
    """Why a scan may stop: counts of candidates, by confidence, and of sectors, and the verdict."""
    of = lambda level: F.count_if(F.col("confidence") == level)
    out = scored.agg(F.count("*").alias("candidates"), of("HIGH").alias("high"), of("MEDIUM").alias("medium"), F.count_distinct("sector").alias("sectors"))
    c = F.col
    fit, enough = c("high") + c("medium"), c("candidates") >= requested
    verdict = F.when((fit >= requested) & (c("sectors") >= 3), "REQUEST_SATISFIED").when(enough & (c("high") >= max(1, requested // 3)), "SUFFICIENT_EVIDENCE").when(enough & (fit > 0), "DIMINISHING_EVIDENCE_YIELD").when((c("candidates") > 0) & (c("sectors") >= 4), "DIMINISHING_CANDIDATE_YIELD")
    return out.withColumn("verdict", verdict.otherwise("SUFFICIENT_EVIDENCE"))
