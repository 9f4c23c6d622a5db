"""Operator 3: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / quality; ordering a source's documents by the key is a weighted random
order without replacement. A source whose target is e whole times its size and a remainder gives every document e times
(complete epochs first), then the documents with the smallest keys until their sizes, summed in key order, reach the
remainder. The document that crosses it is left out; if one of those left out fits what is missing better than nothing,
the best one is taken. u comes from a hash of doc_id and text, so reruns agree.

No source is ordered as a whole: keys fall into ranges, the sizes of the ranges (a bounded number for each source) give
the one range in which the remainder ends, and only that range is ordered.

Defined cases: null and empty texts have size 0 and are taken 0 times their words; a null source is a source of its own,
after all others; repeated rows are documents of their own, and each counts alone (equal keys are parted by doc_id, text
and row number); an empty table gives an empty result; other columns are kept, those named like the results are replaced.
The table of sources (one row each) is what is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, stored, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
RANGES = 4096


def quality_weight(text: Column) -> Column:
    """0.25 to 1: the share of letters among the characters that are neither space nor letter-like marks."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!?0123456789", ""))
    return 0.25 + 0.75 * F.greatest(F.lit(0.0), 1 - 10.0 * symbols / F.greatest(F.length(text), F.lit(1)))


def exponential_key(seed: int, *parts: Column) -> Column:
    """-ln(u) with u in (0, 1) from a hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return -F.log(u)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from one row per source.

    Water filling: with sources by cap / weight ascending, the first k are capped; k is the largest number for which the
    level of what is left does not fall below the caps of the sources before.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("i", (F.row_number().over(order) - 1) % len(weights)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("i") + 1).cast("double"))
    caps = weighted.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("at", F.col("cap") / F.col("w"))
    by_cap = Window.orderBy("at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    told = caps.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "rn": F.row_number().over(by_cap), "left_w": F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)), "budget": share * F.sum("source_size").over(whole)})
    told = told.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left_w"))
    # Below the true level every source is capped; from the first uncapped one on, its level holds for all the rest.
    told = told.withColumn("open", F.col("level") <= F.col("at"))
    level = F.min(F.when(F.col("open"), F.struct("rn", "level"))).over(whole)["level"]
    return told.withColumn("final", level).select("source", "source_size", F.when(F.col("open"), F.coalesce(F.col("final"), F.col("level")) * F.col("w")).otherwise(F.col("cap")).alias("target"))


def mixed_rows(docs: DataFrame, columns: list[str], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 3) -> DataFrame:
    """d (the row's columns, as a struct), size, source_size, target, times (how often the mix has the row).

    Rows stay where they are: they are stored with a number each, and a plan of one row per source says up to which row,
    in key order, an extra copy is taken and which row closes the gap.
    """
    text = whole_text()
    key = (exponential_key(seed, F.col("doc_id"), text) / quality_weight(text)).alias("key")
    place = F.struct(key, F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("row"))
    range_ = F.floor(F.col("m.place.key") / (F.col("m.place.key") + 1) * RANGES).cast("int")
    drawn = docs.select(F.struct(*columns).alias("d"), F.struct(F.col("source").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), place.alias("place")).alias("m"))
    stored_rows = stored(drawn, "mix-rows")
    rows = stored_rows.select("m.source", "m.size", "m.place", range_.alias("range"))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    named = targets.withColumnRenamed("source", "s")
    placed = ranges.join(named, F.col("source").eqNullSafe(F.col("s"))).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    placed = placed.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("end", F.sum("n").over(upto))
    plan = stored(placed.groupBy(F.col("source").alias("s")).agg(*[F.first(c).alias(c) for c in ("source_size", "target", "epochs", "rest")], F.min(F.when(F.col("end") > F.col("rest"), F.struct("range", (F.col("end") - F.col("n")).alias("done")))).alias("cut")), "mix-plan")
    same_source = F.col("source").eqNullSafe(F.col("s"))
    # the rows of the range in which the remainder ends, in key order: the last one that fits
    in_cut = rows.join(plan.select("s", "cut", "rest"), same_source & (F.col("range") == F.col("cut.range")))
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = in_cut.withColumn("sum", F.sum("size").over(order) + F.col("cut.done")).filter(F.col("sum") <= F.col("rest"))
    last = summed.groupBy(F.col("source").alias("l")).agg(F.max("place").alias("last"), F.max("sum").alias("filled"))
    settled = plan.join(last, F.col("s").eqNullSafe(F.col("l")), "left").drop("l").withColumn("missing", F.col("rest") - F.coalesce("filled", "cut.done", F.lit(0)))
    settled = stored(settled, "mix-settled")
    # a row behind the cut is left out; where no range is cut, the remainder takes every row
    extra = F.when(F.col("cut").isNull() | (F.col("range") < F.col("cut.range")), True).when(F.col("range") > F.col("cut.range"), False).otherwise(F.coalesce(F.col("place") <= F.col("last"), F.lit(False)))
    # What is still missing in each source goes to the one left-out row that comes nearest to it.
    off = F.abs(F.col("size") - F.col("missing"))
    spare = rows.join(settled, same_source).filter(~extra & (F.col("size") > 0) & (off < F.col("missing")))
    best = spare.groupBy(F.col("source").alias("b")).agg(F.min(F.struct(off.alias("off"), F.col("place").alias("place")))["place"]["row"].alias("closing"))
    final = settled.join(best, F.col("s").eqNullSafe(F.col("b")), "left").drop("b")
    told = stored_rows.withColumns({"source": F.col("m.source"), "size": F.col("m.size"), "place": F.col("m.place"), "range": range_}).join(final, same_source)
    times = F.col("epochs") + extra.cast("long") + F.coalesce(F.col("place.row") == F.col("closing"), F.lit(False)).cast("long")
    return told.select("d", "size", F.col("source_size").cast("long").alias("source_size"), "target", times.alias("times"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """docs (doc_id, text, source and any others) with size, source_size, target and times."""
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "times")]
    return mixed_rows(docs, kept, **settings).select("d.*", "size", "source_size", "target", "times")


def op3(docs: DataFrame) -> DataFrame:
    return mixed_rows(docs, ["doc_id"]).select("d.doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))
