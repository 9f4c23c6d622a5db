"""Operator 6 [native]: removal of repeated multi-line chunks with content-defined boundaries.

Lines are hashed; a rolling hash over each window of three line hashes decides where a chunk may end, so boundaries
depend on nearby lines alone and resist shifts. Two boundaries in a row are not allowed, and neither is one that would cut
off a single line at either end: every chunk of a text with two lines or more has two lines or more. A stretch without a
boundary, such as a run of equal lines, is cut every MAX_LINES lines from its start. Chunks are counted
by hash; those with a hash seen again are compared byte by byte (grouped by their text), and every occurrence but the
first in (doc_id, chunk) order is removed. Counts are merged map-side, and hot chunks are looked up by broadcast of at
most 1024 entries.

Chunks miss a repeated block unless boundaries fall on its edges. So every pair of neighbouring lines is a smallest block
too, found and compared in the same way: a line also goes when a pair that covers it has an earlier occurrence. All pairs
of a repeated block repeat, so each block of two lines or more goes to its edges. A pair that overlaps its own first
occurrence loses its second line only. dedup_lines() removes chunks alone, dedup_blocks() chunks and blocks.

Defined cases: a null text counts as empty (one empty line); texts with one line have no multi-line chunk and stay as
they are; pairs of blank lines are no blocks; a null doc_id sorts after all others; rows with the same doc_id and text are treated alike; an empty table gives
an empty result; other columns are kept whatever their names; those named like the results are replaced. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import clustered, dropped, join_skewed, stored, whole_text

#: One window of three lines in so many allows a boundary.
MEAN_LINES = 3
MAX_LINES = 64
LAST_ID = (1 << 63) - 1
NOT_BLANK = r"[^\x20\x09-\x0D]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: a lambda's variable is not put back in place by the optimizer."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def with_chunks(df: DataFrame, text: Column, mean: int = MEAN_LINES) -> DataFrame:
    """Adds chunks: array<struct<no, at, n_lines, chunk>>, at: the first line from 0; joined by newlines they give the text. Null texts give null."""

    def cut(lines: Column) -> Column:
        windows = F.greatest(F.size(lines) - 2, F.lit(0))

        def roll(h: Column) -> Column:
            """For each window of three line hashes whether it allows a boundary behind its second line."""
            two = F.zip_with(F.slice(h, 1, windows), F.slice(h, 2, windows), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
            return F.zip_with(two, F.slice(h, 3, windows), lambda p, z: F.pmod(F.xxhash64(p["x"], p["y"], z), F.lit(mean)) == 0)

        rolled = let(F.transform(lines, lambda x: F.xxhash64(x)), roll)

        def starts(ok: Column) -> Column:
            marked = F.transform(ok, lambda yes, k: F.when(yes & (k + 2 <= F.size(lines) - 2) & ~F.coalesce(F.get(ok, k - 1), F.lit(False)), k + 2))
            begin = F.concat(F.array(F.lit(0)), F.filter(marked, lambda i: i.isNotNull()))
            ends = F.concat(F.slice(begin, 2, F.size(begin)), F.array(F.size(lines)))
            # no chunk is longer than MAX_LINES + 1, and none has one line because of that
            return F.flatten(F.zip_with(begin, ends, lambda s, e: F.sequence(s, F.greatest(s, e - 2), F.lit(MAX_LINES))))

        def pieces(begin: Column) -> Column:
            ends = F.concat(F.slice(begin, 2, F.size(begin)), F.array(F.size(lines)))
            return F.zip_with(begin, ends, lambda s, e: F.struct(s.alias("s"), (e - s).alias("n_lines"), F.array_join(F.slice(lines, s + 1, e - s), "\n").alias("chunk")))

        parts = let(let(rolled, starts), pieces)
        return F.transform(parts, lambda p, i: F.struct(i.alias("no"), p["s"].alias("at"), p["n_lines"].alias("n_lines"), p["chunk"].alias("chunk")))

    return df.withColumn("chunks", F.when(text.isNotNull(), let(F.split(text, "\n", -1), cut)))


def own_chunks(docs: DataFrame, mean: int, *more: str) -> DataFrame:
    """The multi-line chunks of documents (__h, __id, text) with their hash."""
    parts = with_chunks(docs, F.col("text"), mean).select("__h", "__id", *more, F.inline("chunks"))
    return parts.filter((F.col("n_lines") > 1) & F.col("chunk").rlike(NOT_BLANK)).withColumn("hash", F.xxhash64("chunk"))


def own_pairs(docs: DataFrame) -> DataFrame:
    """__h, __id, no, hash of each pair of lines no and no + 1 that is not blank."""

    def pairs(lines: Column) -> Column:
        def pair(x: Column, k: Column) -> Column:
            after = F.get(lines, k + 1)
            return F.when((k + 1 < F.size(lines)) & (x.rlike(NOT_BLANK) | after.rlike(NOT_BLANK)), F.struct(k.alias("no"), F.xxhash64(x, after).alias("hash")))

        return F.filter(F.transform(lines, pair), lambda p: p.isNotNull())

    return docs.select("__h", "__id", F.inline(let(F.split("text", "\n", -1), pairs)))


def wanted_pairs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """__h, __id, no, hash, chunk of the pairs whose numbers are in __wanted."""

    def pairs(lines: Column) -> Column:
        return F.transform("__wanted", lambda k: F.struct(k.alias("no"), F.xxhash64(F.get(lines, k), F.get(lines, k + 1)).alias("hash"), F.concat(F.get(lines, k), F.lit("\n"), F.get(lines, k + 1)).alias("chunk")))

    return docs.join(wanted, ["__h", "__id"]).select("__h", "__id", F.inline(let(F.split("text", "\n", -1), pairs)))


def later_places(hashes: DataFrame, name: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored table __h, __id, no, first of the chunks that have an earlier occurrence, by byte comparison. fetch: the chunks in __wanted.

    Texts stay where they are: hashes alone find the chunks that may repeat, and only those are brought together.
    """
    hashes = stored(hashes, f"{name}-hashes")
    total = hashes.count()
    counts = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    wanted = join_skewed(hashes, counts, ["hash"], "n", total).groupBy("__h", "__id").agg(F.collect_set("no").alias("__wanted"))
    again = stored(fetch(wanted).select("__h", "__id", "no", "hash", "chunk"), f"{name}-again")
    # byte comparison: equal hash and equal chunk
    place = F.struct("__id", "__h", "no")
    first = again.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", F.sha2("chunk", 256).alias("digest"), "first", "n")
    seen = again.select("__h", "__id", "no", "hash", F.sha2("chunk", 256).alias("digest"))
    found = stored(join_skewed(seen, first, ["hash", "digest"], "n", total).filter(place != F.col("first")).select("__h", "__id", "no", "first"), f"{name}-later")
    dropped(hashes)
    dropped(again)
    return found


def repeated_chunks(docs: DataFrame, mean: int = MEAN_LINES) -> DataFrame:
    """__h, __id, no: the chunks that go. docs: clustered by __h and __id; __h, __id, text."""

    def fetch(wanted: DataFrame) -> DataFrame:
        return own_chunks(docs.join(wanted, ["__h", "__id"]), mean, "__wanted").filter(F.array_contains("__wanted", F.col("no")))

    return later_places(own_chunks(docs, mean).select("__h", "__id", "no", "hash"), "chunk", fetch).select("__h", "__id", "no")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """__h, __id, line: the lines (from 0) of pairs that have an earlier occurrence, with repeats."""
    later = later_places(own_pairs(docs), "pair", lambda wanted: wanted_pairs(docs, wanted))
    overlaps = (F.col("first.__id") == F.col("__id")) & (F.col("first.__h") == F.col("__h")) & (F.col("first.no") == F.col("no") - 1)
    return later.select("__h", "__id", F.explode(F.when(overlaps, F.array(F.col("no") + 1)).otherwise(F.array(F.col("no"), F.col("no") + 1))).alias("line"))


RESULTS = ("n_lines", "n_removed_lines", "n_removed_chunks")


def keyed(docs: DataFrame) -> DataFrame:
    """d (the row) and the keys __id and __h of its doc_id and whole text, clustered by them."""
    kept = [F.col(c) for c in docs.columns if c not in RESULTS]
    id_ = F.coalesce("doc_id", F.lit(LAST_ID)).cast("long")
    return clustered(docs.select(F.struct(*kept).alias("d"), id_.alias("__id"), F.xxhash64(id_, whole_text()).alias("__h")), "line_documents", "__h", "__id")


def with_results(joined: DataFrame, lost: Column, n_chunks: Column) -> DataFrame:
    """Rows with the lines whose numbers are in lost (null: none) removed. joined: d, text."""

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    done = joined.select("d", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.array_size(lost), F.lit(0)).cast("long").alias("n_removed_lines"), n_chunks.alias("n_removed_chunks"), F.when(lost.isNotNull(), let(F.split("text", "\n", -1), rest)).otherwise(F.col("text")).alias("text"))
    columns = [F.col("text") if c == "text" else F.col("d")[c].alias(c) for c in done.schema["d"].dataType.names]
    return done.select(*columns, *RESULTS)


def removed_chunks(texts: DataFrame, mean: int) -> DataFrame:
    return repeated_chunks(texts, mean).groupBy("__h", "__id").agg(F.collect_set("no").alias("__chunks"))


def lines_of_chunks(joined: DataFrame, mean: int) -> DataFrame:
    """Replaces __chunks by __of_chunks, the lines of those chunks, and n_chunks, their number."""
    cut = with_chunks(joined, F.when(F.col("__chunks").isNotNull(), F.col("text")), mean)
    gone = F.filter("chunks", lambda c: F.array_contains("__chunks", c["no"]))
    return cut.withColumns({"__of_chunks": F.flatten(F.transform(gone, lambda c: F.sequence(c["at"], c["at"] + c["n_lines"] - 1))), "n_chunks": F.coalesce(F.array_size("__chunks"), F.lit(0)).cast("long")})


def dedup_blocks(docs: DataFrame, mean: int = MEAN_LINES) -> DataFrame:
    """docs with text less its repeated chunks and blocks, and n_lines, n_removed_lines, n_removed_chunks (content-defined chunks that repeat)."""
    table = keyed(docs)
    texts = table.select("__h", "__id", whole_text("d.text").alias("text"))
    lines = repeated_lines(texts).groupBy("__h", "__id").agg(F.collect_set("line").alias("__lines"))
    gone = stored(lines.join(removed_chunks(texts, mean), ["__h", "__id"], "full"), "removed-lines")
    joined = table.withColumn("text", whole_text("d.text")).join(gone, ["__h", "__id"], "left")
    none = F.array().cast("array<int>")
    lost = F.when(F.coalesce("__chunks", "__lines").isNotNull(), F.array_union(F.coalesce("__lines", none), F.coalesce("__of_chunks", none)))
    return with_results(lines_of_chunks(joined, mean).withColumn("__lost", lost), F.col("__lost"), F.col("n_chunks"))


def dedup_lines(docs: DataFrame, mean: int = MEAN_LINES) -> DataFrame:
    """docs with text less its repeated chunks, and n_lines, n_removed_lines, n_removed_chunks."""
    table = keyed(docs)
    texts = table.select("__h", "__id", whole_text("d.text").alias("text"))
    removed = stored(removed_chunks(texts, mean), "removed-chunks")
    joined = table.withColumn("text", whole_text("d.text")).join(removed, ["__h", "__id"], "left")
    return with_results(lines_of_chunks(joined, mean), F.col("__of_chunks"), F.col("n_chunks"))


def op6(docs: DataFrame) -> DataFrame:
    done = dedup_blocks(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
