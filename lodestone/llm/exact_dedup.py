"""Operator 2: exact dedup by an extendible-hash index on shared files.

Texts are equal when identical after runs of ASCII white space became one space. The key of a text is the XXH64 of its
normal form. The directory maps the key's leading bits to buckets: it starts with one bucket, splits every bucket that
holds more than its capacity by one more bit, and doubles when a bucket needs more bits than the directory has. It is
built from counts by prefix (2**16 numbers at most). Map tasks merge the copies they see, rows go to the task that owns
their bucket, a range of keys, and that task chains the texts of a key and compares their bytes. The index is a table in
the shared folder; documents then look their entry up by key and digest.

Defined cases: a null text counts as empty; a null doc_id sorts after all others; repeated rows count in group_size
and are kept only once by id (kept is true for every row that has the smallest doc_id); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import join_skewed, slices, stored, whole_text

PREFIX_BITS = 16
#: Runs of ASCII white space other than a single space, which needs no change.
NOT_ONE_SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: Bytes of distinct texts that a map task holds while it merges copies.
HELD = 16 << 20
NO_ID = (1 << 63) - 1


def directory(counts: dict[int, int], capacity: int, bits: int = PREFIX_BITS) -> tuple[int, list[int]]:
    """Global depth and the bucket of each slot, from the number of rows by the key's leading bits."""
    sums = [[0] * (1 << depth) for depth in range(bits + 1)]
    for prefix, n in counts.items():
        for depth in range(bits + 1):
            sums[depth][prefix >> (bits - depth)] += n
    depth, slots, local, used = 0, [0], [0], [0]  # one bucket; by bucket its depth and its leading bits
    at = 0
    while at < len(local):
        if local[at] < bits and sums[local[at]][used[at]] > capacity:
            if local[at] == depth:  # the directory doubles
                slots = [b for b in slots for _ in (0, 1)]
                depth += 1
            local[at] += 1
            used[at] *= 2
            local.append(local[at])
            used.append(used[at] + 1)
            width = 1 << (depth - local[at])
            for slot in range(used[-1] * width, (used[-1] + 1) * width):
                slots[slot] = len(local) - 1
        else:
            at += 1
    return depth, slots


def merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: one row for each distinct text seen, with its smallest doc_id and count; bounded by HELD."""
    seen: dict[bytes, list] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        batch = pa.RecordBatch.from_pydict({"bucket": pa.array([v[0] for v in seen.values()], pa.int32()), "key": pa.array([v[1] for v in seen.values()], pa.int64()), "norm": pa.array(list(seen), pa.binary()), "keep_id": pa.array([v[2] for v in seen.values()], pa.int64()), "n": pa.array([v[3] for v in seen.values()], pa.int64())})
        yield from slices([batch], "norm")

    for part in slices(batches, "norm"):
        for bucket, key, norm, doc in zip(*(part.column(c).to_pylist() for c in ("bucket", "key", "norm", "doc_id"))):
            entry = seen.get(norm)
            if entry is None:
                seen[norm] = [bucket, key, doc, 1]
                held += len(norm)
            else:
                entry[2] = min(entry[2], doc)
                entry[3] += 1
        if held > HELD:
            yield from rows()
            seen, held = {}, 0
    if seen:
        yield from rows()


def own_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner side, rows sorted by bucket and key: chains the texts of a key and compares their bytes."""
    import hashlib

    at, chain, done = None, [], []

    def close() -> None:
        for place, (norm, keep, n) in enumerate(chain):
            done.append((*at, place, hashlib.sha256(norm).digest(), keep, n))

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["bucket", "key", "chain", "sha", "keep_id", "group_size"])

    for part in slices(batches, "norm"):
        for bucket, key, norm, keep, n in zip(*(part.column(c).to_pylist() for c in ("bucket", "key", "norm", "keep_id", "n"))):
            if at != (bucket, key):
                if at:
                    close()
                at, chain = (bucket, key), []
            for entry in chain:
                if entry[0] == norm:
                    entry[1] = min(entry[1], keep)
                    entry[2] += n
                    break
            else:
                chain.append([norm, keep, n])
        yield rows()
        done = []
    if at:
        close()
        yield rows()


def build_index(docs: DataFrame, keys: DataFrame, capacity: int) -> DataFrame:
    """The stored index over docs (doc_id, key, norm): bucket, key, chain, sha, keep_id, group_size."""
    spark = docs.sparkSession
    prefix = F.shiftrightunsigned("key", 64 - PREFIX_BITS).cast("int")
    counts = {r[0]: r[1] for r in keys.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}  # 2**16 rows at most
    depth, slots = directory(counts, capacity)
    table = spark.createDataFrame(list(enumerate(slots)), "slot int, bucket int")  # 2**16 rows at most
    slot = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
    placed = docs.withColumn("slot", slot).join(F.broadcast(table), "slot").select("bucket", "key", F.col("norm").cast("binary").alias("norm"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
    merged = placed.mapInArrow(merge_copies, "bucket int, key long, norm binary, keep_id long, n long")
    owned = merged.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(own_buckets, "bucket int, key long, chain int, sha binary, keep_id long, group_size long")
    return stored(owned, "hash-index")


def exact_groups(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, sha (of the normal form)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(whole_text(), NOT_ONE_SPACE, " ").alias("norm")).withColumn("key", F.xxhash64("norm"))
    keys = stored(rows.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "hash-keys")
    total = keys.count()
    index = build_index(rows, keys, capacity or max(512, total >> 13))
    found = join_skewed(keys, index.drop("bucket", "chain"), ["key", "sha"], "group_size", total)
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "sha")


def op2(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))
