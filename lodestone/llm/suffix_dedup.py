"""Operator 5: suffix-array dedup of byte strings.

A byte goes when a 50-byte string that covers it also starts in a document with a smaller doc_id. Three passes over packs
of documents (some MB of text each, stored compressed in the shared folder, so that later passes read what the first saw):

1. Filter. The least hash of a 24-byte gram within each 50-byte string is a sampled fingerprint: equal strings have equal
   fingerprints. Packs send their distinct fingerprints (one for about 14 bytes) to buckets, which answer with those that
   another document has. A suffix whose head has a fingerprint seen once can't repeat and takes no further part.
2. Suffix array. The other suffixes are range-partitioned by their leading bytes with splitters from a bounded sample;
   each bucket sorts its suffixes by leading bytes and then by the fingerprint of the whole 50-byte head (a multikey
   sort with 8-byte characters) and compares neighbours. Equal heads have equal keys, so none straddles a boundary. A
   pack merges its equal heads first (smallest doc_id), so a hot passage costs one entry per pack. The answer is a bit
   for each entry: does a smaller doc_id have this head.
3. Cut. Each pack marks the bytes under removable heads and builds what is left.

Copies of a whole text are found by text hash beforehand; only the first takes part, as it has the smallest doc_id.
Heads are equal when 7 leading bytes and 56 bits of their hash agree (with the hash spread over all 50 bytes).

Defined cases: a null text counts as empty; texts under 50 bytes are kept whole; a null doc_id sorts after all others
and null ids don't remove each other's bytes, nor do rows with the same doc_id; an empty table gives an empty result;
other columns are ignored. Texts longer than a pack make a pack of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import join_skewed, scratch_path, stored
from lodestone.plans.components import shuffles_dropped

LENGTH = 50
GRAM = 24
PACK_BYTES = 6 << 20
CHUNK_BYTES = 1 << 20
BUCKET_ENTRIES = 1 << 20
SAMPLE = 1 << 14  # suffixes from which splitters are taken
SAMPLED_PACKS = 24
LAST_ID = (1 << 63) - 1

C1, C2, C3, C4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= C2
    x ^= x >> np.uint64(27)
    x *= C3
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each place on, for the places that have them: 8, 16 and then 16 and 8 bytes."""
    with np.errstate(over="ignore"):
        h, factor = BYTE[data], C1
        for width in (1, 2, 4):
            h = h[:-width] * factor + h[width:]
            factor = factor * factor
        eight = h
        h = h[:-8] * factor + h[8:]
        return mix(h[:-8] * factor + eight[16:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


class Heads:
    """Places of the suffixes of at least 50 bytes within some texts, their fingerprints and keys."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        n = len(self.data) - LENGTH + 1
        if n <= 0:
            self.at = self.doc = np.zeros(0, np.int64)
            self.mark = np.zeros(0, np.uint64)
            return
        self.gram = gram_hashes(self.data)
        least = sliding_min(self.gram, LENGTH - GRAM + 1)
        own = np.zeros(n + 1, np.int32)  # +1 where a text's heads begin, -1 behind its last one
        long = lengths >= LENGTH
        np.add.at(own, (ends - lengths)[long], 1)
        np.add.at(own, (ends - LENGTH + 1)[long], -1)
        self.at = np.flatnonzero(np.cumsum(own[:-1]) > 0)
        self.mark = least[self.at]
        self.ends = ends

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seven leading bytes and a hash byte, and 48 further bits of the hash."""
        with np.errstate(over="ignore"):
            g = self.gram
            h = mix(g[at] * C1 + g[at + GRAM] * C3 + g[at + LENGTH - GRAM] * C4)
        lead = np.zeros(len(at), np.uint64)
        for i in range(7):
            lead = lead << np.uint64(8) | self.data[at + i]
        return lead << np.uint64(8) | h >> np.uint64(56), h & np.uint64((1 << 48) - 1)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, byte planes apart, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return [np.ascontiguousarray(c.T).reshape(-1).view("<u8") for c in planes.reshape(-1, 8, n)] if n else []


def bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), count=n).astype(bool)


PACKS = "pack long, ids array<long>, sizes array<long>, hashes array<long>, body binary"


def pack_documents(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Stored table of packs: doc ids, text lengths and hashes, and the texts in one compressed body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, texts, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            row = {"pack": [part << 32 | made], "ids": [ids], "sizes": [[len(t) for t in texts]], "hashes": [[xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts]], "body": [body]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("body", pa.binary())]))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                text = text.as_py() or b""
                if held and held + len(text) > pack_bytes:
                    yield close()
                    made, texts, ids, held = made + 1, [], [], 0
                texts.append(text)
                ids.append(LAST_ID if doc is None else doc)
                held += len(text)
        if ids:
            yield close()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKS), "packs")


def read_answers(folder: str, pack: int) -> dict[int, bytes]:
    """Answers for one pack, by bucket, from the shared folder."""
    store, path = pafs.FileSystem.from_uri(folder)
    place = f"{path}/pack={pack}"
    if store.get_file_info(place).type == pafs.FileType.NotFound:
        return {}
    table = pads.dataset(place, filesystem=store, format="parquet").to_table(columns=["bucket", "bits"])
    return dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))


def write_answers(answers: DataFrame, name: str) -> str:
    folder = scratch_path(answers.sparkSession, name)
    with shuffles_dropped(answers.sparkSession):
        answers.repartition("pack").write.partitionBy("pack").parquet(folder)
    return folder


def texts_of(row: dict, copies: set[int]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Chunks of a pack: places of its documents that are no copies, and their texts."""
    body, at, places, texts, held = zstandard.ZstdDecompressor().decompress(row["body"]) if row["body"] else b"", 0, [], [], 0
    for i, n in enumerate(row["sizes"]):
        if i not in copies:
            places.append(i)
            texts.append(body[at : at + n])
            held += n
            if held >= CHUNK_BYTES:
                yield np.array(places), texts
                places, texts, held = [], [], 0
        at += n
    if places:
        yield np.array(places), texts


def of_buckets(n: int, keys: np.ndarray, splitters: np.ndarray | None) -> np.ndarray:
    """Bucket of each key: by splitters, or evenly by the leading bits."""
    if splitters is not None:
        return np.searchsorted(splitters, keys, side="right")
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Pack:
    """One pack with what has been answered about it so far; every pass rebuilds the same entries from the stored text."""

    def __init__(self, row: dict, plan: dict):
        self.row, self.plan = row, plan
        self.copies = copies = set()
        for blob in read_answers(plan["copies"], row["pack"]).values():
            copies.update(np.frombuffer(blob, "<i4").tolist())
        self.ids = np.array(row["ids"], np.int64)

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints and whether two documents of this pack have it."""
        seen, docs = [], []
        for places, texts in texts_of(self.row, self.copies):
            heads = Heads(texts)
            new = np.ones(len(heads.mark), bool)
            new[1:] = (heads.mark[1:] != heads.mark[:-1]) | (heads.at[1:] != heads.at[:-1] + 1)  # heads of two documents never adjoin
            seen.append(mix(heads.mark[new] + C4))
            docs.append(places[heads.docs(heads.at[new])] if new.any() else np.zeros(0, np.int64))
        mark, doc = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (seen, docs))
        order = np.argsort(mark, kind="stable")
        mark, doc = mark[order], doc[order]
        start = np.ones(len(mark), bool)
        start[1:] = mark[1:] != mark[:-1]
        group = np.cumsum(start) - 1
        several = np.zeros(int(start.sum()), bool)
        differ = ~start
        differ[1:] &= doc[1:] != doc[:-1]
        several[group[differ]] = True
        return mark[start], several

    def repeated_marks(self) -> np.ndarray:
        """The fingerprints, as sent, that another document has; sorted."""
        found = [unpacked(blob[4:], int.from_bytes(blob[:4], "little"))[0] for blob in read_answers(self.plan["marks"], self.row["pack"]).values()]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def candidates(self) -> Iterator[tuple[np.ndarray, list[bytes], Heads, np.ndarray]]:
        """By chunk: places, texts, heads and the places of the heads whose fingerprint repeats."""
        repeated = self.repeated_marks()
        for places, texts in texts_of(self.row, self.copies):
            heads = Heads(texts)
            mark = sent(mix(heads.mark + C4))
            found = np.searchsorted(repeated, mark)
            hit = np.zeros(len(mark), bool)
            inside = found < len(repeated)
            hit[inside] = repeated[found[inside]] == mark[inside]
            yield places, texts, heads, heads.at[hit]

    def entries(self, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct candidate heads of the pack in order, with their smallest doc_id. keep gets what each chunk found."""
        lead, rest, doc = [], [], []
        for places, texts, heads, at in self.candidates():
            a, b = heads.keys(at) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
            own = self.ids[places[heads.docs(at)]] if len(at) else np.zeros(0, np.int64)
            lead.append(a)
            rest.append(b)
            doc.append(own)
            if keep is not None:
                keep.append((places, texts, at, own))
        if not lead:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        lead, rest, doc = np.concatenate(lead), np.concatenate(rest), np.concatenate(doc)
        order = np.lexsort((doc, rest, lead))
        start = np.ones(len(lead), bool)
        start[1:] = (lead[order][1:] != lead[order][:-1]) | (rest[order][1:] != rest[order][:-1])
        if keep is not None:  # the entry of each head, in the order of the chunks
            entry = np.empty(len(order), np.int32)
            entry[order] = np.cumsum(start) - 1
            keep.append(entry)
        first = order[start]
        return lead[first], rest[first], doc[first]


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows (bucket, pack, n, blob), sorted by bucket, as whole buckets."""
    at, rows = None, []
    for batch in batches:
        for bucket, pack, n, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pack", "n", "blob"))):
            if bucket != at and rows:
                yield at, rows
                rows = []
            at = bucket
            rows.append((pack, n, blob))
    if rows:
        yield at, rows


def answer_batch(bucket: int, packs: list[int], sizes: list[int], hit: np.ndarray) -> pa.RecordBatch:
    edges = np.append(0, np.cumsum(sizes))
    said = [(p, bits(hit[a:b])) for p, a, b in zip(packs, edges[:-1], edges[1:]) if hit[a:b].any()]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in said], pa.int64()), pa.array([bucket] * len(said), pa.int32()), pa.array([b for _, b in said], pa.binary())], names=["pack", "bucket", "bits"])


ROWS, ANSWERS = "bucket int, pack long, n int, blob binary", "pack long, bucket int, bits binary"


def bucket_rows(pack: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Entries sorted by bucket as one row for each bucket."""
    begun = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(begun[1:], len(bucket))
    return pa.RecordBatch.from_arrays([pa.array(bucket[begun].astype(np.int32)), pa.array([pack] * len(begun), pa.int64()), pa.array((ends - begun).astype(np.int32)), pa.array([packed(*(c[a:b] for c in columns)) for a, b in zip(begun, ends)], pa.binary())], names=["bucket", "pack", "n", "blob"])


def whole_copies(packs: DataFrame) -> DataFrame:
    """Answers that name the documents of each pack whose whole text a smaller doc_id has."""
    each = packs.select("pack", F.posexplode(F.arrays_zip("ids", "sizes", "hashes")).alias("place", "d")).select("pack", "place", F.col("d.ids").alias("id"), F.col("d.sizes").alias("size"), F.col("d.hashes").alias("hash")).filter(F.col("size") >= LENGTH)
    first = each.groupBy("hash", "size").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    total = packs.agg(F.sum(F.size("ids"))).first()[0] or 0
    later = join_skewed(each, first, ["hash", "size"], "n", total).filter("id > least")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"pack": [key[0].as_py()], "bucket": pa.array([0], pa.int32()), "bits": [rows.column("place").to_numpy().astype("<i4").tobytes()]})

    return later.select("pack", "place").groupBy("pack").applyInArrow(run, ANSWERS)


def splitters_of(spark: SparkSession, packs: DataFrame, plan: dict, n: int) -> np.ndarray:
    """n - 1 keys that cut the suffixes into even ranges, from SAMPLE suffixes of the SAMPLED_PACKS packs of least hash (a bounded sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            for _, _, heads, at in Pack(row, plan).candidates():
                lead, rest = heads.keys(at[:: max(1, len(at) // 256)])
                yield pa.RecordBatch.from_arrays([pa.array(rest.view(np.int64)), pa.array(lead.view(np.int64))], names=["rest", "lead"])

    chosen = [r[0] for r in packs.select("pack").orderBy(F.xxhash64("pack")).limit(SAMPLED_PACKS).collect()]
    rows = packs.filter(F.col("pack").isin(chosen)).mapInArrow(run, "rest long, lead long").orderBy("rest").limit(SAMPLE).collect()
    lead = np.sort(np.array([r[1] for r in rows], np.int64).view(np.uint64))
    return lead[np.linspace(0, len(lead), n + 1)[1:-1].astype(int)] if len(lead) else lead


def sent(mark: np.ndarray) -> np.ndarray:
    """Fingerprints as they go to the buckets: 56 bits."""
    return mark >> np.uint64(8)


def mark_rows(pack: "Pack") -> pa.RecordBatch:
    """A pack's distinct fingerprints by bucket; the lowest bit says that two of its documents have it."""
    mark, several = pack.marks()
    return bucket_rows(pack.row["pack"], of_buckets(pack.plan["mark_buckets"], mark, None), sent(mark) << np.uint64(1) | several)


def count_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers each pack with those of its fingerprints that another document has."""
    for bucket, rows in bucket_groups(batches):
        value = np.concatenate([unpacked(blob, n)[0] for _, n, blob in rows])
        mark, hit = value >> np.uint64(1), (value & np.uint64(1)) > 0
        order = np.argsort(mark)
        same = mark[order][1:] == mark[order][:-1]
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        begin, said = 0, []
        for pack, n, _ in rows:
            found = mark[begin : begin + n][hit[begin : begin + n]]
            begin += n
            if len(found):
                said.append((pack, len(found).to_bytes(4, "little") + packed(found)))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in said], pa.int64()), pa.array([bucket] * len(said), pa.int32()), pa.array([b for _, b in said], pa.binary())], names=["pack", "bucket", "bits"])



def owned(rows: DataFrame, run) -> DataFrame:
    """Answers of the tasks that own the buckets."""
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERS)


def remove_repeats(docs: DataFrame, pack_bytes: int = PACK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) for every document."""
    spark = docs.sparkSession
    packs = pack_documents(docs, pack_bytes)
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    plan = {"copies": write_answers(whole_copies(packs), "copies"), "mark_buckets": max(8, size // 16 // bucket_entries)}

    def send_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            yield mark_rows(Pack(row, plan))

    plan["marks"] = write_answers(owned(packs.mapInArrow(send_marks, ROWS), count_marks), "mark-answers")
    buckets = max(8, size // 6 // bucket_entries)
    splitters = splitters_of(spark, packs, plan, buckets)

    def send_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            lead, rest, doc = Pack(row, plan).entries()
            yield bucket_rows(row["pack"], of_buckets(0, lead, splitters), lead, rest, doc)

    def sort_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in bucket_groups(batches):
            lead, rest, doc = (np.concatenate(c) for c in zip(*(unpacked(blob, n) for _, n, blob in rows)))
            doc = doc.view(np.int64)
            order = np.lexsort((doc, rest, lead))  # leading bytes, then the fingerprint of the head, then the document
            start = np.ones(len(order), bool)
            start[1:] = (lead[order][1:] != lead[order][:-1]) | (rest[order][1:] != rest[order][:-1])
            least = doc[order][np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
            hit = np.zeros(len(order), bool)
            hit[order] = least < doc[order]
            yield answer_batch(bucket, [r[0] for r in rows], [r[1] for r in rows], hit)

    plan["heads"] = write_answers(owned(packs.mapInArrow(send_heads, ROWS), sort_heads), "head-answers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            pack = Pack(row, plan)
            yield from cut_pack(pack, splitters)

    return packs.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_pack(pack: Pack, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    kept: list = []
    lead, _, least = pack.entries(kept)
    bucket = of_buckets(0, lead, splitters)
    earlier = np.zeros(len(lead), bool)
    for b, blob in read_answers(pack.plan["heads"], pack.row["pack"]).items():
        at = np.flatnonzero(bucket == b)
        earlier[at] = flags(blob, len(at))
    out = [(place, pack.row["sizes"][place], pack.row["sizes"][place], 1, b"") for place in sorted(pack.copies)]
    entry, used = kept.pop() if kept else np.zeros(0, np.int32), 0
    for places, texts, at, own in kept:
        i = entry[used : used + len(at)]
        used += len(at)
        edge = np.zeros(sum(map(len, texts)) + 1, np.int32)
        gone = at[earlier[i] | (least[i] < own)]
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + LENGTH, -1)
        removed = np.cumsum(edge[:-1]) > 0
        begin = 0
        for place, text in zip(places.tolist(), texts):
            cover = removed[begin : begin + len(text)]
            begin += len(text)
            n = int(cover.sum())
            spans = int(cover[:1].sum() + np.count_nonzero(cover[1:] & ~cover[:-1])) if n else 0
            out.append((place, len(text), n, spans, np.frombuffer(text, np.uint8)[~cover].tobytes() if n else text))
        yield results(pack, out)
        out = []
    if out:
        yield results(pack, out)


def results(pack: Pack, out: list[tuple]) -> pa.RecordBatch:
    place, n, removed, spans, kept = zip(*out)
    ids = pa.array([None if i == LAST_ID else i for i in pack.ids[list(place)].tolist()], pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def op5(docs: DataFrame) -> DataFrame:
    done = remove_repeats(docs)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
