"""Operator 9: token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is: length (unsigned 64-bit), masked crc32 of those 8 bytes, payload, masked crc32 of the payload, all
little-endian. A payload is one byte that gives the width of an id (2 or 4) and then the ids. A shard file holds the
records of one range of doc_id in ascending order; the index, a Parquet table, has one row per record: shard, path,
offset, frame length, first token within the shard, token count. Readers fetch any record by its index row, so shuffled
reads need no scan. A retried task writes a file of its own; the index names only files of tasks that succeeded.

Defined cases: a null text counts as empty and gives a record with the end id alone; a null doc_id sorts first; repeated
doc_ids keep one record each, ordered by text; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import CACHED_WORDS, WordCache
from lodestone.llm.common import as_bytes, scratch_path, slices, stored

MASK_ADD = 0xA282EAD8  # fixed value: the public record format's mask
SHARD_BYTES = 24 << 20
#: Latin-1 letters: one pre-token that normalizing changes in case alone.
LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(ids: np.ndarray, width: int) -> bytes:
    payload = bytes([width]) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(data: bytes) -> np.ndarray:
    """Ids of one record; a wrong length or checksum raises."""
    (n,) = struct.unpack_from("<Q", data)
    payload = data[12 : 12 + n]
    if len(data) != n + 16 or struct.unpack_from("<I", data, 8)[0] != masked(data[:8]) or struct.unpack_from("<I", data, 12 + n)[0] != masked(payload):
        raise ValueError("damaged record")
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct core of a word that a worker's cache lacks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its runs without white space in
    a row. A run of Latin-1 letters with ASCII punctuation behind it is two pre-tokens, which are looked up apart. Cores
    of letters are one pre-token each, so many go to the library in one call and the word ends in its answer part them.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values(), default=0) < 1 << 16 else 4
        end = json.loads(content)["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(end)]] = True
        self.words = WordCache(self.fresh)  # by word; and by core or tail
        self.cores = WordCache(self.fresh)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2" if self.width == 2 else "<u4")

    def fresh(self, word: bytes) -> bytes:
        return self.ids(word.decode("utf-8", "replace")).tobytes()

    def learn(self, cores: list[bytes]) -> None:
        """Puts the ids of plain cores into the cache, a thousand to a call."""
        for at in range(0, len(cores), 1000):
            some = cores[at : at + 1000]
            ids = self.ids(b" ".join(some).decode())
            upto = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(upto) != len(some):
                raise ValueError("a word without an end, or with several")
            data, begin = ids.tobytes(), 0
            for core, end in zip(some, upto):
                self.cores.put(core, data[begin:end])
                begin = end

    def encode_words(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words. Latin-1 letters with punctuation behind them are looked up by their lower-case core and tail."""
        core = pc.utf8_rtrim(words, characters=string.punctuation)
        plain = pc.match_substring_regex(core, LETTERS)
        keys = as_bytes(pc.if_else(plain, pc.utf8_lower(core), words))
        cut = pc.if_else(plain, pc.binary_length(core.cast(pa.large_binary())), pc.binary_length(words.cast(pa.large_binary()))).to_numpy().tolist()
        cores, easy = self.cores, plain.to_numpy(zero_copy_only=False).tolist()
        fresh = {k for k, p in zip(keys, easy) if p and len(k) <= 64 and k not in cores and k not in cores.old}
        if len(fresh) < CACHED_WORDS:
            self.learn(list(fresh))
        return [cores[k] if len(w) == n else cores[k] + cores[w[n:]] for w, k, n in zip(as_bytes(words), keys, cut)]

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text: words are parted and told apart by Arrow, so only distinct ones become Python objects."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = lists.values.dictionary_encode()
        distinct, cache = as_bytes(coded.dictionary), self.words
        found = [cache.get(w) or cache.old.get(w) for w in distinct]
        new = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(new, self.encode_words(coded.dictionary.take(pa.array(new, pa.int64())))):
            found[i] = ids
            cache.put(distinct[i], ids)
        ids = np.frombuffer(b"".join(found), "<u2" if self.width == 2 else "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        word = coded.indices.to_numpy()
        n = sizes[word]
        upto = np.append(0, np.cumsum(n))
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[word] - upto[:-1], n) + np.arange(upto[-1])]
        edges = upto[lists.offsets.to_numpy()]
        return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


_LOADED: dict[str, LibraryEncoder] = {}


def encoder(content: str) -> LibraryEncoder:
    """One encoder per worker and file."""
    if content not in _LOADED:
        _LOADED[content] = LibraryEncoder(content)
    return _LOADED[content]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


INDEX = "shard int, path string, doc_id long, offset long, frame_bytes long, first long, n_tokens long"


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards under folder and returns the stored index."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.records"
        codec, at, first, out = encoder(content.value), 0, 0, None
        end = np.array([end_id])
        for part in slices(batches, "text"):
            if out is None:
                store, place = opened(path)
                store.create_dir(os.path.dirname(place), recursive=True)
                out = store.open_output_stream(place)
            index = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), codec.encode_many(part.column("text"))):
                data = frame(np.concatenate((ids, end)), codec.width)
                out.write(data)
                index.append((shard, path, doc, at, len(data), first, len(ids) + 1))
                at += len(data)
                first += len(ids) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "path", "doc_id", "offset", "frame_bytes", "first", "n_tokens"])
        if out is not None:
            out.close()

    index = rows.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, INDEX)
    return stored(index, "token-index")


def with_start(index: DataFrame) -> DataFrame:
    """Adds start: tokens before the record over all shards. Only shard totals (one row a shard) are ordered as a whole."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    return index.join(before, "shard").withColumn("start", (F.coalesce("before", F.lit(0)) + F.col("first")).cast("long")).drop("before")


def read_records(index: DataFrame) -> DataFrame:
    """Reads the records that the index rows name, in any order or subset, and adds ids (binary, unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for batch in batches:
            ids, held, begun = [], 0, 0
            rows = zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("frame_bytes").to_pylist())
            for i, (p, offset, n) in enumerate(rows):
                if p != path:
                    if file:
                        file.close()
                    store, place = opened(p)
                    path, file = p, store.open_input_file(place)
                ids.append(unframed(file.read_at(n, offset)).tobytes())
                held += len(ids[-1])
                if held > 8 << 20 or i == batch.num_rows - 1:
                    part = batch.slice(begun, len(ids))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, "ids"])
                    ids, held, begun = [], 0, i + 1
        if file:
            file.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields) + ", ids binary"
    return index.mapInArrow(run, schema)


def op9(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = docs.sparkSession
    index = with_start(write_records(docs, tokenizer_path, scratch_path(spark, "token-records")))
    shuffled = index.repartition("shard").sortWithinPartitions("shard", "offset")
    return read_records(shuffled).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
