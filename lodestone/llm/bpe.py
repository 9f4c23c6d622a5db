"""Operator 1: byte-level BPE with word ends, encoding and decoding.

A word's symbols form a doubly linked list. A heap holds the rank and place of every adjacent pair that some merge
rule joins; the least rank is taken first (leftmost among equals), and an entry whose pair has changed meanwhile is
stale and skipped. Decoding joins the vocabulary strings of the ids by one space, as a tokenizer file without a
decoder asks for.

Defined cases: a null text counts as empty and gives no ids and an empty decoded text; repeated rows are encoded each
by itself; an empty table gives an empty result; columns named like the results are replaced, all others are kept.
Texts of any length work: memory holds a few MB of texts at a time plus bounded word caches.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodestone.llm.common import slices

# The public byte-to-character alphabet's printable ranges.
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
# Fixed value: Unicode White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words in each of the two generations of a Python worker's cache; results do not depend on it.
CACHED_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """Character for each byte: printable ones stand for themselves, the others for code points from 256 on."""
    shown = {b for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordCache(dict):
    """Results by word. When a generation is full it becomes the old one; words found there are carried over."""

    def __init__(self, make, cached: int = CACHED_WORDS):
        super().__init__()
        self.make, self.cached, self.old = make, cached, {}

    def put(self, word: bytes, value: bytes) -> None:
        if len(self) >= self.cached:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = value

    def __missing__(self, word: bytes) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.put(word, value)
        return value


class WordBpe:
    """Encoder and decoder over the content of a tokenizers JSON file of the word-end BPE kind."""

    def __init__(self, content: str, cached: int = CACHED_WORDS):
        spec = json.loads(content)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = dict((i, s) for s, i in self.vocab.items()) | {i: s for s, i in self.special.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[self.vocab[left] << 32 | self.vocab[right]] = (rank, self.vocab[left + right])
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.end] for c in alphabet]
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = tuple(s.encode()[:2] for s in self.special)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        library = Tokenizer.from_str(content)
        self.normal, self.cut = library.normalizer, library.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.pieces: dict[bytes, bytes] = {}
        self.cached, self.words = cached, WordCache(self.fresh, cached)

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        n = len(ids)
        if n == 1:
            return ids
        merge = self.merge
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := merge.get(ids[i] << 32 | ids[i + 1]):
                heap.append(found[0] << 32 | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = merge.get(ids[i] << 32 | ids[j])
            if found is None or found[0] != entry >> 32:
                continue  # stale
            ids[i] = found[1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merge.get(ids[i] << 32 | ids[k]):
                    push(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0 and (found := merge.get(ids[h] << 32 | ids[i])):
                push(heap, found[0] << 32 | h)
        return [x for x in ids if x >= 0]

    def pieces_of(self, part: str) -> list[bytes]:
        """Pre-tokens. Beyond ASCII the file's own normalizer and splitter decide, so their Unicode tables hold, whatever Python's are."""
        if part.isascii():
            return [piece.encode() for piece in self.piece.findall(part.lower())]
        return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(part))]

    def fresh(self, word: bytes) -> bytes:
        """Ids of a run without ASCII white space, as little-endian unsigned 32-bit integers."""
        text = word.decode("utf-8", "replace")
        parts = self.cut_special.split(text) if self.cut_special and any(m in word for m in self.marks) else (text,)
        out: list[bytes] = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for piece in self.pieces_of(part):
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = np.array(self.merged(piece), "<u4").tobytes()
                    if len(self.pieces) >= self.cached:
                        self.pieces.clear()
                    if len(piece) <= 64:
                        self.pieces[word if piece == word else piece] = ids  # a word that is one piece is held once
                out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """White space is a starter for NFC and never part of a pre-token, so words are encoded one by one."""
        return b"".join(map(self.words.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[tuple[str, int], WordBpe] = {}


def loaded(content: str, cached: int = CACHED_WORDS) -> WordBpe:
    """One encoder per worker, file and size of its cache."""
    if (content, cached) not in _LOADED:
        _LOADED[content, cached] = WordBpe(content, cached)
    return _LOADED[content, cached]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text", cached: int = CACHED_WORDS) -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit) and decoded (string), decoded from those ids.

    The vocabulary file (a fixed size, 1.7 MB) goes to the executors as a broadcast variable, so its path needs to
    exist on the driver alone. cached: words in a generation of a worker's cache; fewer cost time and save memory.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    kept = docs.drop("ids", "decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(content.value, cached)
        for part in slices(batches, text):
            ids = [codec.encode(t or b"") for t in part.column(text).cast(pa.binary()).to_pylist()]
            decoded = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*part.schema.names, "ids", "decoded"])

    return kept.mapInArrow(run, schema)


def ids_as_array(ids: str = "ids") -> Column:
    """The ids as array<long>, for users who want numbers."""
    digits = F.hex(ids)
    places = F.sequence(F.lit(0), F.greatest(F.length(ids) / 4 - 1, F.lit(0)).cast("int"))
    four = F.transform(places, lambda i: F.conv(F.concat(*[F.substring(digits, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long"))
    return F.when(F.length(ids) == 0, F.array().cast("array<long>")).otherwise(four)


def op1(docs: DataFrame, tokenizer_path: str, cached: int = CACHED_WORDS) -> DataFrame:
    done = bpe_round_trip(docs.select("doc_id", "text"), tokenizer_path, cached=cached)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
