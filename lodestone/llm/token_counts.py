"""Operator 13: token counts by a compiled finite-state tokenizer.

Two deterministic transducers in a row count the tokens of byte-level BPE without forming them. The first reads the classes
of code points and marks where a pre-token begins. The second reads bytes and resets at marks; its transitions carry the
number of tokens that the byte adds to the encoding of the pre-token's prefix (negative where tokens merge). Its states are
exact: a state holds the longest suffix that begins some vocabulary entry and, for every suffix that does, the last token
before it and how many tokens come before it. The encoding of a longer prefix ends with the one entry whose pair with the
token before is stable under the merge rules, so these facts determine all that follows. Transitions are compiled into a
dense table when they are first taken; a table that has grown to its limit is started afresh.

Texts are read in chunks side by side. A chunk's map takes any state to a count and an exit state; behind the chunk's first
mark it is constant. A prefix scan composes the maps: the running maximum of the constant ones names, for every chunk, the
map whose exit state its leading bytes continue, so these bytes are read once, from that state, again side by side. Prefix
sums of the counts give each text's tokens.

Defined cases: a null text is empty and has no token; a special string inside a text is one token, as is the library's
default; repeated rows are counted each by itself; an empty table gives an empty result; columns named like the results
are replaced, all others are kept. Texts of any length work; one text is never cut between tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodestone.llm.bpe import byte_alphabet
from lodestone.llm.common import slices

SPACE, LETTER, NUMBER, OTHER = range(4)
# What the pre-tokenizer takes after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
STATES = 1 << 19  # states of a worker's table before it starts afresh: some 300 MB
BITS = 22
SLOTS = 1 << BITS  # of the transitions' table, about three for a state at most
MIX = -7046029254386353131  # an odd number near 2^64 divided by the golden ratio, as a signed one
NEVER = 1 << 40  # no rank
CHUNK = 1 << 9  # bytes
BLOCK = 1 << 13  # chunks read side by side


def classes_of(content: str) -> np.ndarray:
    """Class of every code point, as the library's pre-tokenizer itself joins it to a neighbour of known class.

    Blocks that join as a whole to a letter or a sign are settled at once, the others by code point.
    """
    cut = Tokenizer.from_str(content).pre_tokenizer
    joins = (("!", OTHER), ("x", LETTER), ("1", NUMBER))
    found, mixed = np.full(0x110000, SPACE, dtype=np.uint8), []
    for low in range(0, 0x110000, 256):
        if 0xD800 <= low < 0xE000:
            continue
        block = "".join(map(chr, range(low, low + 256)))
        kind = next((kind for neighbour, kind in joins if len(cut.pre_tokenize_str(neighbour + block)) == 1), None)
        if kind is None:
            mixed.append(np.arange(low, low + 256))
        else:
            found[low : low + 256] = kind
    for some in mixed:
        for neighbour, kind in joins:
            starts = [span[0] for _, span in cut.pre_tokenize_str("".join(neighbour + chr(c) for c in some))]
            found[np.delete(some, [s // 2 for s in starts if s % 2])] = kind
    return found


def pretoken_marks(points: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point. first: whether a text begins there."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=bool)
    kind = classes[points]
    before, blank = np.roll(kind, 1), kind == SPACE
    ends = np.append(first[1:], True)
    solid_next = ~ends & ~np.append(blank[1:], True)
    after_space = ~first & (np.roll(points, 1) == 0x20)
    # words, numbers and signs: at a change of class, unless one space leads them; white space: at its first and, before something, its last
    marks = np.where(blank, first | (before != SPACE) | solid_next, ~after_space & (first | (before != kind)))
    marks[first] = True
    at = np.flatnonzero((points == 0x27) & marks & ~ends)
    if len(at):
        padded = np.append(points, [0, 0])
        stop = np.append(ends, [True, True])
        for tail in CONTRACTIONS:
            hit = at[padded[at + 1] == ord(tail[0])]
            if len(tail) == 2:
                hit = hit[~stop[hit + 1]]
                hit = hit[padded[hit + 2] == ord(tail[1])]
            marks[hit + 1] = False
            rest = hit + 1 + len(tail)
            marks[rest[rest < n]] = True
    return marks


class CountTransducer:
    """Byte transducer of a byte-level BPE file: state, byte -> state, tokens added."""

    def __init__(self, content: str):
        model = json.loads(content)["model"]
        of = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes_of = {i: bytes(of[c] for c in s) for s, i in model["vocab"].items() if all(c in of for c in s)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank and parts of the rule that makes it
        for rank, pair in enumerate(model["merges"]):
            left, right = (model["vocab"][x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[left, right] = rank
            self.made.setdefault(self.id_of[self.bytes_of[left] + self.bytes_of[right]], (rank, left, right))
        self.children: list[dict[int, int]] = [{}]  # trie of the vocabulary
        self.entry = [-1]
        for data, i in self.id_of.items():
            node = 0
            for b in data:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.entry)
                    self.children.append({})
                    self.entry.append(-1)
                node = self.children[node][b]
            self.entry[node] = i
        self.stable: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self, keep: list[int] = ()) -> list[int]:
        """An empty table; the new numbers of the states to keep."""
        held = [self.facts[x] for x in keep]
        self.key = np.full(SLOTS, -1, dtype=np.int64)  # state << 8 | byte, open addressing
        self.value = np.zeros(SLOTS, dtype=np.int64)  # state << 8 | tokens added + 128
        self.number: dict[tuple, int] = {}
        self.facts: list[tuple] = []
        self.start = self.numbered(((0, -1, 0),))
        return [self.numbered(f) for f in held]

    def numbered(self, facts: tuple) -> int:
        found = self.number.get(facts)
        if found is None:
            found = self.number[facts] = len(self.facts)
            self.facts.append(facts)
        return found

    def encoded(self, data: bytes) -> list[int]:
        """Ids by the merge rules: least rank first, leftmost among equals."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while True:
            ranked = [(self.rank[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in self.rank]
            if not ranked:
                return ids
            i = min(ranked)[1]
            ids[i : i + 2] = [self.id_of[self.bytes_of[ids[i]] + self.bytes_of[ids[i + 1]]]]

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at that end of a token while it is made, byte first, each with the rank that ends it."""
        out, ends = [], NEVER
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out[::-1]
            ends, token = self.made[token][0], self.made[token][side]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merge rules leave the two tokens as they are (left -1: none).

        Both are made by their own rules unless one joins the pieces at the border first: at each moment these are the last
        of the left's pieces and the first of the right's.
        """
        if left < 0:
            if (left, right) not in self.stable:
                self.stable[left, right] = self.encoded(self.bytes_of[right]) == [right]
            return self.stable[left, right]
        found = self.stable.get((left, right))
        if found is None:
            found = self.fits(-1, left) and self.fits(-1, right)
            a, b = self.spine(left, 2), self.spine(right, 1)
            i = j = 0
            while found and (i < len(a) and j < len(b)):
                joins = self.rank.get((a[i][0], b[j][0]), NEVER)
                if joins < a[i][1] and joins <= b[j][1] and joins < NEVER:
                    found = False
                elif a[i][1] <= b[j][1]:
                    i += 1
                else:
                    j += 1
            self.stable[left, right] = found
        return found

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the table, or the free place where it belongs."""
        at = (keys * MIX >> (64 - BITS)) & (SLOTS - 1)
        off = np.flatnonzero((self.key[at] != keys) & (self.key[at] >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (SLOTS - 1)
            held = self.key[at[off]]
            off = off[(held != keys[off]) & (held >= 0)]
        return at

    def compile(self, keys: list[int]) -> None:
        """Fills transitions. Facts of a state: for each suffix that begins an entry, longest first: trie node, last token before it, tokens before it less those of the prefix."""
        for key in keys:
            last = count = None
            going = []
            byte = key & 255
            for node, token, n in self.facts[key >> 8]:
                child = self.children[node].get(byte)
                if child is None:
                    continue
                if last is None and self.entry[child] >= 0 and self.fits(token, self.entry[child]):
                    last, count = self.entry[child], n + 1
                if self.children[child]:
                    going.append((child, token, n))
            to = self.numbered((*[(node, token, n - count) for node, token, n in going], (0, last, 0)))
            at = (key * MIX >> (64 - BITS)) & (SLOTS - 1)
            while self.key[at] >= 0:
                at = (at + 1) & (SLOTS - 1)
            self.key[at], self.value[at] = key, to << 8 | count + 128

    def run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads data[begin:end] for each item from its state; counts of tokens added, and exit states. data: byte, plus 256 at a mark."""
        order = np.argsort(begin - end, kind="stable")  # longest first: the ones still read are a prefix
        at, length, s = begin[order], (end - begin)[order], state[order].astype(np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        living = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left").tolist()  # of length > step
        for step, live in enumerate(living):
            byte = data[at[:live] + step].astype(np.int64)
            key = np.where(byte >= 256, self.start << 8, s[:live] << 8) | byte & 255
            found = self.slots(key)
            new = self.key[found] < 0
            if new.any():
                if len(self.facts) > STATES:
                    s[:live] = key >> 8
                    s = np.array(self.restart(s.tolist()), dtype=np.int64)
                    key = s[:live] << 8 | byte & 255
                    new = np.ones(live, dtype=bool)
                self.compile(np.unique(key[new]).tolist())
                found = self.slots(key)
            value = self.value[found]
            total[:live] += (value & 255) - 128
            s[:live] = value >> 8
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return total[back], s[back]

    def maps(self, data: np.ndarray, marked: np.ndarray, begin: np.ndarray, end: np.ndarray, state: int) -> tuple[np.ndarray, int, int]:
        """Composes the maps of neighbouring chunks: counts by chunk, the count of the bytes that continue the given state, the exit state.

        What continues a constant map counts for its chunk, up to the next one's first mark.
        """
        sync = np.append(marked, len(data))[np.searchsorted(marked, begin)]
        constant = sync < end
        total, exits = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), self.start)
        held = self.facts[state]
        total[constant], exits[constant] = self.run(data, sync[constant], end[constant], np.full(int(constant.sum()), self.start))
        source = np.maximum.accumulate(np.where(constant, np.arange(len(begin)), -1))  # the scan
        heads = np.concatenate(([-1], np.flatnonzero(constant)))
        leads = np.append(sync[constant], end[-1])  # where each continuation stops
        froms = np.concatenate(([begin[0]], end[constant]))
        states = np.concatenate(([self.numbered(held)], exits[constant]))
        more, exits = self.run(data, froms, leads, states)
        total[heads[1:]] += more[1:]
        return total, int(more[0]), int(exits[np.searchsorted(heads, source[-1])])

    def counts(self, data: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens between each start (of a text in data; marked unless the text is empty) and the next one."""
        n = len(data)
        begin = np.unique(np.concatenate([np.arange(0, n, CHUNK), starts[starts < n]]))  # a chunk is of one text
        end = np.append(begin[1:], n)
        total, state, marked = np.zeros(len(begin), dtype=np.int64), self.start, np.flatnonzero(marks)
        data = data + (marks.astype(np.uint16) << 8)
        for k in range(0, len(begin), BLOCK):
            some = slice(k, k + BLOCK)
            total[some], before, state = self.maps(data, marked, begin[some], end[some], state)
            total[k] += before  # of the text that the block's first chunk continues
        running = np.concatenate(([0], np.cumsum(total)))
        bounds = np.searchsorted(begin, np.append(starts, n))
        return running[bounds[1:]] - running[bounds[:-1]]


class Counter:
    """Token counts of texts by one tokenizer file."""

    def __init__(self, content: str, classes: np.ndarray):
        spec = json.loads(content)
        self.classes, self.bytes = classes, CountTransducer(content)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """Special strings are a token each and part the text around them."""
        pieces, owner = [], []
        total = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            parts = self.special.split(t) if self.special else [t]
            total[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        whole = "".join(pieces)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        data = np.frombuffer(whole.encode(), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(p) for p in pieces])[:-1])).astype(np.int64)
        first = np.zeros(len(points), dtype=bool)
        first[at[at < len(points)]] = True
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte place of each code point
        marks = np.zeros(len(data), dtype=bool)
        marks[lead[:-1][pretoken_marks(points, self.classes, first)]] = True
        np.add.at(total, owner, self.bytes.counts(data, marks, lead[at]))
        return total


_LOADED: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than limit tokens).

    The file and the table of classes (1.1 MB) go to the executors as broadcast variables; both have a fixed size.
    """
    content = Path(tokenizer_path).read_text(encoding="utf-8")
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((content, classes_of(content)))
    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = sent.value[0]
        if name not in _LOADED:
            _LOADED[name] = Counter(*sent.value)
        for part in slices(batches, text):
            raw = [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
            found = _LOADED[name].counts([t.decode("utf-8", "replace") for t in raw])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(t) for t in raw], pa.int64()), pa.array(found)], names=[*part.schema.names, "n_bytes", "n_tokens"])

    return kept.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op13(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return token_counts(docs.select("doc_id", "text"), tokenizer_path).select("doc_id", "n_bytes", "n_tokens", "over_limit")
