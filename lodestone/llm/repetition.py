"""Operator 4: quality rules with suffix-array repetition.

The words of each text are numbered and their suffixes ranked by prefix doubling (only suffixes whose rank is still
shared take part in the next round). The ranks of all rounds give the longest common prefix of neighbours in the suffix
array; every neighbour pair at least MIN_REPEAT words long ends an interval of a maximal repeated substring. The union of
the spans of those substrings gives the covered share of words, the largest prefix gives the longest repeat.

Verdict: a text is rejected when its repeats of MIN_REPEAT words or more cover more than MAX_COVERED of its words, or
when its longest repeat exceeds MAX_LONGEST words, or when the base rules fail.

Defined cases: a null text counts as empty, has no words and fails; repeated rows are judged each by itself; an empty
table gives an empty result; other columns are kept, those named like results are replaced. Texts of any length work:
memory follows a few MB of texts, or the longest single one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import slices

MIN_WORDS = 20
BASE_WINDOW = 8
BASE_PERCENT = 30
MIN_REPEAT = 5
MAX_COVERED = 0.30
MAX_LONGEST = 200
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


class Numbers(dict):
    """Numbers words as they come, from start on."""

    def __init__(self, start: int):
        super().__init__()
        self.start = start

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.start + len(self)
        return n


def shared_prefixes(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix positions in suffix-array order, as far as their first word repeats, and the common prefix with the one before.

    first: word numbers, different in different texts, with a number of its own after each text.
    """
    n = len(first)
    rank = first.astype(np.int64)
    ranks = [rank]
    h = 1
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, dtype=bool)
    same = rank[order][1:] == rank[order][:-1]
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    active = np.flatnonzero(shared)
    whole = active
    while len(active):
        follow = active + h
        key = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.lexsort((key, rank[active]))
        at, k, r = active[by], key[by], rank[active][by]
        start = np.ones(len(at), dtype=bool)
        start[1:] = r[1:] != r[:-1]  # a new group of the round before
        part = start.copy()
        part[1:] |= k[1:] != k[:-1]
        place = np.arange(len(at))
        inside = place - np.maximum.accumulate(np.where(start, place, 0))
        begun = np.maximum.accumulate(np.where(part, place, 0))
        rank = rank.copy()
        rank[at] = r + inside[begun]
        ranks.append(rank)
        size = np.diff(np.append(np.flatnonzero(part), len(at)))
        active = at[np.repeat(size > 1, size)]
        h *= 2
    if not len(whole):
        return whole, whole
    sa = whole[np.argsort(rank[whole], kind="stable")]
    lcp = np.zeros(len(sa), dtype=np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    got = np.zeros(len(a), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        hit = np.zeros(len(a), dtype=bool)
        hit[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
        step = 1 << level
        got[hit] += step
        a[hit] += step
        b[hit] += step
    lcp[1:] = got
    return sa, lcp


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in some [start, start + length)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:-1]) > 0


def judge(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of repetition() for some texts, from one suffix array over all of them."""
    parts, bounds, at, number = [], [0], 0, 0
    chars, symbols, dup_lines = [], [], []
    for text in texts:
        words = text.split()
        numbers = Numbers(number)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        number += len(numbers)
        parts.append(np.array([number]))  # ends the text
        number += 1
        at += len(words) + 1
        bounds.append(at)
        solid = text.translate(None, SPACES)
        raw = np.frombuffer(solid, np.uint8)
        chars.append(int(np.count_nonzero((raw & 0xC0) != 0x80)))
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
        dup_lines.append(len(lines) - len(set(lines)))
    first = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    # ranks must leave room below for the groups of later rounds: number words by their place in sorted order
    order = np.argsort(first, kind="stable")
    begun = np.ones(len(first), dtype=bool)
    begun[1:] = first[order][1:] != first[order][:-1]
    rank = np.empty(len(first), np.int64)
    rank[order] = np.maximum.accumulate(np.where(begun, np.arange(len(first)), 0))
    sa, lcp = shared_prefixes(rank)
    most = lcp.copy()
    if len(sa):
        most[:-1] = np.maximum(most[:-1], lcp[1:])
    edges = np.array(bounds)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[edges]) if len(flags) else np.zeros(len(texts), np.int64)

    long8, long5 = most >= BASE_WINDOW, most >= MIN_REPEAT
    base = per_text(covered(len(first), sa[long8], np.full(long8.sum(), BASE_WINDOW)))
    repeats = per_text(covered(len(first), sa[long5], most[long5]))
    longest = np.zeros(len(texts), np.int64)
    if len(sa):
        np.maximum.at(longest, np.searchsorted(edges, sa, side="right") - 1, most)
    words = np.diff(edges) - 1
    failed = (words < MIN_WORDS) | (100 * base > BASE_PERCENT * words)
    good = ~failed & (repeats <= MAX_COVERED * words) & (longest <= MAX_LONGEST)
    return {"n_words": words, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": base, "base_failed": failed, "kept": good, "covered_words": repeats, "longest_repeat": longest}


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of RESULTS."""
    kept = docs.drop(*RESULTS)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.BooleanType() if c in ("base_failed", "kept") else T.LongType()) for c in RESULTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = judge([t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c]) for c in RESULTS)], names=[*part.schema.names, *RESULTS])

    return kept.mapInArrow(run, schema)


def op4(docs: DataFrame) -> DataFrame:
    return repetition(docs.select("doc_id", "text")).drop("text")
