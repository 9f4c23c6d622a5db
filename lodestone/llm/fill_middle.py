"""Operator 12: fill-in-middle transformation with a Roaring-style set of token boundaries.

The ends of a text's tokens are a set of integers, kept like a Roaring bitmap: values with the same upper 16 bits share a
container, which is an array of 16-bit values, a bitmap of 65,536 bits or a list of runs, whichever is smallest. Cumulative
cardinalities over the containers find the container of the i-th boundary by binary search; a select inside it (an array's
entry, a bitmap's word by running popcounts, a run by running lengths) gives its place. The two cuts are two such selects.

Defined cases: a null text is empty; empty texts and those that contain a sentinel stay plain; a null doc_id hashes as an
empty one; repeated rows come out alike; an empty table gives an empty result; columns named like the results are
replaced, all others are kept. Texts of any length work, one at a time beside a few MB of others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ARRAY_MOST = 4096  # values of an array container; above, a bitmap is smaller
BITS = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], dtype=bool)
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]


class ArrayPart:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.values[i])


class BitmapPart:
    """65,536 bits in 1,024 words, with the number of bits before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(1 << 16, dtype=bool)
        bits[values] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = BITS[self.words[word : word + 1].view(np.uint8)].ravel()
        return word * 64 + int(np.flatnonzero(bits)[i - int(self.before[word])])


class RunPart:
    """Runs of neighbouring values: starts, and the number of values before each run."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.starts, self.before = values[starts].astype(np.uint16), starts

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, side="right")) - 1
        return int(self.starts[run]) + i - int(self.before[run])


def container(values: np.ndarray):
    """The smallest of the three kinds for sorted values below 65,536."""
    starts = np.flatnonzero(np.diff(values, prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(values), 8192):
        return RunPart(values, starts)
    return ArrayPart(values) if len(values) <= ARRAY_MOST else BitmapPart(values)


class BoundarySet:
    """A sorted set of integers with select."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        at = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[at]
        self.parts = [container(part & 0xFFFF) for part in np.split(values, at[1:])] if len(values) else []
        self.before = np.append(at, len(values))  # cumulative cardinalities

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, i: int) -> int:
        """The i-th smallest value, from 0."""
        k = int(np.searchsorted(self.before, i, side="right")) - 1
        return (int(self.keys[k]) << 16) + self.parts[k].select(i - int(self.before[k]))


def token_ends(text: str) -> np.ndarray:
    """Ends, in code points, of the tokens: white space with the word behind it, or white space at the end alone."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    solid = (points != 0x20) & ((points < 0x09) | (points > 0x0D))
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    if len(solid):
        last[-1] = True
    return np.flatnonzero(last) + 1


def split_text(text: str, boundaries: BoundarySet, a: int, b: int) -> tuple[str, str, str]:
    """Prefix of a tokens, middle up to token b, and the rest."""
    p, m = (boundaries.select(i - 1) if i else 0 for i in (a, b))
    return text[:p], text[p:m], text[m:]


def restore(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    lead = PREFIX if form == "psm" else SUFFIX
    one, rest = output[len(lead) :].split(SUFFIX if form == "psm" else PREFIX, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def transformed(text: str, key: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text; key: decimal doc_id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
    boundaries = BoundarySet(token_ends(text))
    n = len(boundaries)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = split_text(text, boundaries, *cuts)
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80, digests: bool = False) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars, output and restored (rebuilt from output and form).

    rate: per cent of texts that are cut, spm_rate: per cent of those with the suffix first. digests: output and restored
    are sha256 in lowercase hex instead of texts, so that the texts needn't leave the task.
    """
    kept = docs.drop(*RESULTS)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, k) for n, k in zip(RESULTS, kinds)]])
    told = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digests else (lambda s: s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            rows = []
            for k, raw in zip(part.column(key).to_pylist(), part.column(text).cast(pa.binary()).to_pylist()):
                *cut, output = transformed((raw or b"").decode("utf-8", "replace"), "" if k is None else str(k), seed, rate, spm_rate)
                rows.append((*cut, told(output), told(restore(output, cut[1]))))
            made = [pa.array([r[i] for r in rows], pa.int64() if isinstance(k, T.LongType) else pa.string()) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *RESULTS])

    return kept.mapInArrow(run, schema)


def op12(docs: DataFrame) -> DataFrame:
    done = fill_in_middle(docs.select("doc_id", "text"), digests=True)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").alias("output_sha256"), F.col("restored").alias("restored_sha256"))
