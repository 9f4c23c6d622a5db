"""Operator 8: SimHash near-dedup with a Gray-order hierarchical index.

Distinct fingerprints are dealt to tables by blocks of bits: two fingerprints within r differing bits agree on at least
one block of r + 1 (or on c blocks of r + c; c grows with the number of fingerprints so that groups stay small). In each
task the fingerprints of its groups are sorted by group and Gray rank, which keeps those with the same leading bits
together. The tree over that order has one node for each shared 8-bit segment after the segments above it; pairs of nodes
are compared by that segment only, differences are accumulated on the way down, and a pair of whole subtrees is dropped
as soon as they exceed r, or when all their leaves are already in one component. Leaves that match are joined in a
disjoint-set forest, and a task emits that forest (one link per fingerprint at most), never all pairs. A group that is too
large for a task is split into parts, and pairs of parts are groups of their own.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link like any other; a null
doc_id can't be a component id unless all its component has none; repeated rows share a fingerprint; an empty table gives
an empty result; other columns are kept out of the work.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import dropped, join_skewed, slices, stored
from lodestone.plans.components import connected_components

SEED = 42
UPPER = string.ascii_uppercase
PAIRS = 1 << 20  # node pairs expanded at once
PART = 1 << 16  # fingerprints of one group in one part
SHINGLES = 1 << 20  # shingle hashes of one component in one part: 8 MB


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each shingle of that many words; of the whole sequence where it is shorter."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int = 4) -> int:
    return majority(shingle_hashes(text.lower().split(), width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [fingerprint(t or b"", width) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of x in the Gray code's order; the leading bits of the rank depend on the leading bits of x alone."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def expand(a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a child of a[i] and a child of b[i], as (i, child of a, child of b)."""
    n = count[a] * count[b]
    i = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return i, first[a[i]] + k // count[b[i]], first[b[i]] + k % count[b[i]]


class Forest:
    """Disjoint sets over 0..n-1 joined by arrays of pairs; a root is the smallest member. links: the pairs that joined two sets."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def root(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            y = p[x]
            if np.array_equal(y, x):
                return x
            x = p[y]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root(a), self.root(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            self.parent[high] = np.minimum(x, y)[first]
            if len(first):
                self.links.append((a[first], b[first]))

    def find(self, x: int) -> int:
        p = self.parent
        while (up := int(p[x])) != x:
            p[x] = p[up]
            x = up
        return x

    def join_checked(self, a: np.ndarray, b: np.ndarray, holds: Callable[[int, int], bool]) -> None:
        """Joins the pairs that are in different sets and for which holds(a, b) is true, one by one."""
        apart = self.root(a) != self.root(b)
        p = self.parent
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            i, j = self.find(x), self.find(y)
            if i != j and holds(x, y):
                p[max(i, j)] = min(i, j)
                self.links.append((np.array([x]), np.array([y])))

    def flat(self) -> np.ndarray:
        return self.root(np.arange(len(self.parent)))


def item_pairs(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an item of node a[i] and a later one of node b[i]."""
    n, m = ends[a] - starts[a], ends[b] - starts[b]
    i = np.repeat(np.arange(len(a)), n * m)
    k = np.arange(len(i)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    x, y = starts[a[i]] + k // m[i], starts[b[i]] + k % m[i]
    return x[x < y], y[x < y]


def near_forest(group: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For each item the smallest item linked to it through pairs of one group within radius differing bits."""
    return linked_forest(group, fp, (radius,)).flat()


def linked_forest(group: np.ndarray, fp: np.ndarray, radii: tuple[int, ...], holds: Callable[[int, int], bool] | None = None) -> Forest:
    """Spanning forest of the pairs of one group within the last radius; pairs within the earlier radii are joined first.

    fp: one or several 64-bit lanes (columns) for each item. Items come sorted by group and Gray rank, without repeats in a
    group. holds: asked for each pair of items whose parts aren't joined yet; only pairs for which it is true are joined, and
    items may repeat.
    """
    n = len(fp)
    forest = Forest(n)
    segments = np.ascontiguousarray(fp).astype(">u8").view(np.uint8).reshape(n, -1)
    depth = segments.shape[1]
    # starts[l]: first item of each node of level l, where level 0 has one node per group and the last level one per item
    new = np.ones(n, dtype=bool)
    new[1:] = group[1:] != group[:-1]
    starts = [np.flatnonzero(new)]
    for k in range(depth):
        new = new.copy()
        new[1:] |= segments[1:, k] != segments[:-1, k]
        starts.append(np.flatnonzero(new))
    first, count = [], []
    for up, down in zip(starts, starts[1:]):
        at = np.searchsorted(down, up)
        first.append(at)
        count.append(np.diff(np.append(at, len(down))))
    ends = [np.append(s[1:], n) for s in starts]
    several = np.flatnonzero(ends[0] - starts[0] > 1)
    stack = [(radius, 0, several, several, np.zeros(len(several), dtype=np.int64)) for radius in reversed(radii)]
    while stack:
        radius, level, a, b, diff = stack.pop()
        if level == depth:
            if holds is None:
                forest.join(starts[depth][a], starts[depth][b])
            else:
                forest.join_checked(*item_pairs(starts[depth], ends[depth], a, b), holds)
            continue
        if level:  # whole subtrees that are in one component already
            flat = forest.flat()
            lo, hi = (f.reduceat(flat, starts[level]) for f in (np.minimum, np.maximum))
            going = (lo[a] != hi[b]) | (hi[a] != lo[b]) | (lo[a] != hi[a])
            a, b, diff = a[going], b[going], diff[going]
        weight = np.cumsum(count[level][a] * count[level][b])
        if len(a) > 1 and weight[-1] > PAIRS:
            half = min(max(1, int(np.searchsorted(weight, weight[-1] // 2))), len(a) - 1)
            stack += [(radius, level, a[half:], b[half:], diff[half:]), (radius, level, a[:half], b[:half], diff[:half])]
            continue
        i, x, y = expand(a, b, first[level], count[level])
        keep = x <= y if level == depth - 1 else (a[i] != b[i]) | (x <= y)
        i, x, y = i[keep], x[keep], y[keep]
        at = starts[level + 1]
        total = diff[i] + np.bitwise_count(segments[at[x], level] ^ segments[at[y], level])
        near = (total <= radius) & ((x != y) | (ends[level + 1][x] - at[x] > 1))
        if near.any():
            stack.append((radius, level + 1, x[near], y[near], total[near]))
    return forest


def blocks_for(n: int, radius: int, group: int = 2048) -> tuple[int, int]:
    """Number of blocks and how many of them must agree, so that an even spread gives groups of about that size."""
    for c in (1, 2, 3, 4):
        if n >> (64 * c // (radius + c)) <= group:
            break
    return radius + c, c


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def grouped_links(keyed: DataFrame, lanes: list[str], radii: tuple[int, ...], star: bool = False) -> DataFrame:
    """Links of a spanning forest of each group (t, value): a0.., b0.. (the lanes of both ends) and distance.

    star: each member is linked to the first of its tree in Gray order instead of to a neighbour, so that groups with the
    same members give the same links.

    A group of more than PART fingerprints is split into parts by hash; each pair of parts is a group of its own, so no
    task holds more than two parts and no pair is lost.
    """
    counted = keyed.groupBy("t", "value").agg(F.count("*").alias("n")).filter("n > 1")  # most fingerprints are alone
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), *lanes), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(o, own).alias("lo"), F.greatest(o, own).alias("hi")))
    # keyed has a row for each mask, but Spark takes it to be as large as the table before the explode: never a broadcast
    paired = keyed.hint("merge").join(counted, ["t", "value"]).select("t", "value", *lanes, F.inline(pairs))
    group_by = ["t", "value", "lo", "hi"]

    def edges(rows: pa.Table) -> np.ndarray:
        """Places behind the last row of each group but the last."""
        columns = [rows.column(c).to_numpy() for c in group_by]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1

    def solve(rows: pa.Table) -> pa.RecordBatch:
        group = np.zeros(rows.num_rows, np.int64)
        group[edges(rows)] = 1
        group, fp = np.cumsum(group), np.stack([rows.column(c).to_numpy().view(np.uint64) for c in lanes], axis=1)
        order = np.lexsort((*[gray_rank(fp[:, k]) for k in reversed(range(len(lanes)))], group))
        group, fp = group[order], fp[order]
        forest = linked_forest(group, fp, radii)
        if star:
            b = forest.flat()
            a = np.flatnonzero(b != np.arange(len(b)))
            b = b[a]
        else:
            a, b = (np.concatenate(x) if forest.links else np.zeros(0, np.int64) for x in (zip(*forest.links) if forest.links else ((), ())))
        distance = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1).astype(np.int32)
        ends = [pa.array(np.ascontiguousarray(fp[x, k]).view(np.int64)) for x in (a, b) for k in range(len(lanes))]
        return pa.RecordBatch.from_arrays([*ends, pa.array(distance)], names=[f"{x}{k}" for x in "ab" for k in range(len(lanes))] + ["distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 1 << 17:
                rows = pa.Table.from_batches(held).combine_chunks()
                at = edges(rows)
                if len(at):  # whole groups only; the last may go on
                    yield solve(rows.slice(0, at[-1]))
                    held = rows.slice(at[-1]).to_batches()
        if held and sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held).combine_chunks())

    schema = ", ".join(f"{x}{k} long" for x in "ab" for k in range(len(lanes))) + ", distance int"
    return paired.repartition(*group_by).sortWithinPartitions(*group_by).mapInArrow(run, schema)


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: links between distinct fingerprints fp whose components are those of all pairs within radius bits."""
    blocks, agree = blocks_for(fps.count(), radius)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in combinations(range(blocks), agree)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "value"))
    return grouped_links(keyed, ["fp"], (radius,)).select(F.col("a0").alias("a"), F.col("b0").alias("b"))


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every document."""
    marks = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    labels = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    size = distinct.count()
    by_fp = join_skewed(named.select("fp", "component", "n"), least.join(named.groupBy("component").agg(F.count("*").alias("members")), "component"), ["component"], "members", size)
    return join_skewed(marks, by_fp.select("fp", "n", "component_id"), ["fp"], "n", marks.count()).select("doc_id", "fp", "component_id")


LANES = ["f0", "f1"]


def lanes_of(hashes: np.ndarray) -> list[int]:
    """Two fingerprints, the second from remixed hashes: 128 bits."""
    with np.errstate(over="ignore"):
        other = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return [majority(hashes), majority(other ^ (other >> np.uint64(32)))]


def differing_share(similarity: float) -> float:
    """Expected share of differing bits between two sets of equal size with that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def random_masks(n: int, share: float, missed: float = 0.05, group: int = 16) -> list[list[int]]:
    """Masks of k of the 128 bits each: k for groups of about that size, and so many that all but the missed part of the
    pairs with that share of differing bits agree on one of them."""
    k = min(48, max(8, math.ceil(math.log2(max(n, 2) / group))))
    tables = math.ceil(math.log(missed) / math.log1p(-((1 - share) ** k)))
    rnd = np.random.Generator(np.random.PCG64(17))
    return [[signed(sum(1 << int(b) - 64 * lane for b in chosen if b // 64 == lane)) for lane in (0, 1)] for chosen in (rnd.choice(128, k, replace=False) for _ in range(tables))]


def texts_with_marks(docs: DataFrame, width: int) -> DataFrame:
    """Stored table d (the row), row (a number), digest of the words, f0, f1."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d")
            for part in slices(iter([pa.RecordBatch.from_arrays([d, pa.compute.struct_field(d, "text").cast(pa.binary())], names=["d", "text"])]), "text"):
                words = [(t or b"").lower().split() for t in part.column("text").to_pylist()]
                prints = np.array([lanes_of(shingle_hashes(w, width)) for w in words], np.uint64).view(np.int64)
                digest = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(digest, pa.binary()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["d", "digest", *LANES])

    schema = T.StructType([*row.schema.fields, T.StructField("digest", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in LANES]])
    return stored(row.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "near-rows")


def candidate_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Stored table a, b: links whose components are those of the nodes with fingerprints as near as the similarity asks for."""
    prints = stored(nodes.groupBy(*LANES).agg(F.min("node").alias("least")), "near-prints")
    share = differing_share(similarity)
    radius = math.ceil(128 * share + 2 * math.sqrt(128 * share * (1 - share)))
    masks = random_masks(prints.count(), share)
    value = F.array(*[F.xxhash64(*[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(LANES, mask)]) for mask in masks])
    links = grouped_links(prints.select(*LANES, F.posexplode(value).alias("t", "value")), LANES, (radius // 4, radius // 2, radius), star=True)
    # a member keeps its smallest first only; its others (one for each mask at most) are linked to that one, mostly the same for all members
    root = lambda x: [F.col(f"{x}.b0").alias("b0"), F.col(f"{x}.b1").alias("b1")]
    firsts = links.groupBy("a0", "a1").agg(F.collect_set(F.struct("b0", "b1")).alias("firsts")).withColumn("root", F.array_min("firsts"))
    others = firsts.select(F.explode(F.array_except("firsts", F.array("root"))).alias("other"), "root")
    links = firsts.select("a0", "a1", *root("root")).unionByName(others.select(F.col("other.b0").alias("a0"), F.col("other.b1").alias("a1"), *root("root"))).distinct()
    for end in "ab":
        links = links.join(prints.select(F.col("f0").alias(f"{end}0"), F.col("f1").alias(f"{end}1"), F.col("least").alias(end)).hint("merge"), [f"{end}0", f"{end}1"])
    same = nodes.join(prints, LANES).filter("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = stored(links.select("a", "b").unionByName(same), "near-links")
    dropped(prints)
    return found


def shingle_sets(asked: DataFrame, width: int) -> DataFrame:
    """asked with grams (the distinct shingle hashes, sorted, as bytes) and size (their number) instead of text."""
    kept = asked.select("node", "component", *LANES, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            grams = [np.unique(shingle_hashes((t or b"").lower().split(), width)) for t in part.column("text").cast(pa.binary()).to_pylist()]
            made = [pa.array([g.tobytes() for g in grams], pa.binary()), pa.array([len(g) for g in grams], pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=["node", "component", *LANES, "grams", "size"])

    return kept.mapInArrow(run, "node long, component long, f0 long, f1 long, grams binary, size long")


def verified_links(asked: DataFrame, width: int, similarity: float) -> DataFrame:
    """a, b: a spanning forest of the pairs whose shingle sets have that Jaccard similarity, within components of candidates.

    asked: node, text, component and lanes of the nodes that have a candidate.
    A component of candidates is searched anew by the tree, with the sets at hand: a pair within the radius is joined only if
    its sets are similar, so no pair hides behind a link that doesn't hold, and only pairs of parts that are joined already
    are passed over. The radius is wider than that of the candidates, as a pair costs a comparison and no row. A component with
    more than SHINGLES hashes is split into parts by hash; each part is searched by itself, and each pair of parts across.
    """
    held = stored(shingle_sets(asked, width), "near-sets")
    parts = F.ceil(F.sum("size") / SHINGLES).cast("int")
    large = stored(held.groupBy("component").agg(parts.alias("parts")).filter("parts > 1"), "near-large")  # few: the sets stay where they are
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, own).alias("lo"), F.greatest(o, own).alias("hi"), (own < o).alias("low_side")))
    group_by = ["component", "lo", "hi"]
    paired = held.join(large, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).select("component", "node", "grams", *LANES, F.inline(pairs)).repartition(*group_by).sortWithinPartitions(*group_by)
    share = differing_share(similarity)
    radius = math.ceil(128 * share + 4 * math.sqrt(128 * share * (1 - share)))

    def solve(rows: pa.Table) -> pa.RecordBatch:
        fp = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in LANES], axis=1)
        order = np.lexsort([gray_rank(fp[:, k]) for k in reversed(range(len(LANES)))])
        node, grams = rows.column("node").to_numpy()[order], rows.column("grams").take(pa.array(order)).to_pylist()
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        side = rows.column("low_side").to_numpy()[order]
        across = rows.column("lo")[0] != rows.column("hi")[0]

        def holds(i: int, j: int) -> bool:
            x, y = sets[i], sets[j]
            if across and side[i] == side[j]:
                return False  # each part has a group of its own
            if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                return False
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            return common >= similarity * (len(x) + len(y) - common)

        links = linked_forest(np.zeros(len(order), np.int64), fp[order], (radius // 6, radius // 3, radius // 2, radius), holds).links
        a, b = (np.concatenate(x) if links else np.zeros(0, np.int64) for x in (zip(*links) if links else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in group_by]))
            start = 0
            for i, key in enumerate(keys):
                if key != last:
                    held.append(batch.slice(start, i - start))
                    if sum(x.num_rows for x in held) > 1:
                        yield solve(pa.Table.from_batches(held).combine_chunks())
                    held, start, last = [], i, key
            held.append(batch.slice(start))
        if sum(x.num_rows for x in held) > 1:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    sure = stored(paired.mapInArrow(run, "a long, b long"), "near-verified")
    dropped(held)
    return sure


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs less near copies: of each group linked by Jaccard similarity of the word shingles, the row with the smallest doc_id stays.

    Texts with the same words are one node. Fingerprints of 128 bits meet in tables of random masks, whose groups the
    Gray-order tree searches for candidates. Within each component of candidates the tree is searched again and every pair is
    verified on the shingles' 64-bit hashes before it joins anything.
    The search for candidates is probabilistic: a lone pair at the very similarity meets in 9 of 10 cases, one 0.05 above it
    in 99 of 100; members of a family of similar texts need to meet one of them only. No link is made below the similarity.

    Defined cases: null and empty texts, and texts without words, have equal words; of rows with the same doc_id one stays;
    a null doc_id sorts after all others; an empty table gives an empty result; all columns are kept as they are.
    """
    rows = texts_with_marks(docs, width)
    place = F.struct(F.col("d.doc_id").isNull().alias("no_id"), F.coalesce("d.doc_id", F.lit(0)).alias("id"), F.col("row").alias("row"))
    nodes = stored(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min(place).alias("least"), *[F.first(c).alias(c) for c in LANES]), "near-nodes")
    candidates = candidate_links(nodes.select("node", *LANES), similarity)
    labels = connected_components(candidates)
    # copies go here, and rows are shuffled whole this once; what has no candidate stays as it is from here on
    named = nodes.join(labels, "node", "left").select("node", "component", "least", *LANES, F.col("least.row").alias("row"))
    left = stored(rows.select("row", "d").join(named, "row"), "near-left")
    dropped(rows)
    dropped(candidates)
    asked = left.filter("component is not null")
    sure = verified_links(asked.select("node", "component", *LANES, F.coalesce("d.text", F.lit("")).alias("text")), width, similarity)
    parts = asked.select("node", "row", "least").join(connected_components(sure).withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    kept = stored(parts.groupBy("part").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row")), "near-kept")
    dropped(nodes)
    return left.filter("component is null").select("d.*").unionByName(asked.join(kept, "row", "left_semi").select("d.*"))


def op8(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
