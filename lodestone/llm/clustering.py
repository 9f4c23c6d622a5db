"""Operator 11: k-means with ns-bounds over integer vectors.

A vector keeps the exact distance to its centroid and one lower bound per group of centroids, each with the round of its
last evaluation. The centroids of all rounds are retained, so a bound is loosened by the norm of the centroid's total
displacement since that round (for a group: the largest of its members), not by the sum of the drifts in between. A vector
whose loosened bounds keep all groups apart stays without a distance computed; the groups that fail are rescanned exactly,
on integers, so ties and results are those of an exhaustive search.

Each round reads the stored state, assigns in tasks and writes the state of the next one to the shared folder; sums of
components are partial aggregates in the JVM. The driver holds k centroids of d integers for each round, nothing else.

Defined cases: null vectors, vectors of another length and those with null or non-finite components are left out; a null
vec_id is clustered like any other but sorts last among the first centroids; rows that repeat a vec_id are vectors of
their own (as first centroids in the order of their components); fewer vectors than k give as many centroids; an empty
table gives an empty result; other columns, whatever their names, are kept out of the work. A component beyond 2^19 in
magnitude stops the run with a message, as squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, stored

LARGEST = 1 << 19  # magnitude of a component: 64 squared differences of its 256-fold stay below 2^63
SLACK = 1e-6  # bounds are rounded; a pair of distances closer than this share counts as undecided
STATE = "vec_id long, x array<int>, cluster int, distance long, own byte, low binary, seen binary"


def integer_vectors(vectors: DataFrame, dims: int, scale: int = 256) -> DataFrame:
    """vec_id, x: the integers floor(scale * component) of the vectors with dims finite components."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    whole = F.transform(x, lambda v: F.when(F.abs(v) > LARGEST, F.raise_error(F.lit(f"a component is beyond {LARGEST}")).cast("int")).otherwise(F.floor(v * scale).cast("int")))
    return vectors.filter((F.size(x) == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(digest.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c, as integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 52:  # every intermediate sum is an integer that a double holds
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


class Rounds:
    """Centroids of all rounds so far, and how far each has moved since each round."""

    def __init__(self, history: np.ndarray, groups: int):
        self.history, self.now, self.k = history, len(history) - 1, history.shape[1]
        self.group_of = np.arange(self.k) * groups // self.k
        self.members = [np.flatnonzero(self.group_of == g) for g in range(groups)]
        moved = np.sqrt(((history[-1].astype(np.float64) - history) ** 2).sum(axis=2))  # [round, centroid]
        self.moved = moved
        self.group_moved = np.stack([moved[:, m].max(axis=1) for m in self.members], axis=1)  # [round, group]

    def scan(self, x: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact distances to the members of a group, nearest first (smaller number among equals), and their numbers."""
        d = squared(x, self.history[-1][self.members[g]])
        order = np.argsort(d, axis=1, kind="stable")[:, :2]
        return np.take_along_axis(d, order, axis=1), self.members[g][order]

    def first(self, x: np.ndarray):
        """State of vectors that no round has seen."""
        n, groups = len(x), len(self.members)
        state = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.full((n, groups), -np.inf), np.zeros((n, groups), np.uint8)
        return self.settle(x, *state, np.ones((n, groups), bool))

    def assign(self, x, cluster, distance, own, low, seen):
        """State after this round, from the state of the last one."""
        upper = np.sqrt(distance.astype(np.float64)) + self.moved[own, cluster]
        loose = low - self.group_moved[seen, np.arange(low.shape[1])]
        asked = np.flatnonzero((loose <= (upper * (1 + SLACK) + SLACK)[:, None]).any(axis=1))
        if len(asked):
            exact = ((x[asked] - self.history[-1][cluster[asked]]) ** 2).sum(axis=1)  # tightens the upper bound
            fails = loose[asked] <= (np.sqrt(exact.astype(np.float64)) * (1 + SLACK) + SLACK)[:, None]
            part = self.settle(x[asked], cluster[asked], exact, np.full(len(asked), self.now), low[asked], seen[asked], fails)
            for whole, piece in zip((cluster, distance, own, low, seen), part):
                whole[asked] = piece
        return cluster, distance, own, low, seen

    def settle(self, x, cluster, distance, own, low, seen, fails):
        """Rescans the groups that fail; exact distances decide."""
        was, nearest = cluster.copy(), {}
        for g in range(len(self.members)):
            at = np.flatnonzero(fails[:, g])
            if len(at):
                d, j = nearest[g] = self.scan(x[at], g)
                better = (d[:, 0] < distance[at]) | ((d[:, 0] == distance[at]) & (j[:, 0] < cluster[at]))
                cluster[at[better]], distance[at[better]] = j[better, 0], d[better, 0]
        own = np.full(len(x), self.now)
        left = self.group_of[was]  # the group of a centroid that was left has to count it from now on
        again = (was != cluster) & ~fails[np.arange(len(x)), left]
        for g in range(len(self.members)):
            for at in (np.flatnonzero(fails[:, g]), np.flatnonzero(again & (left == g))):
                if len(at):
                    d, j = nearest[g] if g in nearest and fails[at[0], g] else self.scan(x[at], g)
                    other = np.where(j[:, 0] == cluster[at], d[:, 1] if d.shape[1] > 1 else np.inf, d[:, 0])
                    low[at, g], seen[at, g] = np.nextafter(np.sqrt(other.astype(np.float64)).astype(np.float32), np.float32(-1)), self.now
        return cluster, distance, own, low, seen


def assigned(state: DataFrame, history: np.ndarray, groups: int) -> DataFrame:
    """The state after assigning every vector to the newest centroids. state: vec_id, x or a state of the round before."""
    sent = state.sparkSession.sparkContext.broadcast(history)  # k * d integers for each round
    new = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(sent.value, groups)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = batch.column("x")
            x = rows.flatten().to_numpy().reshape(n, -1).astype(np.int64)
            if new:
                found = rounds.first(x)
            else:
                read = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, -1).copy()
                old = [batch.column(c).to_numpy().astype(np.int64) for c in ("cluster", "distance", "own")]
                found = rounds.assign(x, *old, read("low", "<f4"), read("seen", np.uint8))
            cluster, distance, own, low, seen = found
            packed = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (low.astype("<f4"), seen.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), rows, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(own.astype(np.int8)), *packed], names=["vec_id", "x", "cluster", "distance", "own", "low", "seen"])

    return state.mapInArrow(run, STATE)


def moved_centroids(state: DataFrame, last: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty ones stay."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(last.shape[1])]).alias("s"))
    after = last.copy()
    for r in sums.collect():  # k rows
        after[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return after


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, groups: int = 20) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every kept vector (a stored table), and the final centroids.

    groups: how many groups of centroids have a lower bound; more of them skip more distances and store five bytes each.
    """
    kept = integer_vectors(vectors, dims)
    start = first_centroids(kept, k, seed)
    if not len(start):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), start
    history, state, groups = start[None], kept, min(groups, len(start))
    for _ in range(rounds):
        after = stored(assigned(state, history, groups), "cluster-state")
        if state is not kept:
            dropped(state)
        state = after
        history = np.concatenate([history, moved_centroids(state, history[-1])[None]])
    final = stored(exact_distances(assigned(state, history, groups), history[-1]), "clusters")
    dropped(state)
    return final, history[-1]


def exact_distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and the distance to its newest centroid: that of a vector whose bounds held is of an earlier round."""
    rows = state.sparkSession.createDataFrame([(j, c.tolist()) for j, c in enumerate(centroids)], "cluster int, c array<long>")  # k rows
    gap = F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    return state.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", gap.alias("distance"))


def op11(vectors: DataFrame) -> DataFrame:
    done, centroids = cluster_vectors(vectors)
    spark = vectors.sparkSession
    sums = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(sums.values())
    told = [(j, sums.get(j, 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    info = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
