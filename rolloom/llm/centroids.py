"""Centroid clustering by exponion search, over whole-number vectors.

Vectors are packed into blocks and written once, bucketed by block. What a round keeps of
them (cluster, an upper bound of the distance to the own centroid, a lower bound of that to
any other) is a second table with the same buckets, so a round joins the two without a
shuffle and rewrites some nine bytes a vector. A vector whose bounds don't settle its cluster
scans only the centroids inside a ball around its current one, taken from that centroid's
list of the others by distance."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bucketed, materialize, partitions, release, whole_vectors

#: Vectors in a block.
BLOCK = BATCH_ROWS
#: Bounds are widened by this share, so that rounding never hides a tie.
SLACK = 1e-9


def pack(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The lists of a column as a matrix."""
    lists = batch.column(batch.schema.get_field_index(column))
    return np.asarray(lists.flatten(), np.int32).reshape(-1, dims)


def _blocks(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column(0)
                matrix = pack(part, "vector", dims)
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())], ["block", "ids", "matrix"])

    return run


class Centroids:
    """The centroids of a round and their distances to each other."""

    def __init__(self, at: np.ndarray):
        self.at = at
        gap = np.sqrt(((at[:, None, :].astype(np.float64) - at[None, :, :]) ** 2).sum(axis=2))
        self.order = np.argsort(gap, axis=1, kind="stable")  # by distance from each, itself among the first
        for a in range(len(at)):  # itself first, also beside an equal one
            row = self.order[a]
            self.order[a] = np.concatenate([[a], row[row != a]])
        self.sorted = np.take_along_axis(gap, self.order, axis=1)
        self.nearest = self.sorted[:, 1] if len(at) > 1 else np.full(1, np.inf)

    def squared(self, vectors: np.ndarray, of: np.ndarray | int) -> np.ndarray:
        off = vectors - self.at[of]
        return np.einsum("ij,ij->i", off, off)


def assign_all(vectors: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound, scanned pairs, from nothing."""
    best = now.squared(vectors, 0)
    cluster, second = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.inf)
    for j in range(1, len(now.at)):
        d = now.squared(vectors, j)
        closer = d < best
        second = np.where(closer, np.sqrt(best), np.minimum(second, np.sqrt(d)))
        cluster[closer], best = j, np.minimum(best, d)
    return cluster, np.sqrt(best), second, len(vectors) * len(now.at)


def exponion(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number) from bounds that hold
    for ``now``. Scanned is the closed ball of radius ``2 * upper + nearest`` around the own
    centroid: it has the nearest and the second nearest, and every tie."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    unsure = np.flatnonzero(upper * (1 + SLACK) >= np.maximum(lower, now.nearest[cluster] / 2) * (1 - SLACK))
    exact = now.squared(vectors[unsure], cluster[unsure])
    upper[unsure] = np.sqrt(exact)
    still = upper[unsure] * (1 + SLACK) >= np.maximum(lower[unsure], now.nearest[cluster[unsure]] / 2) * (1 - SLACK)
    who, best = unsure[still], exact[still]
    home, winner = cluster[who], cluster[who].copy()
    radius = (2 * upper[who] + now.nearest[home]) * (1 + SLACK)
    inside = np.empty(len(who), np.int64)
    for a in np.unique(home):
        mine = home == a
        inside[mine] = np.searchsorted(now.sorted[a], radius[mine], side="right")
    scanned, second = len(unsure), np.full(len(who), np.inf)
    for rank in range(1, int(inside.max(initial=0))):
        some = np.flatnonzero(inside > rank)
        j = now.order[home[some], rank]
        d = now.squared(vectors[who[some]], j)
        scanned += len(some)
        closer = (d < best[some]) | ((d == best[some]) & (j < winner[some]))
        loser = np.where(closer, best[some], d)
        second[some] = np.minimum(second[some], np.sqrt(loser))
        winner[some], best[some] = np.where(closer, j, winner[some]), np.minimum(best[some], d)
    # what lies outside the ball is no nearer than the ball's edge
    edge = radius - upper[who]
    cluster[who], upper[who] = winner, np.sqrt(best)
    lower[who] = np.minimum(second, np.where(inside < len(now.at), edge, np.inf))
    return cluster, upper, lower, scanned


STATE = "block string, cluster binary, upper binary, lower binary, sums array<long>, counts array<long>, scanned long"


def _round(dims: int, centroids: np.ndarray, moved: np.ndarray | None):
    """A round over joined blocks and states; ``moved``: how far each centroid went since the
    states were made (None: there are no states)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(centroids)
        k = len(centroids)
        if moved is not None:
            others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["matrix"], np.int32).reshape(-1, dims).astype(np.int64)
                if moved is None:
                    cluster, upper, lower, scanned = assign_all(vectors, now)
                else:
                    cluster = np.frombuffer(row["cluster"], np.int32).astype(np.int64)
                    upper = np.frombuffer(row["upper"], np.float64) + moved[cluster]
                    lower = np.frombuffer(row["lower"], np.float64) - others[cluster]
                    cluster, upper, lower, scanned = exponion(vectors, cluster, upper, lower, now)
                order = np.argsort(cluster, kind="stable")
                counts = np.bincount(cluster, minlength=k)
                sums = np.zeros((k, dims), np.int64)
                some = np.flatnonzero(counts)
                sums[some] = np.add.reduceat(vectors[order], (np.cumsum(counts) - counts)[some])
                made = [row["block"], cluster.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), sums.ravel().tolist(), counts.tolist(), int(scanned)]
                kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, kinds, strict=True)], ["block", "cluster", "upper", "lower", "sums", "counts", "scanned"])

    return run


def _last(dims: int, centroids: np.ndarray):
    """``id, cluster, distance`` of every vector of joined blocks and final states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["matrix"], np.int32).reshape(-1, dims).astype(np.int64)
                cluster = np.frombuffer(row["cluster"], np.int32)
                off = vectors - centroids[cluster]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array(np.einsum("ij,ij->i", off, off), pa.int64())], ["id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ``seed:id`` has the smallest SHA-256, in that order (ties: by vector)."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(rank.alias("rank"), "vector").orderBy("rank", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector
    after ``rounds`` rounds of assignment and update and a last assignment.

    Vectors with another number of components, or with a null or non-finite one, take no
    part, nor do those with ``|scale * x|`` of 2^27 or more, whose squared distances may not
    fit a long. Rows of one id are vectors of their own; a null id counts as an empty one in the choice
    of first centroids. With fewer than ``k`` vectors there are as many centroids. An empty
    table gives no rows. The driver holds ``k`` centroids and their sums, no vectors."""
    spark = df.sparkSession
    vectors = whole_vectors(df, vector_col, scale, dims, [F.col(id_col).cast("long").alias("id")])
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    buckets = max(1, partitions(spark))
    packed = materialize(vectors.mapInArrow(_blocks(dims), "block string, ids array<long>, matrix binary"), "cluster-packed")
    blocks = bucketed(packed.repartition(buckets, "block"), "cluster-blocks", "block", buckets)
    release(packed)
    states, moved = None, None
    for step in range(rounds + 1):
        joined = blocks if states is None else blocks.join(states.select("block", "cluster", "upper", "lower").hint("shuffle_hash"), "block")
        made = joined.mapInArrow(_round(dims, centroids, moved), STATE)
        fresh = bucketed(made, "cluster-states", "block", buckets)
        if states is not None:
            release(states)
        states = fresh
        if step == rounds:
            break
        fresh_at = _updated(states, centroids)
        moved = np.sqrt(((fresh_at - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        centroids = fresh_at
    final = blocks.join(states.select("block", "cluster").hint("shuffle_hash"), "block").mapInArrow(_last(dims, centroids), "id long, cluster int, distance long")
    found = materialize(final, "cluster-found")
    release(states)
    release(blocks)
    each = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(j, each[j], sum(each.values()), digest[j]) for j in each]
    stats = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(stats, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _updated(states: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; an empty cluster keeps its centroid."""
    k, dims = centroids.shape
    summed = states.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
    counted = states.select(F.posexplode("counts").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
    sums, counts = {r.place: r.value for r in summed}, {r.place: r.value for r in counted}
    return np.array([[sums[j * dims + i] // counts[j] for i in range(dims)] if counts[j] else centroids[j].tolist() for j in range(k)], np.int64)


def brute_force(vectors: Sequence[Sequence[int]], first: Sequence[Sequence[int]], rounds: int = 10) -> tuple[list[int], list[list[int]]]:
    """Clusters and centroids by scanning everything in every round (small fixtures)."""
    at = [list(c) for c in first]
    near = lambda v: min(range(len(at)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, at[j], strict=True)), j))
    for _ in range(rounds):
        own = [near(v) for v in vectors]
        for j in range(len(at)):
            mine = [v for v, c in zip(vectors, own, strict=True) if c == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [near(v) for v in vectors], at
