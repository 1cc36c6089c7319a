"""Centroid clustering against scanning everything."""

import hashlib
import math
import random

import numpy as np
import pytest

from rolloom.llm import centroids as ce


def moving(vectors, first, rounds):
    """Rounds of the exponion search on one block, with the bounds carried on."""
    vectors, at = np.array(vectors, np.int64), np.array(first, np.int64)
    cluster, upper, lower, scanned = ce.assign_all(vectors, ce.Centroids(at))
    for _ in range(rounds):
        fresh = at.copy()
        for j in range(len(at)):
            if (cluster == j).any():
                fresh[j] = vectors[cluster == j].sum(axis=0) // (cluster == j).sum()
        gone = np.sqrt(((fresh - at).astype(float) ** 2).sum(axis=1)) * (1 + ce.SLACK)
        others = np.array([np.delete(gone, j).max(initial=0.0) for j in range(len(at))])
        at = fresh
        cluster, upper, lower, more = ce.exponion(vectors, cluster, upper + gone[cluster], lower - others[cluster], ce.Centroids(at))
        scanned += more
    return cluster.tolist(), at.tolist(), scanned


@pytest.mark.parametrize("seed", range(30))
def test_exponion_is_exact_also_on_ties(seed):
    rng = random.Random(seed)
    dims, k, wide = rng.choice([1, 2, 3]), rng.choice([1, 2, 5, 8]), rng.choice([2, 5, 60])
    vectors = [[rng.randint(-wide, wide) for _ in range(dims)] for _ in range(120)]
    first = vectors[:k]
    want, at = ce.brute_force(vectors, first, 6)
    got, found, _ = moving(vectors, first, 6)
    assert got == want and found == at


def test_far_clusters_are_not_scanned():
    rng = np.random.default_rng(4)
    heart = rng.integers(-100_000, 100_000, (12, 8))
    vectors = np.repeat(heart, 200, axis=0) + rng.integers(-500, 500, (2400, 8))
    first = vectors[::200]
    want, at = ce.brute_force(vectors.tolist(), first.tolist(), 5)
    got, found, scanned = moving(vectors, first, 5)
    assert got == want and found == at
    assert scanned < 0.4 * 6 * len(vectors) * len(first)


def expected(rows, dims, scale, k, rounds, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    own, at = ce.brute_force([v for _, v in kept], [v for _, v in order[:k]], rounds)
    far = [sum((a - b) ** 2 for a, b in zip(v, at[j], strict=True)) for (_, v), j in zip(kept, own, strict=True)]
    inertia = {j: sum(d for d, c in zip(far, own, strict=True) if c == j) for j in set(own)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((i if i is not None else -1, j, d, inertia[j], sum(far), digest[j]) for (i, _), j, d in zip(kept, own, far, strict=True))


def test_whole_query_on_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [0.25, -0.5, 0.125, 1.0]) for i in range(200)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [0.1] * 4)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int, block string")
    got = ce.cluster_vectors(df, dims=4, scale=16, k=5, rounds=4).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == expected(rows, 4, 16, 5, 4, 3)
    few = ce.cluster_vectors(df.where("vec_id in (1, 2, 2000)"), dims=4, k=5, rounds=2).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(1, 0), (2, 0)]
    assert ce.cluster_vectors(df.where("false"), dims=4).collect() == []
    assert spark.catalog.listTables() == []
