"""Dual-tree search against all scores."""

import math
import random

import numpy as np
import pytest

from rolloom.llm import hard_negatives as hn


def search(ids, labels, matrix, anchors, same, low, high, top, block=64):
    s = hn.Search(ids[anchors], labels[anchors], matrix[anchors], low, high, same, top)
    for at in range(0, len(ids), block):
        part = slice(at, at + block)
        s.visit(ids[part], labels[part], matrix[part])
    window, score, who = s.kept
    place, which = np.divmod(window, low.shape[1])
    return s, sorted(zip(s.put[place].tolist(), which.tolist(), (-score).tolist(), who.tolist(), strict=True))


@pytest.mark.parametrize("seed", range(20))
def test_windows_are_exact(seed, monkeypatch):
    monkeypatch.setattr(hn, "BALL", 8)
    monkeypatch.setattr(hn, "GROUP", 4)
    rng = np.random.default_rng(seed)
    n, wide = 200, int(rng.choice([1, 3, 40]))  # narrow components give many ties
    ids, labels, matrix = rng.permutation(n).astype(np.int64), rng.integers(0, 3, n), rng.integers(-wide, wide + 1, (n, 4)).astype(np.int32)
    anchors = np.arange(0, n, 7)
    low, high = np.sort(rng.integers(-4 * wide * wide, 4 * wide * wide, (2, len(anchors), 2)), axis=0)
    for same in (True, False):
        _, got = search(ids, labels, matrix, anchors, same, low.copy(), high, 3)
        want = []
        for k, a in enumerate(anchors):
            scores = matrix @ matrix[a]
            fit = (labels == labels[a]) & (ids != ids[a]) if same else labels != labels[a]
            for w in range(2):
                some = sorted((-int(scores[i]), int(ids[i])) for i in np.flatnonzero(fit & (scores >= low[k, w]) & (scores <= high[k, w])))[:3]
                want += [(k, w, *x) for x in some]
        assert got == sorted(want)


def test_groups_of_anchors_are_pruned(monkeypatch):
    monkeypatch.setattr(hn, "GROUP", 6)
    rng = np.random.default_rng(1)
    heart = rng.integers(-3000, 3000, (20, 16))
    matrix = (np.repeat(heart, 300, axis=0) + rng.integers(-20, 20, (6000, 16))).astype(np.int32)
    ids, labels = np.arange(6000), np.zeros(6000, np.int64)
    anchors = np.arange(0, 6000, 50)
    free = np.full((len(anchors), 1), hn.LOWEST), np.full((len(anchors), 1), hn.HIGHEST)
    s, got = search(ids, labels, matrix, anchors, True, free[0].copy(), free[1], 5, block=600)
    assert s.scored < 0.5 * len(anchors) * len(ids)
    scores = matrix[anchors].astype(np.int64) @ matrix.T
    for k, a in enumerate(anchors):
        want = sorted((-int(x), i) for i, x in enumerate(scores[k].tolist()) if i != a)[:5]
        assert [g[2:] for g in got if g[0] == k] == want


def test_large_components_stay_exact():
    big = 1 << 26
    matrix = np.array([[big, 1], [big, 2], [big, 3], [big - 1, big]], np.int32)
    ids, labels = np.arange(4), np.zeros(4, np.int64)
    _, got = search(ids, labels, matrix, np.array([0]), True, np.full((1, 1), hn.LOWEST), np.full((1, 1), hn.HIGHEST), 2)
    assert [g[2:] for g in got] == [(-(big * big + 3), 2), (-(big * big + 2), 1)]


def whole(v, scale=256):
    return [math.floor(scale * x) for x in v]


@pytest.mark.parametrize("block,anchors", [(2048, 65536), (40, 3)])
def test_whole_operator_on_odd_rows(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(hn, "BLOCK", block)  # many leaves, and several passes
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 2), [rng.gauss(0, 1) for _ in range(4)]) for i in range(1, 331)]
    rows += [(1000 + i, i % 3, [0.25, -0.5, 0.125, 1.0]) for i in range(160)]  # a hot vector, with an anchor
    rows += [(5, 0, rows[4][2]), (100, 1, rows[99][2]), (400, 2, [0.5, 0.5])]  # repeated ids, a short vector
    odd = [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (600, 1, None), (700, 1, [1.0, None, 1.0, 1.0]), (800, 2, [float("nan")] * 4), (900, 0, [float("-inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows + odd], "vec_id long, label int, embedding array<double>, leaf int, part int, anchor string")
    got = hn.hard_negatives(df).collect()
    want = hn.brute_force([(i, c, whole(v)) for i, c, v in rows])
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 60
    assert hn.hard_negatives(df.where("false")).collect() == []
    assert hn.hard_negatives(df.where("vec_id = 400")).collect() == []
