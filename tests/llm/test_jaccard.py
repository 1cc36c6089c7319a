"""The Jaccard join on large families of near copies: right, and without all pairs."""

import random

import numpy as np
import pytest

from rolloom.llm import jaccard_join

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to", "vi", "za") for b in ("n", "ra", "st", "mo", "le", "pi")]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def family(rng, size, least, most, n=150):
    base, out = words(rng, n), []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(least, most)):
            copy[rng.randrange(n)] = f"w{rng.random():.12f}"
        out.append(" ".join(copy))
    return out


def compared(spark, texts, monkeypatch):
    """The result, and how many pairs of classes were compared for it."""
    made = []
    inner = jaccard_join._compare

    def counting(pairs, sets):
        made.append(pairs.count())
        return inner(pairs, sets)

    monkeypatch.setattr(jaccard_join, "_compare", counting)
    docs = spark.createDataFrame([(i, t, 0, 0, "") for i, t in enumerate(texts)], "doc_id long, text string, cls int, hub int, root string").coalesce(1)
    rows = jaccard_join.jaccard_components(docs, most=4).collect()
    monkeypatch.setattr(jaccard_join, "_compare", inner)
    return {r.doc_id: r for r in rows}, sum(made)


def test_pairs_of_a_family_grow_with_its_size(spark, monkeypatch):
    counts = []
    for size in (150, 300):
        rng = random.Random(61)
        texts = family(rng, size, 3, 9)
        got, n = compared(spark, texts, monkeypatch)
        assert {i: r.component_id for i, r in got.items()} == dict(enumerate(jaccard_join.brute_force(texts)))
        counts.append(n)
    assert counts[1] < 2.6 * counts[0] and counts[1] < 8 * 300


def nested(rng, size, n=200):
    """A family, and another whose head is nine edits from the first's; few members link."""
    first = words(rng, n)
    second = list(first)
    for at in rng.sample(range(n), 9):
        second[at] = f"h{rng.random():.12f}"
    out = []
    for head in (first, second):
        for _ in range(size // 2):
            copy = list(head)
            for at in rng.sample(range(n), rng.randint(2, 7)):
                copy[at] = f"w{rng.random():.12f}"
            out.append(" ".join(copy))
    return out


def test_pairs_walked_grow_with_a_family(spark, monkeypatch):
    walked, inner = [], jaccard_join._walk

    def counting(x, y):
        out = inner(x, y)
        walked[-1] += out.count()
        return out

    monkeypatch.setattr(jaccard_join, "_walk", counting)
    for size in (200, 400, 800):
        texts = nested(random.Random(73), size)
        walked.append(0)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = jaccard_join.jaccard_components(docs, most=4, count_links=False).collect()
        if size == 200:
            assert {r.doc_id: r.component_id for r in got} == dict(enumerate(jaccard_join.brute_force(texts)))
    assert all(n < 200 * size for n, size in zip(walked, (200, 400, 800), strict=True)), walked  # was 850, 1900, 3900 a text


def test_pairs_within_a_component_are_not_compared(spark, monkeypatch):
    """Two groups of sets that all link, and all pairs: links that others imply need no comparison."""
    tried, inner = [], jaccard_join._compare

    def counting(pairs, sets):
        tried.append(pairs.count())
        return inner(pairs, sets)

    monkeypatch.setattr(jaccard_join, "_compare", counting)
    monkeypatch.setattr(jaccard_join, "FEW", 20)
    rows = [(100 * g + i, bytearray(np.arange(1000 * g + i, 1000 * g + i + 400, dtype=np.uint64).tobytes()), 400) for g in (0, 1) for i in range(30)]
    sets = spark.createDataFrame(rows, "cls long, shingles binary, n long").coalesce(1)
    ids = [r[0] for r in rows]
    pairs = spark.createDataFrame([(a, b, 400 - b + a if b - a < 30 else 1) for a in ids for b in ids if a < b], "a long, b long, n long").coalesce(1)
    none = spark.createDataFrame([], "node long, root long")
    labels = {r.node: r.root for r in jaccard_join._joined(pairs, none, sets, 80).collect()}
    assert {labels[i] for i in ids if i < 100} == {0} and {labels[i] for i in ids if i >= 100} == {100}
    assert sum(tried) < 1200  # 870 pairs link, 900 lie between the groups; all 1770 were compared


@pytest.mark.parametrize("seed", range(3))
def test_nearer_hubs_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "GROUP_PAIRS", 1)  # every group of some size gets a nearer hub
    rng = random.Random(seed)
    texts = []
    for _ in range(3):
        texts += nested(rng, 24, n=60) + family(rng, 24, 0, 5, n=60)
    rng.shuffle(texts)
    got, _ = compared(spark, texts, monkeypatch)
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(jaccard_join.brute_force(texts)))


def test_families_within_families(spark, monkeypatch):
    rng = random.Random(67)
    texts = family(rng, 60, 0, 14)
    for t in texts[:6]:  # copies of far members, linked with them alone
        ws = t.split()
        for _ in range(12):
            copy = list(ws)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(ws))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    line = " ".join(words(rng, 30))
    texts += [f"{' '.join(words(rng, 60))} {line} {' '.join(words(rng, 60))}" for _ in range(60)]  # a passage that many share
    texts += [None, "", "a " * 30_000, "one two", "one two"]
    rng.shuffle(texts)
    got, _ = compared(spark, texts, monkeypatch)
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(jaccard_join.brute_force(texts)))
