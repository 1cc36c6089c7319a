"""Passages against brute force: every verbatim stretch, and the recall of edited ones."""

import random

import numpy as np
import pytest

from rolloom.llm import substring_dedup

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to", "vi", "za") for b in ("n", "ra", "st", "mo", "le", "pi")]
LEAST = 50


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 0, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, head int, cls int")


def repeated_words(texts):
    """For each text the places of words in stretches of LEAST words that another text has
    too, and those of them that a text before it has."""
    stretches = {}
    for i, t in enumerate(texts):
        ws = (t or "").lower().split()
        for k in range(len(ws) - LEAST + 1):
            stretches.setdefault(tuple(ws[k : k + LEAST]), []).append((i, k))
    everywhere, later = [set() for _ in texts], [set() for _ in texts]
    for places in stretches.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                everywhere[i].update(range(k, k + LEAST))
                if i > min(j for j, _ in places):
                    later[i].update(range(k, k + LEAST))
    return everywhere, later


def test_every_verbatim_stretch_is_found(spark):
    rng = random.Random(41)
    passages = [words(rng, n) for n in (50, 55, 70, 120, 49, 200)]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at = rng.randint(0, len(p) // 3)
            parts += [p[at:] if rng.random() < 0.3 else p, words(rng, rng.randint(0, 60))]
        texts.append(" ".join(sum(parts, [])))
    texts += [texts[3], texts[3].upper(), None, "", " ".join(passages[3] * 2), " ".join(words(rng, 20_000) + passages[1])]
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    everywhere, later = repeated_words(texts)
    found = [set() for _ in texts]
    for r in rows:
        if not r.first:
            found[r.doc_id].update(range(r.start_word, r.end_word))
    assert {r.doc_id for r in rows} >= {i for i, x in enumerate(everywhere) if x}  # near passages besides
    assert not {r.doc_id for r in rows} & {i for i, t in enumerate(texts) if len((t or '').split()) < 49}
    missed = sum(len(x - y) for x, y in zip(later, found, strict=True))
    assert missed <= 0.01 * sum(map(len, later))


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_of_edited_passages(spark, edits):
    rng, texts, pairs = random.Random(43 + edits), [], 60
    for _ in range(pairs):
        passage = words(rng, 100)
        changed = list(passage)
        for _ in range(edits):
            at = rng.randrange(10, 90)
            changed[at : at + rng.randint(0, 1)] = ["other"] * rng.randint(0, 1)
        texts += [" ".join(words(rng, 80) + p + words(rng, 80)) for p in (passage, changed)]
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    met = {(r.match_doc_id, r.doc_id) for r in rows if not r.first}
    wanted = {(2 * i, 2 * i + 1) for i in range(pairs)}
    assert met <= wanted and len(met & wanted) >= 0.9 * pairs
    assert {(r.doc_id, r.match_doc_id) for r in rows if r.first} == met


def test_null_and_repeated_ids(spark):
    rng = random.Random(47)
    passage = words(rng, 60)
    texts = [" ".join(words(rng, 20) + passage + words(rng, 20)) for _ in range(4)]
    rows = substring_dedup.repeated_passages(frame(spark, [*texts, texts[0], texts[1]], ids=[None, 5, 5, 2, 5, None])).collect()
    assert rows and all(r.end_word - r.start_word >= LEAST for r in rows)
    assert {r.doc_id for r in rows} == {None, 2, 5}
    assert [r.match_doc_id for r in rows if r.doc_id == 2 and r.first] and all(r.match_doc_id == 2 for r in rows if r.doc_id == 5 and not r.first)


def test_open_members_meet_once(spark, monkeypatch):
    """Members that share all but a few tokens are a pair each, made on one of these tokens."""
    made, inner = [], substring_dedup._lined

    def counting(met):
        made.append(met.count())
        return inner(met)

    monkeypatch.setattr(substring_dedup, "_lined", counting)
    rng, rows, tokens = np.random.default_rng(5), [], []
    base = rng.integers(1, 1 << 31, 91).astype(np.uint32)
    for c in range(14):
        x = base.copy()
        x[5 * (c % 4) : 5 * (c % 4) + 5] = 7 + c % 3  # groups have a change in common
        x[60 + 2 * c : 62 + 2 * c] = rng.integers(1, 1 << 31, 2)
        rows.append((0, 9, c, 45, 45, 45))
        tokens.append((c, bytearray(x.tobytes())))
    members = spark.createDataFrame(rows, substring_dedup.MEMBER).coalesce(1)
    pairs = substring_dedup._open_pairs(members, spark.createDataFrame(tokens, "cls long, tokens binary").coalesce(1), 46, 41).select("a", "b").collect()
    assert {(r.a, r.b) for r in pairs} == {(a, b) for a in range(14) for b in range(a + 1, 14)}
    assert made == [91], made
