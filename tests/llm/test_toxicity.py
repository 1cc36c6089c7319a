"""Training of the toxicity model: what it may see, and how it treats odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloom.llm import toxicity

HELD = "crc32(cast(doc_id AS string)) % 5 = 0"
COMMON = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to", "vi", "za") for b in ("n", "ra", "st", "mo", "le", "pi")]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(21)
    texts, toxic = [], []
    for i in range(300):
        toxic.append(int(i % 4 == 0))
        ws = [rng.choice(COMMON) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * toxic[-1]):
            ws.insert(rng.randrange(len(ws)), rng.choice(["hateful", "vermin", "loathsome"]))
        texts.append(" ".join(ws))
    return texts, toxic


def scores(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    return sorted(((r["__doc_id"] is None, r["__doc_id"] or 0, r.score) for r in toxicity.score_toxicity(docs, given, ~F.expr(HELD)).collect()))


def test_held_out_labels_change_nothing(spark, sample):
    texts, toxic = sample
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))]
    rows = list(enumerate(texts))
    told = scores(spark, rows, list(enumerate(toxic)))
    flipped = scores(spark, rows, [(i, 1 - y if h else y) for i, (y, h) in enumerate(zip(toxic, held, strict=True))])
    assert told == flipped
    stray = scores(spark, rows, [*enumerate(toxic), *[(10_000 + i, 1) for i in range(500)]])  # labels without a document
    assert told == stray


def test_both_dictionaries_are_trained(sample):
    texts, toxic = sample
    bad, good = ([t for t, y in zip(texts, toxic, strict=True) if y == c] for c in (1, 0))
    model = toxicity.train(bad, good, 0.25)
    own = model["toxic"][: -len(model["ordinary"])]
    assert model["toxic"].endswith(model["ordinary"]) and b"vermin" in own and b"vermin" not in model["ordinary"]
    assert own[:4] == model["ordinary"][:4] == b"\x37\xa4\x30\xec"  # the mark of a trained zstandard dictionary


def test_repeated_ids_and_both_labels(spark, sample):
    texts, toxic = sample
    rows = [*enumerate(texts), (0, "another text of document zero"), (0, texts[0]), (None, texts[1]), (None, None)]
    labels = [*enumerate(toxic), (3, 1), (3, 0), (None, 1), (5, None)]
    got = scores(spark, rows, labels)
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    assert got == scores(spark, rows[::-1], labels[::-1])


def test_clashing_columns_and_long_texts(spark, sample):
    texts, toxic = sample
    docs = spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in enumerate([*texts, "vermin " * 100_000])], "doc_id long, text string, __id string, score double, toxic int")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = {r["__doc_id"]: r.score for r in toxicity.score_toxicity(docs, labels, ~F.expr(HELD)).collect()}
    assert len(got) == len(texts) + 1 and got[len(texts)] > 0.5
    right = np.mean([(got[i] >= 0.5) == bool(y) for i, y in enumerate(toxic)])
    assert right > 0.9
