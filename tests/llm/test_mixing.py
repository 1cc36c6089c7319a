"""Mixing where ids repeat or are missing, and with columns of the same names."""

import random

from pyspark.sql import functions as F

from rolloom.llm import mixing

DOCS = "doc_id long, text string, source string, size long, start long, cell long, n long"


def test_repeated_and_missing_ids(spark):
    rng = random.Random(31)
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(["a", "bb", "ccc"]) for _ in range(rng.randint(0, 30)))
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else i, text, rng.choice(["x", "y", None]), 1, 2, 3, 4))
    rows += [(7, "same text in all of these", "x", 1, 2, 3, 4)] * 50
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, cell_rows=20).collect()
    again = mixing.mix(docs.repartition(5), cell_rows=1000).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, again))
    taken, target = {}, {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(target[k] - 51 <= taken[k] <= target[k] + 1 for k in target)
    mixed = mixing.mixed_documents(docs, cell_rows=20)
    assert mixed.columns == docs.columns
    held = mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert held == sum(taken.values())


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, "x", 0, 0, 0, 0), (2, "v " * 10, "y", 0, 0, 0, 0)], DOCS)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert (got[1].size, got[2].size, got[2].taken) == (400_000, 10, 20)
    assert abs(got[1].taken - got[1].target) <= 1
