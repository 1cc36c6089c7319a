"""Every pipeline stage on nulls, empty and repeated rows, ties, an empty table, and on
columns with the names that operators use themselves."""

import random

import pytest
from pyspark.sql import functions as F

from rolloom.llm import decontam, quality

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to", "vi", "za") for b in ("n", "ra", "st", "mo", "le", "pi")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("cls", "root", "block", "key", "size", "target", "hits", "items", "slot", "n", "end", "part", "rest", "epochs", "cell", "start")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    return str(tmp_path_factory.mktemp("tables"))


@pytest.fixture(scope="module")
def odd(spark, tables):
    rng = random.Random(71)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item = text(12)
    rows = [(i, text(rng.randint(5, 40)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1) for i in range(40)]
    rows += [(None, None, None, None, None), (None, "", "en", "a", 0), (40, "  \t\n ", "en", "a", 4), (41, None, "en", None, None)]
    rows += [rows[0], rows[0], (42, rows[1][1], "de", "b", 1), (42, text(30), "de", "b", 1), (None, rows[2][1], "en", "a", 1)]
    rows += [(43, f"before {item} after", "en", "a", 1), (44, text(20_000), None, "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, 1) for i in range(30)] + [(1, 0), (None, 1), (99, 1), (2, None)], "doc_id long, quality int").write.parquet(f"{tables}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, ""), (1, item)], "item_id long, text string").write.parquet(f"{tables}/benchmark.parquet")
    return docs


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, odd, tables, k):
    name, stage = stages()[k]
    docs = odd.withColumns({c: F.lit(c) for c in CLASHES}) if name != "sharding" else odd.withColumns({c: F.lit(c) for c in CLASHES if c != "slot"})
    out = stage(spark, docs, tables)
    assert out.columns[: len(odd.columns)] == odd.columns and set(docs.columns) <= set(out.columns)
    rows = out.collect()
    given = {(r.doc_id, r.text) for r in docs.collect()}
    if name != "mixing sources to target weights":
        assert {(r.doc_id, r.text) for r in rows} <= given
    assert all(r.n == "n" and r.cls == "cls" for r in rows)
    if name == "n-gram Jaccard join":
        assert sum(r.doc_id == 0 for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 3
    if name == "benchmark decontamination":
        assert len(rows) == odd.count() - 1 and 43 not in {r.doc_id for r in rows}
    if name == "sharding":
        assert len(rows) == odd.count() and all(r.shard for r in rows)
    assert stage(spark, docs.where("false"), tables).collect() == []


def test_repeated_items_and_many_blocks(spark, odd, tables):
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    for words in (2_000_000, 11):  # one block, and items in parts of eleven words
        got = decontam.overlap_report(odd, bench, block_words=words).where("contaminated").collect()
        assert [(r.doc_id, r.n_hit, r.n_items, r.longest_start) for r in got] == [(43, 12, 1, 1)]


def test_null_languages_and_several_labels(spark, odd, tables):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows = quality.judge_quality(odd, labels, least=5).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["__lang"], set()).add(r.threshold)
        assert r.kept or r.perplexity > r.threshold
    assert all(len(x) == 1 for x in by.values())
    assert {r.trusted for r in rows if r["__doc_id"] == 1} == {True} and {r.trusted for r in rows if r["__doc_id"] is None} == {False}
