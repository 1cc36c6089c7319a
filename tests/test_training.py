"""Samplers, user code, ragged columns, growing datasets, staleness, diagnostics."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloom.functions import ragged
from rolloom.operators import diagnostics, rewards, sampling
from rolloom.plans.training_queries import USER_CODE
from rolloom.sources.extern import custom_score, load_extern
from rolloom.streaming import growing
from rolloom.streaming import queue as sample_queue


def test_user_code_is_loaded(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_extern(f"{tmp_path}/none.py", "f")
    (tmp_path / "bad.py").write_text("1 / 0")
    with pytest.raises(RuntimeError):
        load_extern(f"{tmp_path}/bad.py", "f")
    with pytest.raises(AttributeError):
        load_extern(USER_CODE, "nothing")
    assert load_extern("pkg://json", "dumps") is json.dumps
    rows = spark.createDataFrame([("ab", "b"), (None, "b"), ("xyz", None)], "t string, g string")
    score = custom_score(USER_CODE, "brevity", {"most": 5}, {"right": "boolean"})
    got = [tuple(r.s) for r in rows.select(score(F.lit("src"), F.col("t"), F.col("g")).alias("s")).collect()]
    assert got == [(pytest.approx(0.8), True), (0.5, False), (pytest.approx(0.2), False)]
    later = custom_score(USER_CODE, "lengthy")
    assert [r.s.score for r in rows.select(later(F.lit("src"), F.col("t"), F.col("g")).alias("s")).collect()] == [2.0, 0.0, 3.0]
    batch = rows.withColumn("response_mask", F.array(F.lit(1), F.lit(1), F.lit(0)))
    made = rewards.naive(batch, score(F.lit("src"), F.col("t"), F.col("g"))["score"]).collect()
    assert [r.token_level_scores for r in made] == [[0, pytest.approx(0.8), 0], [0, 0.5, 0], [0, pytest.approx(0.2), 0]]


def test_shares_follow_weights(spark):
    rows = spark.range(6000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 6.0).when(F.col("id") % 3 == 1, 2.0).otherwise(F.lit(None)).alias("w"))
    some = sampling.weighted_sample(rows, 400, F.col("w"), 5)
    got = some.orderBy("place").collect()
    assert [r.place for r in got] == list(range(400)) and len({r.row_id for r in got}) == 400
    heavy = np.mean([r.row_id % 3 == 0 for r in got])
    assert 0.68 < heavy < 0.82 and not any(r.row_id % 3 == 2 for r in got)
    assert sorted(r.row_id for r in sampling.weighted_sample(rows.repartition(7), 400, F.col("w"), 5).collect()) == sorted(r.row_id for r in got)
    assert sampling.weighted_sample(rows, 9999, F.col("w")).count() == 4000


def test_many_rows_are_sorted_by_range(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("row_id"))
    few = [r.row_id for r in sampling.weighted_sample(rows, 90, F.lit(1.0), 2).orderBy("place").collect()]
    monkeypatch.setattr(sampling, "MOST_HEAP", 10)
    assert [r.row_id for r in sampling.weighted_sample(rows, 90, F.lit(1.0), 2).orderBy("place").collect()] == few


def test_samplers(spark):
    rows = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("task_id"), (F.col("id") % 5 < 2).alias("success"))
    places = lambda s, epoch=0: [r.row_id for r in s.order(rows, epoch).orderBy("place").collect()]
    assert places(sampling.create_sampler(shuffle=False)) == list(range(50))
    mixed = sampling.create_sampler(seed=3)
    assert places(mixed) == places(mixed) != places(mixed, 1) and sorted(places(mixed)) == list(range(50))
    own = sampling.create_sampler(path=USER_CODE, name="EvenCurriculum", seed=1)
    assert own.draw(rows, 5, 0).count() == 5 and sorted(places(own)) == list(range(50))
    with pytest.raises(ValueError):
        sampling.create_sampler(path=USER_CODE, name="EvenCurriculum", workers=2)
    with pytest.raises(TypeError):
        sampling.create_sampler(path=USER_CODE, name="brevity")
    learned = sampling.SuccessCurriculum(seed=1, floor=0.0)
    for _ in range(3):
        learned.update(rows)  # tasks 0 and 1 always succeed, the others never
    learned.update(rows.where("task_id = 2").withColumn("success", F.lit(True)).limit(10).unionByName(rows.where("task_id = 2").limit(20)))
    weights = {r.task_id: r.weight for r in learned.weighted(rows).select("task_id", "weight").distinct().collect()}
    assert weights[2] == max(weights.values()) and weights[0] == pytest.approx(31 / 32 / 32)


def test_ragged(spark):
    lists = [[1, 2, 3], [], [4], [5, 6]]
    df = spark.createDataFrame([(lists,), ([],), ([[]],)], "l array<array<int>>").withColumn("x", ragged.from_lists(F.col("l")))
    x = F.col("x")
    r = df.select("x", ragged.count(x).alias("n"), ragged.to_lists(x).alias("l"), ragged.take(x, F.lit(1), F.lit(3)).alias("t"), ragged.to_padded(x, 0).alias("p"), ragged.split(x, 3).alias("s"), ragged.is_sound(x).alias("ok"), ragged.concat(x, x, x).alias("c")).collect()
    assert r[0].x.asDict() == {"values": [1, 2, 3, 4, 5, 6], "offsets": [0, 3, 3, 4, 6]} and [q.l for q in r] == [lists, [], [[]]] and [q.n for q in r] == [4, 0, 1] and all(q.ok for q in r)
    assert r[0].t.asDict() == {"values": [4], "offsets": [0, 0, 1]} and r[0].p == [[1, 2, 3], [0, 0, 0], [4, 0, 0], [5, 6, 0]] and [tuple(s.offsets) for s in r[0].s] == [(0, 3, 3, 4), (0, 2)] and r[1].s == []
    assert r[0].c.offsets == [0, 3, 3, 4, 6, 9, 9, 10, 12, 15, 15, 16, 18]
    back = df.limit(1).select(ragged.from_padded(ragged.to_padded(x, 0), ragged.lengths(x)).alias("y"), ragged.row(x, F.lit(3)).alias("last"), ragged.responses(x, F.array(F.lit(2), F.lit(0), F.lit(0), F.lit(1))).alias("r")).first()
    assert back.y.asDict() == r[0].x.asDict() and back["last"] == [5, 6] and back.r.asDict() == {"values": [1, 2, 5], "offsets": [0, 2, 2, 2, 3]}
    broken = spark.createDataFrame([(([1], [0, 2]),), (([1], [0, 1]),), (([1], [1, 1]),)], "x struct<values:array<int>,offsets:array<long>>")
    assert [q.ok for q in broken.select(ragged.is_sound(F.col("x")).alias("ok")).collect()] == [False, True, False]


def test_batches_are_added_once(spark, tmp_path):
    data = growing.GrowingDataset(spark, f"file://{tmp_path}/d", keep=lambda df: df.where("price < 100"))
    with pytest.raises(ValueError):
        data.read()
    rows = spark.createDataFrame([(1, 5.0, "x"), (2, 50.0, "y"), (3, 500.0, "z")], "row_id long, price double, text string")
    assert data.append(rows, 0) and not data.append(rows, 0)
    spark.range(1).withColumn("junk", F.lit(1)).write.parquet(f"{tmp_path}/d/data/batch={1:012d}")  # a writer that died before its marker
    snapshot = data.read()
    maker = growing.load_generator(USER_CODE, "Echo", below=10.0)
    assert data.grow(maker, 1) and not data.grow(maker, 1)
    assert snapshot.count() == 2 and sorted((r.row_id, r.price) for r in data.read().collect()) == [(1, 5.0), (1, 10.0), (2, 50.0)] and data.read(0).count() == 2
    with pytest.raises(TypeError):
        growing.load_generator(USER_CODE, "brevity")


def test_a_stream_that_starts_again(spark, tmp_path):
    source, data = f"{tmp_path}/in", growing.GrowingDataset(spark, f"file://{tmp_path}/out")
    spark.range(0, 10).write.parquet(f"{source}/a")
    stream = lambda: spark.readStream.schema("id long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(source)
    data.follow(stream(), f"{tmp_path}/check").awaitTermination(60)
    spark.range(10, 15).write.parquet(f"{source}/b")
    data.follow(stream(), f"{tmp_path}/check").awaitTermination(60)
    for batch in data.committed():  # and what a lost driver would do again
        assert not data.append(spark.range(3).toDF("id"), batch)
    assert sorted(r.id for r in data.read().collect()) == list(range(15))


def test_staleness_starts_anew_with_a_version(spark):
    kinds = ["put", "put", "get", "version", "put", "version", "put", "put"]
    e = spark.createDataFrame([("q", i, k, float(i * 10)) for i, k in enumerate(kinds)], "queue string, seq long, kind string, ts double")
    got = sample_queue.since_reset(e).orderBy("seq").collect()
    assert [r.waiting for r in got] == [1, 2, 1, 1, 2, 2, 3, 4] and [r.stale_samples for r in got] == [1, 2, 2, 1, 2, 2, 3, 4]
    assert [r.idle_ratio for r in got] == [None] * 5 + [pytest.approx(0.5)] + [None] * 2


def test_components_and_a_planted_leak(spark):
    rows = [(1, 0.0, None, None, None), (2, 1.0, '{"action_checks":[1]}', "x", "max_steps"), (3, None, '{"info":"still running","env_assertions":[0]}', "", "done"), (4, 0.0, "not json", "bad", "TRUNCATED"), (5, 0.0, '{"db_check":null,"nl_assertions":[]}', None, None)]
    df = spark.createDataFrame(rows, "i int, reward double, info string, err string, reason string")
    got = df.select(diagnostics.failed_components(F.col("info"), F.col("reward"), F.col("err"), F.col("reason")).alias("x")).collect()
    assert [r.x for r in got] == [["UNKNOWN"], [], ["ENV", "TERMINATION"], ["ACTION", "TERMINATION"], ["UNKNOWN"]]
    texts = spark.createDataFrame([(1, "all is well"), (2, None), (3, "the Ground_Truth is 5, ground_truth!")], "k long, t string")
    diagnostics.assert_no_leak(texts.where("k < 3"), "t", "k")
    with pytest.raises(ValueError, match="ground_truth"):
        diagnostics.assert_no_leak(texts, "t", "k")
    patterns = spark.createDataFrame([("is",), ("IS WELL",), ("",), (None,)], "pattern string")
    assert sorted(tuple(r) for r in diagnostics.leaks(texts, patterns, "t", "k").collect()) == [(1, "is", 1), (1, "is well", 1), (3, "is", 1)]
    with pytest.raises(ValueError):
        diagnostics.leaks(texts, patterns, "t", "k", most=3)
    assert diagnostics.leaks(texts, patterns.where("false"), "t", "k").collect() == []
    with pytest.raises(ValueError):
        diagnostics.render_feedback("loud", *[F.lit("")] * 6)
