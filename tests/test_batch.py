import pytest
from pyspark.sql import functions as F

from rolloom.operators import batch


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"v{i}") for i in range(6)], "row_id long, v string")


def listed(df, *cols):
    return [tuple(r) for r in df.orderBy("row_id").select(*(cols or ("v",))).collect()]


def test_order_of_repeats(rows):
    two = rows.where("row_id < 2")
    assert [v for (v,) in listed(batch.repeat(two, 2, True))] == ["v0", "v0", "v1", "v1"]
    assert [v for (v,) in listed(batch.repeat(two, 2, False))] == ["v0", "v1", "v0", "v1"]


def test_take_slice_and_negative_bounds(rows):
    assert [v for (v,) in listed(batch.take(rows, [4, 0, 4, -1]))] == ["v4", "v0", "v4", "v5"]
    assert [v for (v,) in listed(batch.slice_rows(rows, -4, None, 2))] == ["v2", "v4"]


def test_padding_wraps_and_unpads(rows):
    padded, n = batch.pad_to_divisor(rows, 13)
    assert n == 7 and [v for (v,) in listed(padded)][6:] == ["v0", "v1", "v2", "v3", "v4", "v5", "v0"]
    assert batch.same(batch.unpad(padded, n), rows)


def test_union_checks_shared_columns(rows):
    other = rows.select("row_id", "v", F.col("row_id").alias("w"))
    assert listed(batch.union(rows, other), "v", "w")[5] == ("v5", 5)
    with pytest.raises(Exception, match="differ"):
        batch.union(rows, other.withColumn("v", F.lit("x"))).collect()


def test_chunks_must_be_even(rows):
    with pytest.raises(ValueError):
        batch.chunk(rows, 4)
    assert batch.chunk(rows, 4, padding=True).count() == 8
    assert [c for (c,) in listed(batch.chunk(rows, 3), "chunk")] == [0, 0, 1, 1, 2, 2]


def test_fold_round_trip(rows):
    assert batch.same(batch.unfold(batch.fold(rows, 2)), rows)


def test_minibatches_cover_each_epoch(rows):
    got = batch.minibatches(rows, 2, 3, seed=5).groupBy("epoch", "minibatch").count().collect()
    assert len(got) == 9 and all(r["count"] == 2 for r in got)


def test_meta(rows):
    assert batch.merge_meta([{"a": 1, "metrics": {"x": 1}}, {"a": 1, "metrics": [{"x": 2}]}]) == {"a": 1, "metrics": {"x": [1, 2]}}
    with pytest.raises(ValueError):
        batch.merge_meta([{"a": 1}, {"a": 2}])


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = batch.number_rows(df, "k").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(1000)) and [r.k for r in got] == list(range(1000))


def test_pop_and_rename(rows):
    taken, rest = batch.pop(rows, ["v"])
    assert taken.columns == ["row_id", "v"] and rest.columns == ["row_id"]
    with pytest.raises(KeyError):
        batch.pop(rows, ["none"])
    with pytest.raises(ValueError):
        batch.rename(rows, ["v"], ["a", "b"])
