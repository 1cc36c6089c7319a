"""Native operators with odd columns, empty tables and many rows of one kind."""

from pyspark.sql import functions as F

from rolloom.llm import sharding, url_filter


def test_places_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x", "y", "z"), (None, None, "y", "z")], "doc_id long, __slot string, __slot0 string, slot string")
    got = sharding.place(df, ["a", "b"])
    assert set(got.columns) == {"doc_id", "__slot", "__slot0", "slot", "shard"} and sorted(r["__slot"] or "" for r in got.collect()) == ["", "x"]
    assert sharding.place(df.where("false"), ["a"]).collect() == []


def test_many_urls_without_a_host_and_long_ones(spark):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise("no scheme").alias("url"), F.lit("x").alias("rule"), F.lit("y").alias("path"))
    long = spark.createDataFrame([(1000, "http://a.com/en/" + "x" * 100_000, "", "")], "page_id long, url string, rule string, path string")
    rules = spark.createDataFrame([("com", "/en/", "block")], url_filter.RULE_SCHEMA)
    got = url_filter.judge_urls(pages.unionByName(long), rules).collect()
    assert len(got) == 501 and [r.page_id for r in got if r.verdict == "block"] == [1000]
    assert all(r.host == "" and r.rule is None for r in got if r.page_id < 500)
