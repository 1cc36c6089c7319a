"""Training tables made from the provided ones, whole tables each time.

``tokens``: a sequence for each (user, event type), a token for each event, in order of
time; ``samples``: a sample for each order line, grouped by order; ``rollouts``: tokens
as arrays, a row a sequence. Each has a SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = ("click", "error", "purchase", "signup", "view")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type"))
    i = F.col("event_id")
    return e.select(
        (F.col("user_id") * 10 + kind).alias("row_id"),
        F.col("user_id").alias("uid"),
        (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1).cast("long").alias("t"),
        F.when(i % 7 != 0, 1).otherwise(0).alias("mask"),
        (F.col("value") / 97.3).alias("reward"),
        (F.col("value") / 191.7).alias("value"),
        ((F.col("value") - 40) / 50).alias("advantage"),
        (-0.05 - (i % 13) / 10.0).alias("logp"),
        (-0.05 - (i % 11) / 10.0).alias("old_logp"),
        (-0.05 - (i % 17) / 16.0).alias("rollout_logp"),
        (0.1 + (i % 5) / 20.0).alias("sum_pi2"),
    )


TOKENS_SQL = """tok AS (
    SELECT user_id * 10 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS row_id, user_id AS uid,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t,
           CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END AS mask, value / 97.3::DOUBLE AS reward, value / 191.7::DOUBLE AS value, (value - 40) / 50 AS advantage,
           -0.05::DOUBLE - (event_id % 13) / 10.0::DOUBLE AS logp, -0.05::DOUBLE - (event_id % 11) / 10.0::DOUBLE AS old_logp,
           -0.05::DOUBLE - (event_id % 17) / 16.0::DOUBLE AS rollout_logp, 0.1::DOUBLE + (event_id % 5) / 20.0::DOUBLE AS sum_pi2
    FROM events)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("mask", "reward", "value", "logp", "old_logp")
    rows = tokens(spark, sf_dir).groupBy("row_id", "uid").agg(F.array_sort(F.collect_list(F.struct("t", *cols))).alias("a"))
    return rows.select("row_id", "uid", *[F.col("a")[c].alias(f"{c}s") for c in cols])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("uid"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("row_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1234.567).alias("score"),
        (F.col("l_tax") * 10).alias("bonus"), F.col("l_quantity").alias("n"),
    )


SAMPLES_SQL = """smp AS (
    SELECT l_orderkey AS uid, l_orderkey * 100000 + l_partkey AS row_id, l_extendedprice * (1 - l_discount) / 1234.567::DOUBLE AS score,
           l_tax * 10 AS bonus, l_quantity AS n FROM lineitem)"""


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch: orders, numbered by their keys, which run from 0 without gaps."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


ORDERS_SQL = "ord AS (SELECT o_orderkey AS row_id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders)"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, with -0.0 made 0.0, so that results compare by value."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
