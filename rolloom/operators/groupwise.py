"""Statistics over groups of samples, put back on every sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import number_rows


def group_stats(df: DataFrame, score: str, uid: str = "uid", eps: float | None = 1e-6) -> DataFrame:
    """Add ``g_mean, g_std, g_n``. A group of one has mean 0 and deviation 1; with ``eps``
    the (sample) variance is at least that, without it is used as it is."""
    w = Window.partitionBy(uid)
    n = F.count(score).over(w)
    spread = F.var_samp(score).over(w)
    spread = F.sqrt(F.greatest(spread, F.lit(eps))) if eps is not None else F.sqrt(spread)
    return df.withColumns({"g_n": n, "g_mean": F.when(n > 1, F.avg(score).over(w)).otherwise(0.0), "g_std": F.when(n > 1, spread).otherwise(1.0)})


def dense_group_ids(df: DataFrame, uid: str = "uid", to: str = "gid") -> DataFrame:
    """Numbers 0, 1, ... of the groups in the order of their keys."""
    keys = number_rows(df.select(F.col(uid).alias("__uid")).distinct(), "__uid")
    return df.join(keys.select(F.col("__uid").alias(uid), F.col("row_id").alias(to)), uid)


def global_masked_moments(tokens: DataFrame, value: str, mask: str = "mask") -> DataFrame:
    """One row ``m_mean, m_var, m_n`` over all tokens of a long table.

    The mean carries 1e-8 in its divisor; so does the mean of squared deviations, which
    are taken from that mean; then n / (n - 1)."""
    inside = F.when(F.col(mask) != 0, F.col(value) * F.col(mask))
    first = tokens.agg((F.sum(inside) / (F.sum(mask) + 1e-8)).alias("m_mean"), F.sum(mask).alias("m_n"))
    # deviations in a second pass, as the difference of sums cancels where means are large
    away = F.when(F.col(mask) != 0, F.pow(F.col(value) - F.col("m_mean"), 2) * F.col(mask))
    both = tokens.select(value, mask).join(F.broadcast(first)).agg(F.first("m_mean").alias("m_mean"), F.first("m_n").alias("m_n"), F.sum(away).alias("square"))
    var = F.col("square") / (F.col("m_n") + 1e-8) * F.col("m_n") / (F.col("m_n") - 1)
    checked = F.when(F.col("m_n") < 2, F.raise_error(F.lit("a variance needs two tokens within the mask"))).otherwise(var)
    return both.select("m_mean", checked.alias("m_var"), "m_n")


def global_masked_mean(tokens: DataFrame, value: str, mask: str = "mask") -> DataFrame:
    """One row ``mean``: over all tokens of the mask, without anything in the divisor; null
    where the mask is empty."""
    n = F.sum(mask)
    return tokens.agg(F.when(n != 0, F.sum(F.col(value) * F.col(mask)) / n).alias("mean"))


def global_extent(df: DataFrame, value: str, largest: bool = True, smallest: bool = True, deviation: bool = True) -> DataFrame:
    """One row ``mean, max, min, std`` (sample deviation) over all rows; those that are not
    asked for are null."""
    of = lambda wanted, c: (c if wanted else F.lit(None).cast("double"))
    return df.agg(F.avg(value).alias("mean"), of(largest, F.max(value)).alias("max"), of(smallest, F.min(value)).alias("min"), of(deviation, F.stddev_samp(value)).alias("std"))


def whiten(tokens: DataFrame, value: str, mask: str = "mask", shift_mean: bool = True) -> DataFrame:
    """Replace ``value`` by (value - mean) / sqrt(variance + 1e-8) of the whole batch."""
    moments = global_masked_moments(tokens, value, mask)  # one row
    white: Column = (F.col(value) - F.col("m_mean")) / F.sqrt(F.col("m_var") + 1e-8)
    white = white if shift_mean else white + F.col("m_mean")
    return tokens.join(F.broadcast(moments)).withColumn(value, white).drop("m_mean", "m_var", "m_n")
