"""Corrections for data drawn by another policy: rejection masks, importance weights and
the metrics of both. Input is a long table of tokens ``row_id, t, mask, log_ratio``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.divergence import clamp
from .losses import mean_over_mask

BOUND = 20.0
OPTIONS = ("token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3")


def _number(text: str, what: str) -> float:
    try:
        value = float(text)
    except ValueError as e:
        raise ValueError(f"{what}: {text!r} is no number") from e
    if value <= 0:
        raise ValueError(f"{what}: bounds must be positive")
    return value


def weight_band(spec: str | float) -> tuple[float, float | None]:
    """(upper, lower) from a number, or from "lower_upper"."""
    if isinstance(spec, bool) or not isinstance(spec, int | float | str):
        raise TypeError("a threshold is a number or a text")
    low, _, high = str(spec).strip().rpartition("_") if isinstance(spec, str) else ("", "", str(spec))
    if isinstance(spec, str) and "_" in spec:
        low, high = spec.strip().split("_", 1)
    upper = _number(high, "weight threshold")
    lower = _number(low, "weight threshold") if low else None
    if lower is not None and lower > upper:
        raise ValueError("the lower bound is above the upper one")
    return upper, lower


def rejection_bands(options: Sequence[str], spec: str | float | None) -> dict[str, tuple[float | None, float]]:
    """(lower, upper) by option. k1 options take two bounds (one: its inverse is the
    lower), the others an upper one; one spec may serve all options."""
    if spec is None:
        raise ValueError("rejection needs a threshold")
    if isinstance(spec, bool) or not isinstance(spec, int | float | str):
        raise TypeError("a threshold is a number or a text")
    parts = [p.strip() for p in str(spec).split(",") if p.strip()]
    if len(parts) not in (1, len(options)) or not parts:
        raise ValueError(f"one threshold is needed, or {len(options)}")
    out: dict[str, tuple[float | None, float]] = {}
    for option, part in zip(options, parts * len(options) if len(parts) == 1 else parts, strict=False):
        if option.endswith("k1"):
            low, high = part.split("_", 1) if "_" in part else (None, part)
            upper = _number(high, option)
            out[option] = (1 / upper if low is None else _number(low, option), upper)
        elif "_" in part:
            raise ValueError(f"{option} takes an upper bound only")
        else:
            out[option] = (None, _number(part, option))
    return out


def _statistic(option: str, order: Sequence[str] = ()) -> Column:
    """The statistic on each token; sequence statistics are windows over the row. Sums go
    along ``order``, as the order of terms decides how they round and so, at a bound, what stays."""
    x = clamp(F.col("log_ratio"), -BOUND, BOUND)
    token = {"k1": -x, "k2": x * x * 0.5, "k3": F.exp(x) - 1 - x}[option[-2:]]
    if option.startswith("token"):
        return token
    row = Window.partitionBy("row_id")
    row = row.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if order else row
    inside = F.when(F.col("mask") != 0, token)
    if option.startswith("seq_max"):
        return F.coalesce(F.max(inside).over(row), F.lit(0.0))
    total = F.coalesce(F.sum(inside).over(row), F.lit(0.0))
    return total / (F.sum("mask").over(row) + 1e-8) if option.startswith("seq_mean") else total


def _kept(option: str, band: tuple[float | None, float]) -> Column:
    stat = F.col(f"__{option}")
    if option.endswith("k1"):
        return stat.between(math.log(band[0]), math.log(band[1]))
    return stat <= band[1]


def _with_statistics(tokens: DataFrame, options: str | Sequence[str], threshold) -> tuple[DataFrame, dict[str, Column]]:
    chosen = list(dict.fromkeys(o.strip() for o in (options.split(",") if isinstance(options, str) else options) if o.strip()))
    if not chosen or (unknown := set(chosen) - set(OPTIONS)):
        raise ValueError(f"unknown rejection options: {sorted(unknown) if chosen else 'none given'}")
    bands = rejection_bands(chosen, threshold)
    order = ["t"] if "t" in tokens.columns else []
    return tokens.withColumns({f"__{o}": _statistic(o, order) for o in chosen}), {o: _kept(o, bands[o]) for o in chosen}


def rejection_mask(tokens: DataFrame, options: str | Sequence[str] = "token_k1", threshold: str | float | None = None) -> DataFrame:
    """``mask`` less the tokens that fail any of the options."""
    out, kept = _with_statistics(tokens, options, threshold)
    keep = None
    for k in kept.values():
        keep = k if keep is None else keep & k
    return out.withColumn("mask", F.when(keep, F.col("mask")).otherwise(0)).drop(*[f"__{o}" for o in kept])


def rejection_metrics(tokens: DataFrame, options: str | Sequence[str], threshold: str | float | None) -> DataFrame:
    """Per option: mean, extremes and share of rejected tokens and sequences, long form
    ``option, stat_mean, stat_max, stat_min, masked_fraction, seq_masked_fraction``."""
    out, kept = _with_statistics(tokens, options, threshold)
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("option"), F.col(f"__{o}").alias("stat"), k.alias("kept")) for o, k in kept.items()]))
    long = out.where("mask > 0").select("row_id", each.alias("o")).select("row_id", "o.*")
    rows = long.groupBy("option", "row_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stat").alias("s"), F.max("stat").alias("hi"), F.min("stat").alias("lo"), F.count_if(~F.col("kept")).alias("out"))
    return rows.groupBy("option").agg(
        (F.sum("s") / F.sum("n")).alias("stat_mean"), F.max("hi").alias("stat_max"), F.min("lo").alias("stat_min"), (F.sum("out") / F.sum("n")).alias("masked_fraction"), F.avg((F.col("out") > 0).cast("double")).alias("seq_masked_fraction")
    )


def importance_weights(tokens: DataFrame, level: str = "token", threshold: str | float = 2.0, normalise: bool = False) -> DataFrame:
    """Add ``raw_weight`` and ``weight``: truncated at the upper bound or, with a band, zero
    outside it; with ``normalise`` divided by the batch mean."""
    upper, lower = weight_band(threshold)
    if level == "token":
        x = F.col("log_ratio")
    elif level == "sequence":
        x = F.coalesce(F.sum(F.when(F.col("mask") != 0, F.col("log_ratio"))).over(Window.partitionBy("row_id")), F.lit(0.0))
    else:
        raise ValueError(f"unknown level {level!r}")
    out = tokens.withColumn("raw_weight", F.exp(clamp(x, -BOUND, BOUND)) * F.col("mask"))
    raw = F.col("raw_weight")
    out = out.withColumn("weight", F.least(raw, F.lit(upper)) if lower is None else F.when(raw.between(lower, upper), raw).otherwise(0.0))
    if not normalise:
        return out
    if level == "token":
        mean = out.agg(mean_over_mask(F.col("weight")).alias("__m"))
    else:
        mean = out.groupBy("row_id").agg(mean_over_mask(F.col("weight")).alias("w"), F.sum("mask").alias("n")).agg((F.sum(F.when(F.col("n") > 0, F.col("w"))) / F.greatest(F.count_if(F.col("n") > 0), F.lit(1e-8))).alias("__m"))
    return out.join(F.broadcast(mean)).withColumn("weight", F.when(F.col("__m") > 1e-8, F.col("weight") / F.col("__m")).otherwise(F.col("weight"))).drop("__m")


def weight_metrics(tokens: DataFrame, threshold: str | float = 2.0) -> DataFrame:
    """One row over tokens with ``raw_weight, weight`` (level token): mean, deviation,
    extremes, effective sample size, shares beyond the bounds, and of sequence means."""
    upper, lower = weight_band(threshold)
    lower = 1 / upper if lower is None else lower
    w, raw = F.col("weight"), F.col("raw_weight")
    held = clamp(w, 0.0, upper)
    inside = F.col("mask") != 0
    one = tokens.agg(
        mean_over_mask(w).alias("is_mean"), F.max(F.when(inside, w)).alias("is_max"), F.min(F.when(inside, w)).alias("is_min"),
        mean_over_mask((raw > upper).cast("double")).alias("fraction_high"), mean_over_mask((raw < lower).cast("double")).alias("fraction_low"),
        mean_over_mask(held).alias("m1"), mean_over_mask(held * held).alias("m2"),
    )
    one = one.withColumn("is_std", F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0)))).withColumn("eff_sample_size", F.pow(F.col("m1") + 1e-8, F.lit(2)) / F.col("m2")).drop("m1", "m2")
    rows = tokens.groupBy("row_id").agg(mean_over_mask(w).alias("s"))
    seq = rows.agg(
        F.avg("s").alias("seq_mean"), F.stddev_samp("s").alias("seq_std"), F.max("s").alias("seq_max"), F.min("s").alias("seq_min"), F.max(F.abs(F.col("s") - 1)).alias("seq_max_deviation"),
        F.avg((F.col("s") > upper).cast("double")).alias("seq_fraction_high"), F.avg((F.col("s") < lower).cast("double")).alias("seq_fraction_low"),
    )
    return one.join(F.broadcast(seq))


def offpolicy_metrics(tokens: DataFrame, train: str = "old_logp", rollout: str = "rollout_logp") -> DataFrame:
    """One row: perplexities of both policies, their divergences and chi-squared."""
    x = F.col(train) - F.col(rollout)
    rows = tokens.groupBy("row_id").agg(
        mean_over_mask(F.col(train)).alias("t"), mean_over_mask(F.col(rollout)).alias("r"), F.coalesce(F.sum(F.when(F.col("mask") != 0, x)), F.lit(0.0)).alias("x"),
        F.sum("mask").alias("n"), F.sum(F.when(F.col("mask") != 0, -x)).alias("kl"), F.sum(F.when(F.col("mask") != 0, F.exp(x) - x - 1)).alias("k3"),
        F.sum(F.when(F.col("mask") != 0, F.exp(2 * clamp(x, -BOUND, BOUND)))).alias("sq"),
    )
    gap, n = F.col("r") - F.col("t"), F.sum("n") + 1e-8
    return rows.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"), F.avg(-F.col("t")).alias("training_log_ppl"), (F.sum("kl") / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"), F.avg(gap).alias("log_ppl_diff"), F.avg(F.abs(gap)).alias("log_ppl_abs_diff"),
        F.max(gap).alias("log_ppl_diff_max"), F.min(gap).alias("log_ppl_diff_min"), F.avg(F.exp(gap)).alias("ppl_ratio"), (F.sum("sq") / n - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * clamp(F.col("x"), -BOUND, BOUND))) - 1).alias("chi2_seq"),
    )


def correct(tokens: DataFrame, weights: dict | None = None, reject: dict | None = None) -> DataFrame:
    """Weights from the full mask, then the mask less what is rejected."""
    out = importance_weights(tokens, **weights) if weights else tokens
    return rejection_mask(out, **reject) if reject else out


def bypass_columns(batch: DataFrame) -> DataFrame:
    """Take the rollout policy's log-probabilities for the old policy's."""
    return batch.withColumn("old_log_probs", F.col("rollout_log_probs"))
