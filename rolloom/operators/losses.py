"""Policy and value losses as analytics: forward values and their metrics.

Input is a long table of tokens: ``row_id, t, mask, logp, old_logp, advantage`` and,
optionally, importance weights ``weight``. A loss is a column expression over a token
(some need a mean of their sequence first), so one pass gives ``loss`` and ``metrics``;
only sequence means shuffle, by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.divergence import clamp, importance_ratio

LOSSES: dict[str, Callable] = {}
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


def policy_loss(name: str):
    """Register a loss; a later one of the same name takes its place."""

    def add(fn: Callable) -> Callable:
        LOSSES[name] = fn
        return fn

    return add


def get_loss(name: str) -> Callable:
    if name not in LOSSES:
        raise ValueError(f"unsupported loss {name!r}; there are {sorted(LOSSES)}")
    return LOSSES[name]


def _inside(value: Column) -> Column:
    return F.when(F.col("mask") != 0, value * F.col("mask"))


def mean_over_mask(value: Column) -> Column:
    """An aggregate: masked mean with 1e-8 in the divisor."""
    return F.coalesce(F.sum(_inside(value.cast("double"))), F.lit(0.0)) / (F.sum("mask") + 1e-8)


def aggregate_loss(tokens: DataFrame, loss: str = "loss", mode: str = "token-mean", factor: float | None = None) -> DataFrame:
    """One row ``loss``. Sequences without any token don't count."""
    if mode == "token-mean":
        return tokens.agg((F.sum(_inside(F.col(loss))) / F.sum("mask")).alias("loss"))
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    rows = tokens.groupBy("row_id").agg(F.coalesce(F.sum(_inside(F.col(loss))), F.lit(0.0)).alias("s"), F.sum("mask").alias("n"), F.count(F.lit(1)).alias("width"))
    value = F.col("s") / (F.col("n") + 1e-8) if mode == "seq-mean-token-mean" else F.col("s")
    out = F.sum(F.when(F.col("n") > 0, value)) / F.count_if(F.col("n") > 0)
    if mode == "seq-mean-token-sum-norm":
        out = out / (F.lit(float(factor)) if factor is not None else F.max("width"))
    return rows.agg(out.alias("loss"))


def _result(tokens: DataFrame, loss: Column, mode: str, metrics: dict[str, Column], weighted: bool = True) -> DataFrame:
    if weighted and "weight" in tokens.columns:
        loss = loss * F.col("weight")
    scored = tokens.withColumn("__loss", loss)
    if not metrics:
        return aggregate_loss(scored, "__loss", mode)
    told = scored.agg(*[mean_over_mask(m).alias(k) for k, m in metrics.items()])
    return aggregate_loss(scored, "__loss", mode).join(F.broadcast(told))  # a row each


A, LOGP, OLD = F.col, "logp", "old_logp"


@policy_loss("vanilla")
def ppo_clip(tokens: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0, mode: str = "token-mean") -> DataFrame:
    adv, ratio = A("advantage"), importance_ratio(A(LOGP), A(OLD))
    plain, cut = -adv * ratio, -adv * clamp(ratio, 1 - low, 1 + high)
    worst, bound = F.greatest(plain, cut), -adv * dual
    loss = F.when(adv < 0, F.least(bound, worst)).otherwise(worst)
    gap = clamp(A(LOGP) - A(OLD), -20, 20)
    return _result(tokens, loss, mode, {"pg_clipfrac": cut > plain, "ppo_kl": -gap, "pg_clipfrac_lower": (worst > bound) & (adv < 0)})


def _trusted(tokens: DataFrame, good: Column, dual: float, mode: str) -> DataFrame:
    ratio = importance_ratio(A(LOGP), A(OLD))
    loss = F.when(good, -A("advantage") * F.least(ratio, F.lit(dual)) * A(LOGP)).otherwise(0.0)
    gap = clamp(A(LOGP) - A(OLD), -20, 20)
    return _result(tokens, loss, mode, {"pg_clipfrac": ~good, "ppo_kl": -gap, "pg_clipfrac_lower": (ratio > dual) & good})


@policy_loss("dppo_tv")
def trust_by_variation(tokens: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 20.0, mode: str = "token-mean") -> DataFrame:
    moved = F.exp(LOGP) - F.exp(OLD)
    return _trusted(tokens, F.when(A("advantage") > 0, moved <= high).otherwise(moved >= -low), dual, mode)


@policy_loss("dppo_kl")
def trust_by_binary_kl(tokens: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 20.0, mode: str = "token-mean") -> DataFrame:
    p, q = F.exp(LOGP), F.exp(OLD)
    kl = q * (A(OLD) - A(LOGP)) + (1 - q) * F.log((1 - q + 1e-8) / (1 - p + 1e-8))
    return _trusted(tokens, F.when(A("advantage") > 0, (kl <= high) | (p <= q)).otherwise((kl <= low) | (p >= q)), dual, mode)


def _sequence_mean(tokens: DataFrame, value: Column, least: float | None = None) -> Column:
    w = Window.partitionBy("row_id")
    n = F.sum("mask").over(w)
    n = F.greatest(n, F.lit(least)) if least is not None else n + 1e-8
    return F.coalesce(F.sum(_inside(value)).over(w), F.lit(0.0)) / n


@policy_loss("gspo")
def sequence_ratio(tokens: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "seq-mean-token-mean") -> DataFrame:
    """Ratio of the whole sequence (geometric mean); always averaged by sequence."""
    out = tokens.withColumn("__seq", F.exp(F.least(_sequence_mean(tokens, A(LOGP) - A(OLD), 1.0), F.lit(10.0))))
    plain, cut = -A("advantage") * A("__seq"), -A("advantage") * clamp(A("__seq"), 1 - low, 1 + high)
    return _result(out, F.greatest(plain, cut), "seq-mean-token-mean", {"pg_clipfrac": cut > plain, "ppo_kl": A(OLD) - A(LOGP), "pg_clipfrac_lower": F.lit(0.0)})


@policy_loss("sapo")
def soft_gate(tokens: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05, mode: str = "seq-mean-token-mean") -> DataFrame:
    tau = F.when(A("advantage") > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    gate = 4.0 / tau / (1 + F.exp(-tau * (importance_ratio(A(LOGP), A(OLD)) - 1)))
    gap = clamp(A(LOGP) - A(OLD), -20, 20)
    return _result(tokens, -gate * A("advantage"), "seq-mean-token-mean", {"pg_clipfrac": F.lit(0.0), "ppo_kl": -gap, "pg_clipfrac_lower": F.lit(0.0)})


@policy_loss("gpg")
def plain_gradient(tokens: DataFrame, mode: str = "token-mean") -> DataFrame:
    return _result(tokens, -A(LOGP) * A("advantage"), mode, {})


def _covariance(tokens: DataFrame) -> DataFrame:
    means = tokens.agg(mean_over_mask(A("advantage")).alias("__ma"), mean_over_mask(A(LOGP)).alias("__ml"))  # one row
    return tokens.join(F.broadcast(means)).withColumn("__cov", (A("advantage") - A("__ma")) * (A(LOGP) - A("__ml")))


@policy_loss("clip_cov")
def clip_by_covariance(tokens: DataFrame, ratio: float = 0.0002, lb: float = 1.0, ub: float = 5.0, low: float = 0.2, high: float = 0.2, seed: int = 0, mode: str = "token-mean") -> DataFrame:
    """Tokens whose covariance lies in (lb, ub): a random few of them don't count. The
    choice is by a seeded hash, so reruns agree."""
    out = _covariance(tokens)
    r = F.exp(A(LOGP) - A(OLD))
    plain, cut = -A("advantage") * r, -A("advantage") * clamp(r, 1 - low, 1 + high)
    fits = (A("mask") > 0) & ~(cut > plain) & (A("__cov") > lb) & (A("__cov") < ub)
    most = max(int(ratio * (tokens.agg(F.sum("mask")).first()[0] or 0)), 1)
    chosen = out.where(fits).select("row_id", "t").orderBy(F.xxhash64(F.lit(seed), "row_id", "t"), "row_id", "t").limit(most).withColumn("__out", F.lit(True))
    out = out.join(chosen, ["row_id", "t"], "left")
    gone = A("__out").isNotNull()
    return _result(out, F.when(gone, 0.0).otherwise(F.greatest(plain, cut)), mode, {"pg_clipfrac": gone, "ppo_kl": A(OLD) - A(LOGP)})


@policy_loss("kl_cov")
def penalise_by_covariance(tokens: DataFrame, ratio: float = 0.0002, coef: float = 1.0, mode: str = "token-mean") -> DataFrame:
    """The tokens of largest covariance get a divergence term (ties: by row and place)."""
    valid = tokens.where("mask > 0").agg(F.count("*").alias("n"), F.avg("advantage").alias("__ma"), F.avg(LOGP).alias("__ml"))
    most = max(1, int(valid.first()["n"] * ratio))
    out = tokens.join(F.broadcast(valid.drop("n"))).withColumn("__cov", (A("advantage") - A("__ma")) * (A(LOGP) - A("__ml")))
    top = out.where("mask > 0").orderBy(F.desc("__cov"), "row_id", "t").limit(most).select("row_id", "t", F.lit(True).alias("__top"))
    out = out.join(top, ["row_id", "t"], "left")
    gap = A(LOGP) - A(OLD)
    loss = -A("advantage") * F.exp(gap) + F.when(A("__top"), coef * F.abs(gap)).otherwise(0.0)
    return _result(out, loss, mode, {"ppo_kl": F.abs(gap)})


@policy_loss("geo_mean")
def geometric_mean(tokens: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean") -> DataFrame:
    """Geometric mean of ratios clipped by the sign of the advantage; mean over sequences."""
    gap, sign = A(LOGP) - A(OLD), F.signum("advantage")
    cut = clamp(gap, -low, high)
    kept = sign * F.least(sign * gap, sign * cut)
    sums = {"k": kept, "a": A("advantage")}
    if "weight" in tokens.columns:
        sums["w"] = F.log(A("weight") + 1e-10)
    rows = tokens.groupBy("row_id").agg(*[(F.coalesce(F.sum(_inside(v)), F.lit(0.0)) / (F.sum("mask") + 1e-8)).alias(k) for k, v in sums.items()])
    loss = -A("a") * F.exp("k")
    loss = loss * F.exp("w") if "w" in sums else loss
    told = tokens.agg(mean_over_mask((gap != cut) & (A("advantage") > 0)).alias("pg_clipfrac"), mean_over_mask(-gap).alias("ppo_kl"), mean_over_mask((gap != cut) & (A("advantage") < 0)).alias("pg_clipfrac_lower"))
    return rows.agg(F.avg(loss).alias("loss")).join(F.broadcast(told))


@policy_loss("cispo")
def clipped_weights(tokens: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean") -> DataFrame:
    ratio = importance_ratio(A(LOGP), A(OLD))
    cut = clamp(ratio, 1 - low, 1 + high)
    gap = clamp(A(LOGP) - A(OLD), -20, 20)
    return _result(tokens, -cut * A("advantage") * A(LOGP), mode, {"pg_clipfrac": ratio != cut, "ppo_kl": -gap, "pg_clipfrac_lower": F.lit(0.0)})


@policy_loss("reinforce")
def reinforce(tokens: DataFrame, mode: str = "seq-mean-token-sum") -> DataFrame:
    return _result(tokens, -A("advantage") * A(LOGP), mode, {"ppo_kl": A(OLD) - A(LOGP)})


def bypass(tokens: DataFrame, kind: str = "ppo_clip", reject: dict | None = None, weights: dict | None = None, mode: str = "token-mean", **options) -> DataFrame:
    """Rejection and, for ``reinforce``, importance weights from (logp, old_logp), then the
    loss. The clipped loss takes no weights: its ratio already is one."""
    from .correction import importance_weights, rejection_mask

    out = tokens
    ready = out.withColumn("log_ratio", A(LOGP) - A(OLD))
    if reject:
        ready = rejection_mask(ready, **reject)
    if kind == "reinforce":
        if weights:
            ready = importance_weights(ready, **weights)
        return reinforce(ready, mode)
    if kind != "ppo_clip":
        raise ValueError(f"unknown kind {kind!r}")
    return ppo_clip(ready.drop("weight"), mode=mode, **options)


def value_loss(tokens: DataFrame, cliprange: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """Half the larger of two squared errors: of ``vpred``, and of it held near ``value``."""
    held = F.greatest(F.least(A("vpred"), A("value") + cliprange), A("value") - cliprange)
    plain, cut = F.pow(A("vpred") - A("returns"), F.lit(2)), F.pow(held - A("returns"), F.lit(2))
    out = _result(tokens, F.greatest(plain, cut), mode, {"vf_clipfrac": cut > plain}, weighted=False)
    return out.withColumn("loss", A("loss") * 0.5)


def entropy_loss(tokens: DataFrame, entropy: str = "entropy", mode: str = "token-mean") -> DataFrame:
    return aggregate_loss(tokens, entropy, mode)


def sft_loss(tokens: DataFrame, shifted: bool = True) -> DataFrame:
    """Negative log-likelihood a token. With ``shifted`` the mask of the next token tells
    whether a prediction counts."""
    if shifted:
        tokens = tokens.withColumn("mask", F.coalesce(F.lead("mask").over(Window.partitionBy("row_id").orderBy("t")), F.lit(0)))
    return tokens.agg((-F.sum(_inside(A(LOGP))) / F.sum("mask")).alias("loss"))


def distillation_loss(tokens: DataFrame, kind: str = "k1", most: float | None = None, mode: str = "token-mean") -> DataFrame:
    """Divergence of the student's token log-probabilities from the teacher's (``teacher``),
    aggregated, with its masked extremes."""
    from ..functions.divergence import kl

    each = kl(A(LOGP), A("teacher"), kind)
    each = F.least(each, F.lit(most)) if most is not None else each
    out = tokens.withColumn("__loss", each)
    ends = out.agg(F.min(F.when(A("mask") != 0, A("__loss"))).alias("loss_min"), F.max(F.when(A("mask") != 0, A("__loss"))).alias("loss_max"))
    return aggregate_loss(out, "__loss", mode).join(F.broadcast(ends))


def topk_forward_kl(tokens: DataFrame, loss: str = "loss", student: str = "student_mass", teacher: str = "teacher_mass") -> tuple[DataFrame, DataFrame]:
    """Tokens with the loss over the likeliest tokens made no less than 0 (what such a part
    of two distributions gives may be negative), and one row of how much of each
    distribution the part holds, over the mask: mean, min and max."""
    told = [f(_inside(F.col(c))).alias(f"{c}{name}") for c in (student, teacher) for f, name in ((F.avg, ""), (F.min, "_min"), (F.max, "_max"))]
    return tokens.withColumn(loss, F.greatest(F.lit(0.0), F.col(loss))), tokens.agg(*told)
