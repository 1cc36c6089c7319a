"""Distillation: divergences of a student's tokens from a teacher's, as a loss of their own or
as rewards of a policy loss.

Tokens are a long table as in ``losses``. A divergence is registered by name and gives a
column for each token and aggregates to report. The likeliest tokens of teacher and student
are sparse: arrays of ids with log-probabilities (teacher) or logits (student), which meet
by id within the row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.divergence import clamp, kl
from ..functions.tokens import log_sum_exp
from .losses import aggregate_loss, get_loss

#: name -> function of options that gives the token's divergence and what is reported of it
#: (name -> function of a column and an aggregate over the mask).
DIVERGENCES: dict[str, Callable[..., tuple[DataFrame, Column, dict[str, Column]]]] = {}


def divergence(*names: str):
    """Register a divergence; a name that is taken raises."""

    def add(fn: Callable) -> Callable:
        for n in names:
            if n in DIVERGENCES:
                raise ValueError(f"divergence {n!r} is already there")
            DIVERGENCES[n] = fn
        return fn

    return add


def get_divergence(name: str) -> Callable:
    if name not in DIVERGENCES:
        raise ValueError(f"unsupported divergence {name!r}; there are {sorted(DIVERGENCES)}")
    return DIVERGENCES[name]


def _inside(value: Column) -> Column:
    return F.when(F.col("mask") != 0, value)


def student_log_probs(ids: Column, student_ids: Column, student_logits: Column, rest: Column | None = None, unlisted: int | None = None) -> Column:
    """Log-probabilities of ``ids`` under a student who lists some tokens' logits. ``rest``:
    the log-sum-exp of the logits of its ``unlisted`` other tokens, which share it evenly;
    without it the listed tokens are all there are, and others have no probability."""
    logits = F.transform(student_logits, lambda x: x.cast("double"))
    norm = log_sum_exp(F.concat(logits, F.array(rest.cast("double"))) if rest is not None else logits)
    of = F.map_from_arrays(student_ids, logits)
    other = rest - F.log(F.lit(float(unlisted))) if rest is not None and unlisted else F.lit(float("-inf"))
    return F.transform(ids, lambda i: F.coalesce(F.element_at(of, i), other) - norm)


def topk_forward_kl(teacher: Column, student: Column, least: float | None = None) -> Column:
    """``loss, student_mass, teacher_mass`` from log-probabilities of the same tokens. The
    masses are those before anything is held at ``least``."""
    mass = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v))
    held = lambda x: F.transform(x, lambda v: clamp(v, least, None)) if least is not None else x
    each = F.zip_with(held(teacher), held(student), lambda t, s: F.when(F.exp(t) == 0, 0.0).otherwise(F.exp(t) * (t - s)))
    return F.struct(F.aggregate(each, F.lit(0.0), lambda a, v: a + v).alias("loss"), mass(student).alias("student_mass"), mass(teacher).alias("teacher_mass"))


@divergence("forward_kl_topk")
def _topk(tokens: DataFrame, kind: str, least: float | None = None, unlisted: int | None = None):
    """Over the teacher's likeliest tokens (``teacher_ids, teacher_logprobs``); the student is
    ``student_ids, student_logits`` and, if there, ``student_rest``. Such a part of two
    distributions may give less than 0, which counts as 0."""
    rest = F.col("student_rest") if "student_rest" in tokens.columns else None
    teacher = F.transform("teacher_logprobs", lambda x: x.cast("double"))
    student = student_log_probs(F.col("teacher_ids"), F.col("student_ids"), F.col("student_logits"), rest, unlisted)
    out = tokens.withColumn("__topk", topk_forward_kl(teacher, student, least))
    told = {f"{c}{end}": f(_inside(F.col(f"__topk.{c}"))) for c in ("student_mass", "teacher_mass") for f, end in ((F.avg, ""), (F.min, "_min"), (F.max, "_max"))}
    return out, F.greatest(F.lit(0.0), F.col("__topk.loss")), told


@divergence("kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3")
def _estimated(tokens: DataFrame, kind: str):
    """From the drawn token alone: ``logp`` and the teacher's ``teacher``."""
    each = kl(F.col("logp"), F.col("teacher"), kind)
    return tokens, each, {"abs_loss": F.avg(_inside(F.abs(each)))}


def distil(tokens: DataFrame, kind: str = "k1", most: float | None = None, mode: str = "token-mean", policy: str | None = None, task_rewards: bool = False, coefficient: float = 1.0, task_policy: str = "vanilla", **options) -> DataFrame:
    """One row: ``loss``, ``distillation_loss``, its extremes over the mask and what the
    divergence reports.

    ``most`` holds the divergence within plus and minus that, after its extremes are told.
    With ``policy`` its negative is the advantage of that policy loss, else it is averaged as
    it is. ``task_rewards`` adds it, times ``coefficient``, to the policy loss of the tokens'
    own ``advantage``; else the distillation loss is all there is."""
    made, each, told = get_divergence(kind)(tokens, kind, **options)
    made = made.withColumn("__raw", each)
    report = made.agg(F.min(_inside(F.col("__raw"))).alias("loss_min"), F.max(_inside(F.col("__raw"))).alias("loss_max"), *[c.alias(n) for n, c in told.items()])
    made = made.withColumn("__raw", clamp(F.col("__raw"), -most, most)) if most is not None else made
    if policy is not None:
        own = get_loss(policy)(made.withColumn("advantage", -F.col("__raw")), mode=mode)
        own = own.select(F.col("loss").alias("distillation_loss"), *[F.col(c).alias(f"distillation_{c}") for c in own.columns if c != "loss"])
    else:
        own = aggregate_loss(made, "__raw", mode).withColumnRenamed("loss", "distillation_loss")
    out = own.join(F.broadcast(report))  # a row each
    if not task_rewards:
        return out.withColumn("loss", F.col("distillation_loss"))
    task = get_loss(task_policy)(tokens, mode=mode).withColumnRenamed("loss", "task_loss")
    return out.join(F.broadcast(task)).withColumn("loss", F.col("task_loss") + F.col("distillation_loss") * coefficient)
