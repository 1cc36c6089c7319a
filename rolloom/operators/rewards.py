"""Reward managers: scores of whole responses become token-level scores of a batch.

A manager takes a wide batch (``response_mask`` as an array) and a score column, and adds
``token_level_scores`` (zeros with the reward at the last valid token; at the last place
of a response without any). Named parts of a score become columns of their own. A batch
that has ``rm_scores`` already, from a reward model, keeps those as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import overlong_penalty
from ..functions.tokens import at_last_valid, mask_size

MANAGERS: dict[str, Callable[..., DataFrame]] = {}
TOKEN_SCORES = "token_level_scores"


def reward_manager(name: str):
    """Register a manager; a name that is taken by another function raises."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if MANAGERS.setdefault(name, fn) is not fn:
            raise ValueError(f"there is a reward manager {name} already")
        return fn

    return add


def get_manager(name: str) -> Callable[..., DataFrame]:
    if name not in MANAGERS:
        raise ValueError(f"no reward manager {name}; there are {sorted(MANAGERS)}")
    return MANAGERS[name]


def from_model(batch: DataFrame) -> DataFrame | None:
    """The batch with the scores of a reward model, if it has any."""
    return batch.withColumn(TOKEN_SCORES, F.col("rm_scores")) if "rm_scores" in batch.columns else None


def _placed(batch: DataFrame, reward: Column, extras: dict[str, Column], mask: str) -> DataFrame:
    made = batch.withColumns({**extras, "__reward": reward.cast("double")})
    return made.withColumn(TOKEN_SCORES, at_last_valid(F.col("__reward"), F.col(mask))).drop("__reward")


@reward_manager("naive")
def naive(batch: DataFrame, score: Column, extras: dict[str, Column] | None = None, mask: str = "response_mask") -> DataFrame:
    """The score itself; ``extras``: other parts of it, under their names."""
    known = from_model(batch)
    return known if known is not None else _placed(batch, score, extras or {}, mask)


@reward_manager("batch")
def batched(batch: DataFrame, score: Column, extras: dict[str, Column] | None = None, mask: str = "response_mask") -> DataFrame:
    """As ``naive``, with the score in ``acc`` besides."""
    known = from_model(batch)
    return known if known is not None else _placed(batch, score, {**(extras or {}), "acc": score.cast("double")}, mask)


@reward_manager("prime")
def all_or_nothing(batch: DataFrame, score: Column, broken: Column | None = None, mask: str = "response_mask") -> DataFrame:
    """A row that could not be scored (null) has 0; if any row is ``broken``, the scorer as
    a whole is taken to have failed and all rows have 0. Adds ``acc``."""
    known = from_model(batch)
    if known is not None:
        return known
    value = F.coalesce(score.cast("double"), F.lit(0.0))
    if broken is None:
        return _placed(batch, value, {"acc": value}, mask)
    failed = batch.agg(F.coalesce(F.max(broken), F.lit(False)).alias("__failed"))  # one row
    value = F.when(F.col("__failed"), 0.0).otherwise(value)
    return _placed(batch.join(F.broadcast(failed)), value, {"acc": value}, mask).drop("__failed")


@reward_manager("dapo")
def with_overlong(batch: DataFrame, score: Column, extras: dict[str, Column] | None = None, most: int | None = None, buffer: int = 0, factor: float = 1.0, log: bool = False, mask: str = "response_mask") -> DataFrame:
    """With ``buffer`` over 0 the penalty of responses that come near ``most`` tokens is
    added; ``log`` shows it as ``overlong_reward, overlong``. Without parts the score is
    shown as ``acc``."""
    known = from_model(batch)
    if known is not None:
        return known
    shown = dict(extras) if extras else {"acc": score.cast("double")}
    if not buffer:
        return _placed(batch, score, shown, mask)
    if most is None or most < buffer:
        raise ValueError("the buffer lies within the most tokens of a response")
    penalty = overlong_penalty(mask_size(F.col(mask)), most, buffer, factor)
    if log:
        shown |= {"overlong_reward": penalty, "overlong": penalty < 0}
    return _placed(batch, score + penalty, shown, mask)


@reward_manager("gdpo")
def several_scores(batch: DataFrame, score: Column, extras: dict[str, Column] | None = None, mask: str = "response_mask") -> DataFrame:
    """As ``naive``; every part of the score stays a column, for group advantages of each,
    and without parts the score is shown as ``acc``."""
    known = from_model(batch)
    return known if known is not None else _placed(batch, score, dict(extras) if extras else {"acc": score.cast("double")}, mask)


def evaluate(rows: DataFrame, scorer: Callable[[Column, Column, Column], Column], source: str = "data_source", responses: str = "responses", truth: Column | str = "ground_truth", row: str = "row_id") -> DataFrame:
    """``data_source, test_score``: the mean over rows of each row's mean over its responses
    (an array), so rows count alike whatever their number of responses."""
    truth = F.col(truth) if isinstance(truth, str) else truth
    each = rows.select(row, F.col(source).alias("data_source"), truth.alias("__truth"), F.explode(responses).alias("__response"))
    each = each.withColumn("__score", scorer(F.col("data_source"), F.col("__response"), F.col("__truth")))
    return each.groupBy(row, "data_source").agg(F.avg("__score").alias("__score")).groupBy("data_source").agg(F.avg("__score").alias("test_score"))
