"""Functions of token arrays: one row a sample, one element a token.

All are built from higher-order functions, so they run beside the scan without a
shuffle. A masked-out element never reaches a sum, whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(values: Column, mask: Column) -> Column:
    """Products of values and mask, 0 where the mask is 0 (also for NaN and infinity)."""
    return F.zip_with(values, mask, lambda x, k: F.when(k != 0, x * k).otherwise(F.lit(0.0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def masked_sum(values: Column, mask: Column) -> Column:
    return total(masked(values, mask))


def mask_size(mask: Column) -> Column:
    return total(mask)


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (mask_size(mask) + 1e-8)


def masked_var(values: Column, mask: Column, unbiased: bool = True) -> Column:
    """Variance over the mask, from the masked mean; unbiased, an empty mask or one of a
    single element raises."""
    mean = masked_mean(values, mask)
    var = masked_mean(F.transform(values, lambda x: F.pow(x - mean, 2)), mask)
    if not unbiased:
        return var
    n = mask_size(mask)
    return F.when(n < 2, F.raise_error(F.lit("a variance needs two elements within the mask"))).otherwise(var * n / (n - 1))


def response_mask(tokens: Column, eos: list[int]) -> Column:
    """1 up to the first token of ``eos`` and on it, 0 after."""
    ends = F.filter(F.transform(tokens, lambda x, i: F.when(x.isin(eos), i)), lambda i: i.isNotNull())
    last = F.coalesce(F.try_element_at(ends, F.lit(1)), F.size(tokens))
    return F.transform(tokens, lambda x, i: (i <= last).cast("int"))


def tail_mask(attention_mask: Column, length: Column) -> Column:
    """The part of an attention mask that belongs to a response of ``length`` tokens."""
    return F.when(length > 0, F.slice(attention_mask, F.size(attention_mask) - length + 1, length)).otherwise(F.array().cast("array<int>"))


def pad(values: Column, length: int, filler, left: bool = False) -> Column:
    """To ``length`` elements at least; longer arrays stay as they are."""
    more = F.array_repeat(F.lit(filler), F.greatest(F.lit(0), F.lit(length) - F.size(values)))
    return F.concat(more, values) if left else F.concat(values, more)


def truncate(values: Column, length: int, side: str = "right") -> Column:
    """``side``: what is cut off when there are more than ``length`` elements."""
    if side == "left":
        return F.when(F.size(values) > length, F.slice(values, F.size(values) - length + 1, length)).otherwise(values)
    if side == "right":
        return F.slice(values, 1, length)
    if side == "error":
        return F.when(F.size(values) > length, F.raise_error(F.lit(f"more than {length} tokens"))).otherwise(values)
    raise ValueError(f"unknown side {side!r}")


def keep_where(values: Column, mask: Column) -> Column:
    """Elements whose mask is not 0: padded to ragged."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])


def spread_where(values: Column, mask: Column, filler) -> Column:
    """The inverse of ``keep_where``: the k-th value at the k-th place of the mask."""
    place = F.transform(mask, lambda m, i: F.when(m != 0, total(F.slice(mask, 1, i + 1)).cast("int")))
    return F.transform(place, lambda p: F.when(p.isNotNull(), F.get(values, p - 1)).otherwise(F.lit(filler)))


def running_sum(values: Column) -> Column:
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, x: F.array_append(acc, F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), acc), -1), F.lit(0.0)) + x))


def reward_to_go(rewards: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Discounted sums of later rewards; after a masked-out token the sum starts anew."""
    zipped = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(acc, z):
        now = z["r"] + F.lit(float(gamma)) * acc["run"]
        return F.struct((now * z["m"]).alias("run"), F.array_append(acc["out"], now).alias("out"))

    return F.reverse(F.aggregate(zipped, start, step)["out"])


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates, before whitening.

    Tokens outside the mask pass the state on, so what they hold does not matter; they
    get the estimate of the token after them."""
    zipped = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, z):
        fresh = z["r"] + gamma * acc["next"] - z["v"] + gamma * lam * acc["last"]
        inside = z["m"] != 0
        last = F.when(inside, fresh).otherwise(acc["last"])
        return F.struct(F.when(inside, z["v"]).otherwise(acc["next"]).alias("next"), last.alias("last"), F.array_append(acc["out"], last).alias("out"))

    return F.reverse(F.aggregate(zipped, start, step)["out"])


def spans(mask: Column) -> Column:
    """Runs of non-zero mask elements as ``start, end`` (end excluded)."""
    zero = F.lit(0)
    at = lambda i: F.coalesce(F.get(mask, i), zero)
    starts = F.filter(F.transform(mask, lambda m, i: F.when((m != 0) & ((i == 0) | (at(i - 1) == 0)), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(mask, lambda m, i: F.when((m != 0) & (at(i + 1) == 0), i + 1)), lambda i: i.isNotNull())
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def count_differences(a: Column, b: Column, mask: Column) -> Column:
    unequal = F.zip_with(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), mask, lambda d, m: d * m)
    return total(unequal).cast("long")


def at_last_valid(score: Column, mask: Column) -> Column:
    """Zeros with the score at the last token of the mask; a response without any token
    has it at the last place."""
    n = mask_size(mask).cast("int")
    place = F.when(n > 0, n - 1).otherwise(F.size(mask) - 1)
    return F.transform(mask, lambda m, i: F.when(i == place, score.cast("double")).otherwise(F.lit(0.0)))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def entropy(logits: Column) -> Column:
    """Shannon entropy of the distribution that stored logits give."""
    z = log_sum_exp(logits)
    return z - F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - z) * x)


def sum_of_squared_probabilities(logits: Column) -> Column:
    return F.exp(log_sum_exp(F.transform(logits, lambda x: x * 2.0)) - 2.0 * log_sum_exp(logits))


def token_log_probability(logits: Column, token: Column) -> Column:
    """Log-probability of a token (counted from 0)."""
    return F.get(logits, token) - log_sum_exp(logits)
