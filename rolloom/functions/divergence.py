"""Estimates of divergence from two log-probabilities of the drawn token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    if high is not None:
        x = F.least(x, F.lit(float(high)))
    return F.greatest(x, F.lit(float(low))) if low is not None else x


def kl(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """k1 (kl), abs, k2 (mse), k3 (low_var_kl). A "+" at the end concerns gradients only."""
    base = kind.removesuffix("+")
    gap = logp - ref
    if base in ("kl", "k1"):
        return gap
    if base == "abs":
        return F.abs(gap)
    if base in ("mse", "k2"):
        return gap * gap * 0.5
    if base in ("low_var_kl", "k3"):
        back = clamp(-gap, -20, 20)
        return clamp(F.exp(back) - back - 1, -10, 10)
    raise NotImplementedError(f"divergence {kind!r}")


def importance_ratio(logp: Column, old: Column, bound: float = 20.0) -> Column:
    return F.exp(clamp(logp - old, -bound, bound))
