"""Weights of reader interactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Model parameters with the ranges in which they are legal."""

    decay: float = 0.1
    click: float = 1.0
    read: float = 2.0
    share: float = 3.0
    min_sim: float = 0.1
    top_n: int = 10

    def __post_init__(self):
        for name, low, high in (("decay", 0.001, 2), ("click", 0, 10), ("read", 0, 10), ("share", 0, 10), ("min_sim", 0, 1), ("top_n", 1, 50)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be in [{low}, {high}]")


def decay_weight(ts: Column, asof: Column, rate: float) -> Column:
    days = (F.unix_micros(asof) - F.unix_micros(ts)) / F.lit(8.64e10)
    return F.exp(F.lit(-float(rate)) * F.greatest(F.lit(0.0), days))


def event_weight(kind: Column, p: Params) -> Column:
    return F.when(kind == "click", p.click).when(kind == "read", p.read).when(kind == "share", p.share).otherwise(1.0)


def _halves(c: Column) -> tuple[Column, Column]:
    """A double as the sum of two of 26 significant bits each."""
    t = c * F.lit(134217729.0)
    high = t - (t - c)
    return high, c - high


def rounded(c: Column, digits: int) -> Column:
    """A double rounded to `digits` decimals by its exact binary value, ties to even: 2.00005 is a little more and becomes 2.0001, 0.125 is a tie and becomes 0.12.

    The product with 10^digits is one double p and the residual e that it lacks (both exact). Where p isn't halfway between two integers the nearest
    is right, since the residual is less than the distance to halfway; where it is, the residual's sign decides, and without one the even integer.
    """
    scale = float(10**digits)
    c = c.cast("double")
    p = c * F.lit(scale)
    (ch, cl), (sh, sl) = _halves(c), _halves(F.lit(scale))
    e = ((ch * sh - p) + ch * sl + cl * sh) + cl * sl
    half = F.abs(p - F.floor(p)) == 0.5
    whole = F.when(half & (e > 0), F.ceil(p).cast("double")).when(half & (e < 0), F.floor(p).cast("double")).otherwise(F.rint(p))
    return F.when(F.abs(p) < F.lit(2.0**52), whole / scale).otherwise(c)


def percentage(part: Column, whole: Column) -> Column:
    """Rounded to two places; 0 of nothing."""
    return F.when(whole > 0, rounded(part / F.when(whole > 0, whole) * 100, 2)).otherwise(F.lit(0.0))
