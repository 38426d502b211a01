"""Repeatable draws: they depend on the seed and the row's id only, never on
how the rows are partitioned or in which order a task meets them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 13  # 52 bits: exact in a double


def seeded_hash(seed: int | str, *parts: Column) -> Column:
    """md5 of ``seed:part:part...`` as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: int | str, *parts: Column) -> Column:
    """A double in [0, 1), never NULL: declared so, or joins on values made from it
    would compute it once more for a test."""
    head = F.substring(seeded_hash(seed, *parts), 1, _HEX_DIGITS)
    value = F.conv(head, 16, 10).cast("bigint").cast("double") / F.lit(float(16**_HEX_DIGITS))
    return F.coalesce(value, F.lit(0.0))


def uniform_between(lo: float, hi: float, u: Column) -> Column:
    return F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))


def uniform_int(lo: int, hi: int, u: Column) -> Column:
    """Whole number in [lo, hi], both ends included."""
    return (F.lit(lo) + F.floor(u * F.lit(float(hi - lo + 1)))).cast("int")


def choice(values, u: Column) -> Column:
    index = (F.floor(u * F.lit(float(len(values)))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)
