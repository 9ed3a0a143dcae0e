"""Seeded, repeatable choices from md5: the same on every run, engine and retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 13
_RANGE = float(16**_HEX_DIGITS)


def order_hash(seed: int | str, *key: Column) -> Column:
    """Hex digest that puts keys into a seeded random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def hash_number(seed: int | str, *key: Column) -> Column:
    """Uniform integer in [0, 16**13)."""
    return F.conv(F.substring(order_hash(seed, *key), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def unit_hash(seed: int | str, *key: Column) -> Column:
    """Uniform number in [0, 1)."""
    return hash_number(seed, *key).cast("double") / F.lit(_RANGE)


def pick(values: Sequence[str], seed: int | str, *key: Column) -> Column:
    """One of ``values``, chosen by hash."""
    place = hash_number(seed, *key) % F.lit(len(values))
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))
