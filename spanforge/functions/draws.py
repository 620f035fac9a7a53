"""Deterministic draws: a keyed 32-bit hash that any SQL engine with md5 repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 4294967296


def draw(seed: int, purpose: str, *ids: Column) -> Column:
    """Integer in [0, 2^32) that depends on seed, purpose and ids only."""
    text = F.concat_ws("|", F.lit(f"{seed}|{purpose}"), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def half_even(x: Column) -> Column:
    """Python's round to an integer."""
    return F.bround(x, 0).cast("long")
