"""Whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column, by: int) -> Column:
    """Quotient, rounded towards zero."""
    return F.call_function("div", value, F.lit(by).cast("long"))


def floored(value: Column, by: int) -> Column:
    """Quotient, rounded down; exact for all longs."""
    return whole(value - F.pmod(value, F.lit(by).cast("long")), by)


def seeded(ids: Column, seed: int, below: int) -> Column:
    """A whole number from 0 to ``below`` - 1 that id and seed decide: the same in every run and task."""
    return F.pmod(F.xxhash64(ids, F.lit(seed).cast("long")), F.lit(below).cast("long"))
