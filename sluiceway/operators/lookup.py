"""Frequent keys: finding them, and joining rows to a one-row-per-key table in spite of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 10_000_000  # rows of one key that a single task may sort

def hot_keys(counts: DataFrame, keys: list[str], n: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and their number, at any size of the data.

    There is at most one for every ``hot_rows`` rows of all. Spark broadcasts them if they are few
    and shuffles otherwise.
    """
    return counts.where(F.col(n) > hot_rows).select(*keys, n)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the keys come once, from the left."""
    other = {k: f"_other_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(other)
    on = [left[k].eqNullSafe(right[o]) for k, o in other.items()]
    return left.join(right, on, how).drop(*other.values())


def lookup(
    rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (unique on ``on``) in one pass over the rows.

    ``hot`` (see ``hot_keys``) has the frequent keys and their rows as its last column. A hot key's
    rows are dealt out by a salt to one group for every ``hot_rows`` of them, and the key's one
    table row is copied to each group. The salt is a hash of the row, so a recomputed task deals
    the same way. Null keys meet null keys.
    """
    n = hot.columns[-1]
    hot = hot.select(*on, F.ceil(F.col(n) / hot_rows).cast("int").alias("_groups"))
    salt = F.pmod(F.xxhash64(*rows.columns), F.col("_groups")).cast("int")
    dealt = same_keys(rows, hot, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    salts = F.sequence(F.lit(0), F.coalesce("_groups", F.lit(1)) - 1)
    copied = same_keys(table, hot, on, "left").withColumn("_salt", F.explode(salts))
    return same_keys(dealt.drop("_groups"), copied.drop("_groups"), [*on, "_salt"]).drop("_salt")
