"""The second job: new persons who open an auction within the same window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.channels import hash_channel
from sluiceway.operators.joins import window_join_anchored
from sluiceway.operators.rows import union_tagged


def merged(persons: DataFrame, auctions: DataFrame, n: int) -> DataFrame:
    """Both streams as one, keyed, with channel and arrival tie-breaker.

    ``persons`` has ``tie, id, ms, name``; ``auctions`` has ``id, seller, ms, reserve``, where the
    id breaks ties. Ties are unique over both.
    """
    people = persons.select(F.col("id").alias("key"), "tie", "ms", "name")
    sold = auctions.select(F.col("seller").alias("key"), F.col("id").alias("tie"), "ms", "reserve")
    both = union_tagged({"person": people, "auction": sold})
    return both.withColumn("ch", hash_channel(both, "key", n))


def new_sellers(
    persons: DataFrame, auctions: DataFrame, n: int, width_ms: int, carry: DataFrame | None = None
) -> DataFrame:
    """``id, name, reserve``, one row per matching auction and person."""
    joined = window_join_anchored(
        merged(persons, auctions, n),
        "person",
        "auction",
        "ch",
        "key",
        "ms",
        "tie",
        width_ms,
        {"name": "name"},
        {"reserve": "reserve"},
        carry,
    )
    return joined.select(F.col("key").alias("id"), "name", "reserve")
