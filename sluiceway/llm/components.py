"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node next to it."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them; needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, root``: for each node with a link the least node that it can reach.

    ``edges`` has two columns of one ordered type, in either direction, repeats and self-links
    allowed; links with a null end are ignored. Roots themselves are listed too. A node with very
    many links is a grouped minimum and one side of a join, which Spark can split. Each round is
    written to the shared folder.
    """
    a, b = edges.columns
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    now = stored(start, purpose)
    while True:
        large = _large_star(now).where("u <> v").distinct()
        after = stored(_small_star(large).where("u <> v").distinct(), purpose)
        changed = after.join(now, ["u", "v"], "left_anti").limit(1).count() or after.count() != now.count()
        now = after
        if not changed:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
