"""As-of joins: every row with the version of its key that held at the row's place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.model import DURABLE, NATIVE
from sluiceway.operators.control import PUT, PUT_IF_ABSENT, previous_in_channel
from sluiceway.operators.lookup import same_keys
from sluiceway.session import written

_PLACE_BITS = 33  # of monotonically_increasing_id; the partition's number is above them


def asof_join(
    rows: DataFrame, versions: DataFrame, keys: list[str], seq: str, values: list[str], start: DataFrame | None = None
) -> DataFrame:
    """``rows`` with ``values`` of the last version of their key whose ``seq`` is not greater.

    ``versions`` has ``keys``, ``seq`` and ``values``; a value may be null. Rows before their key's
    first version get the values of ``start`` (``keys, values``, one row per key), or null. Of
    versions with equal key and ``seq`` any one counts. Null keys are keys like any other.

    Rows and versions are sorted into ranges of (key, ``seq``) together, wherever a key begins or
    ends, so that a crowded key is spread over many tasks. Within a range the last version is
    carried along; what a key brings into a range comes from a table with one row per key and range.
    """
    version, place, span, carried = (f"{c}_{uuid.uuid4().hex[:8]}" for c in ("version", "place", "span", "carried"))
    held = F.struct(*values)
    both = rows.withColumn(version, F.lit(None).cast(versions.select(held.alias("v")).schema["v"].dataType)).unionByName(
        versions.select(*keys, seq, held.alias(version)), allowMissingColumns=True
    )
    # at equal places versions come first
    order = [*keys, seq, F.col(version).isNull()]
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn(place, F.monotonically_increasing_id()), "asof-rows")
    placed = placed.withColumn(span, F.shiftright(place, _PLACE_BITS))
    tails = placed.groupBy(*keys, span).agg(F.max_by(version, F.when(F.col(version).isNotNull(), F.col(place))).alias(version))
    earlier = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    brought = tails.select(*keys, span, F.last(version, ignorenulls=True).over(earlier).alias(carried))
    if start is not None:
        first = start.select(*keys, held.alias("_first"))
        brought = same_keys(brought, first, keys, "left")
        brought = brought.withColumn(carried, F.coalesce(carried, "_first")).drop("_first")
    inside = Window.partitionBy(*keys, span).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    known = placed.select("*", F.last(version, ignorenulls=True).over(inside).alias("_inside"), F.col(version).isNull().alias("_row"))
    known = same_keys(known.where("_row"), written(brought, "asof-carried"), [*keys, span], "left")
    now = F.coalesce("_inside", carried)
    return known.select(*rows.columns, *[now[v].alias(v) for v in values])


def last_versions(versions: DataFrame, keys: list[str], seq: str, values: list[str], start: DataFrame | None = None) -> DataFrame:
    """``keys, values``: the version of every key that holds after all of them."""
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_last")).select(*keys, "_last.*")
    if start is None:
        return last
    seen = last.select(*keys).withColumn("_seen", F.lit(True))
    rest = same_keys(start.select(*keys, *values), seen, keys, "left").where("_seen is null")
    return last.unionByName(rest.select(*keys, *values))


def route_by_live_table(
    rows: DataFrame, changes: DataFrame, channel: str = "ch", seq: str = "seq", start: DataFrame | None = None
) -> DataFrame:
    """Add ``channel_type``, ``switched`` and ``path`` by a channel table that changes as rows go by.

    ``changes`` (``channel, seq, op``) put channels into the table or remove them; a row sees those
    up to its own ``seq``. Listed channels are durable, others native. ``switched`` marks a
    channel's first row after its type changed. That row tells of the new type but still takes the
    old way: ``path`` is the type of the way that a row takes. ``seq`` is a unique whole number.
    ``start`` (see ``live_table_after``) continues from an earlier stretch of rows.
    """
    versions = changes.select(channel, seq, F.col("op").isin(PUT, PUT_IF_ABSENT).alias("listed"))
    known = asof_join(rows, versions, [channel], seq, ["listed"], None if start is None else start.select(channel, "listed"))
    kind = F.when(F.coalesce("listed", F.lit(False)), F.lit(DURABLE)).otherwise(F.lit(NATIVE))
    typed = written(known.withColumn("channel_type", kind).drop("listed"), "live-types")
    before = previous_in_channel(typed, channel, seq, "channel_type", "_before")
    if start is not None:
        last = start.select(channel, F.col("last_type").alias("_last"))
        before = same_keys(before, last, [channel], "left").withColumn("_before", F.coalesce("_before", "_last"))
    switched = F.coalesce(F.col("_before") != F.col("channel_type"), F.lit(False))
    return before.select(
        *rows.columns, "channel_type", switched.alias("switched"), F.coalesce("_before", "channel_type").alias("path")
    )


def live_table_after(
    routed: DataFrame, changes: DataFrame, channel: str = "ch", seq: str = "seq", start: DataFrame | None = None
) -> DataFrame:
    """``channel, listed, last_type``: what the next stretch of rows starts from."""
    versions = changes.select(channel, seq, F.col("op").isin(PUT, PUT_IF_ABSENT).alias("listed"))
    typed = routed.select(channel, seq, F.col("channel_type").alias("last_type"))
    listed = last_versions(versions, [channel], seq, ["listed"], None if start is None else start)
    types = last_versions(typed, [channel], seq, ["last_type"], None if start is None else start)
    every = listed.select(channel).union(types.select(channel)).distinct()
    return same_keys(same_keys(every, listed, [channel], "left"), types, [channel], "left")
