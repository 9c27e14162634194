"""Current views of control tables that are fed by a changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.names import key_attribute, key_instance
from sluiceway.functions.numbers import floored
from sluiceway.operators.lookup import HOT_ROWS, hot_keys, lookup, same_keys
from sluiceway.session import written

PUT, PUT_IF_ABSENT, REMOVE = "put", "putIfAbsent", "remove"

# Attributes kept per operator instance, and their columns.
ATTRIBUTES = {
    "task-name": "task_name",
    "allocation-id": "allocation_id",
    "instance-status": "status",
    "instance-output": "output",
    "input-stream": "input_streams",
    "output-stream": "output_stream",
}


def changelog_view(
    log: DataFrame,
    keys: list[str],
    seq: str = "seq",
    op: str = "op",
    value: str = "value",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Value per key after all changes; keys that are absent in the end have no row.

    Let P be the last put and R the last remove of a key. A later put wins: the value at P.
    Otherwise the key was absent after R, and the first putIfAbsent after R sets it. P and R are
    plain aggregates, combined before the shuffle, and are written to the shared folder, one row
    per key. Then the putIfAbsent rows of keys decided the second way are looked at once more.
    """
    is_put, is_remove = F.col(op) == PUT, F.col(op) == REMOVE
    is_offer = F.col(op) == PUT_IF_ABSENT
    ends = log.groupBy(*keys).agg(
        F.max(F.when(is_put, F.col(seq))).alias("_put"),
        F.max_by(value, F.when(is_put, F.col(seq))).alias("_value"),
        F.max(F.when(is_remove, F.col(seq))).alias("_remove"),
        F.count_if(is_offer).alias("_offers"),
    )
    ends = written(ends, "changelog-ends")
    put_wins = F.col("_put").isNotNull() & (
        F.col("_remove").isNull() | (F.col("_put") > F.col("_remove"))
    )
    by_put = ends.where(put_wins).select(*keys, F.col("_value").alias(value))
    undecided = ends.where(~put_wins & (F.col("_offers") > 0)).select(*keys, "_remove", "_offers")
    offers = log.where(is_offer).select(*keys, seq, value)
    hot = hot_keys(undecided, keys, "_offers", hot_rows)
    later = lookup(offers, undecided, keys, hot, hot_rows).where(
        F.col("_remove").isNull() | (F.col(seq) > F.col("_remove"))
    )
    by_offer = later.groupBy(*keys).agg(F.min_by(value, seq).alias(value))
    return by_put.unionByName(by_offer)


def topology_view(log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per operator instance from control rows ``seq, tbl, key, op, value``.

    ``tbl`` is the operator. ``parallelism`` is an attribute of the whole operator.
    """
    view = changelog_view(log, ["tbl", "key"], hot_rows=hot_rows)
    parts = view.select(
        F.col("tbl").alias("operator"),
        key_instance(F.col("key")).alias("instance"),
        key_attribute(F.col("key")).alias("attribute"),
        "value",
    )
    whole = (
        parts.where(F.col("instance").isNull() & (F.col("attribute") == "parallelism"))
        .select("operator", F.col("value").cast("int").alias("parallelism"))
    )
    instances = (
        parts.where(F.col("instance").isNotNull())
        .groupBy("operator", "instance")
        .pivot("attribute", list(ATTRIBUTES))
        .agg(F.first("value"))
    )
    for attribute, column in ATTRIBUTES.items():
        instances = instances.withColumnRenamed(attribute, column)
    return instances.join(whole, "operator", "left").select(
        "operator", "instance", "parallelism", *ATTRIBUTES.values()
    )


def previous_in_channel(
    df: DataFrame, channel: str, seq: str, value: str, name: str, block_rows: int = 1 << 20
) -> DataFrame:
    """Add ``name``: ``value`` of the row before, in the channel's order of ``seq``.

    ``seq`` is a unique whole number. Rows are compared inside blocks of ``seq``; the first row of
    a block takes the last row of the channel's block before it, from a table with one row per
    block. So one crowded channel is spread over many tasks.
    """
    rows = df.withColumn("_block", floored(F.col(seq), block_rows))
    tails = rows.groupBy(channel, "_block").agg(F.max_by(value, seq).alias("_tail"))
    by_block = Window.partitionBy(channel).orderBy("_block")
    before = tails.select(channel, "_block", F.lag("_tail").over(by_block).alias("_before"))
    inside = Window.partitionBy(channel, "_block").orderBy(seq)
    previous = F.coalesce(F.lag(value).over(inside), F.col("_before"))
    joined = same_keys(rows, before, [channel, "_block"], "left")
    return joined.withColumn(name, previous).select(*df.columns, name)


def mode_switch_marker(
    df: DataFrame, channel: str, seq: str, kind: str = "channel_type"
) -> DataFrame:
    """Rows where a channel's type differs from the row before it in the channel."""
    known = previous_in_channel(df, channel, seq, kind, "_previous")
    return known.where(F.col("_previous") != F.col(kind)).drop("_previous")
