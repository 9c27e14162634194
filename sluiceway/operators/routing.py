"""Native path or durable channel, and which stream a row goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.names import queue_name
from sluiceway.model import DURABLE, NATIVE


def _listed(table: DataFrame, parallelism: int, channel: str) -> DataFrame:
    """Channels in the table: at most ``parallelism`` rows, whatever the table holds."""
    known = table.where((F.col("channel") >= 0) & (F.col("channel") < parallelism))
    return known.select(F.col("channel").cast("int").alias(channel)).distinct()


def channel_members(
    rows: DataFrame, table: DataFrame, parallelism: int, channel: str = "ch"
) -> DataFrame:
    """Rows whose channel is listed in the channel table of their stream."""
    return rows.join(F.broadcast(_listed(table, parallelism, channel)), channel, "left_semi")


def channel_others(
    rows: DataFrame, table: DataFrame, parallelism: int, channel: str = "ch"
) -> DataFrame:
    """Rows whose channel is not listed."""
    return rows.join(F.broadcast(_listed(table, parallelism, channel)), channel, "left_anti")


def route_by_table(
    rows: DataFrame, table: DataFrame, parallelism: int, channel: str = "ch"
) -> DataFrame:
    """Add ``channel_type``: durable for listed channels, native for the others.

    One pass over the rows without a shuffle; works on streams.
    """
    listed = _listed(table, parallelism, channel).withColumn("_listed", F.lit(True))
    joined = rows.join(F.broadcast(listed), channel, "left")
    kind = F.when(F.col("_listed"), F.lit(DURABLE)).otherwise(F.lit(NATIVE))
    return joined.withColumn("channel_type", kind).select(*rows.columns, "channel_type")


def paused_channels(topology: DataFrame, operator: str) -> DataFrame:
    """Channel table of the instances of an operator that are paused.

    Routing by it holds the rows for paused instances in durable channels until they resume.
    """
    paused = (F.col("operator") == operator) & (F.col("status") == "Paused")
    return topology.where(paused).select(F.col("instance").alias("channel"))


def retarget_stream(
    rows: DataFrame,
    routes: DataFrame,
    operator: str,
    instance: Column,
    instances: int,
    default: str,
    parallelism: dict[str, int] | None = None,
    channel: str = "ch",
) -> DataFrame:
    """Add the ``stream`` each row goes to and its ``queue``.

    ``routes`` (``operator, instance, stream``, and ``seq`` if routes can repeat) overrides the
    default stream for single ones of the operator's ``instances``; the last route by ``seq``
    counts, without it the greatest stream id. With ``parallelism`` (stream id -> channels) the
    channel is folded into the channels of the new stream; a stream that is not listed there is
    an error.
    """
    last = F.col("seq") if "seq" in routes.columns else F.lit(0)
    known = (F.col("operator") == operator) & F.col("instance").between(0, instances - 1)
    mine = routes.where(known).groupBy(F.col("instance").cast("int").alias("_instance")).agg(
        F.max(F.struct(last.alias("seq"), F.col("stream").alias("stream"))).getField("stream").alias("_new")
    )  # at most ``instances`` rows
    out = (
        rows.withColumn("_instance", instance.cast("int"))
        .join(F.broadcast(mine), "_instance", "left")
        .withColumn("stream", F.coalesce("_new", F.lit(default)))
    )
    if parallelism is not None:
        n = F.raise_error(F.concat(F.lit("no parallelism for stream "), F.col("stream"))).cast("int")
        for stream, channels in parallelism.items():
            n = F.when(F.col("stream") == stream, F.lit(channels)).otherwise(n)
        out = out.withColumn(channel, (F.col(channel) % n).cast("int"))
    out = out.withColumn("queue", queue_name(F.col("stream"), F.col(channel)))
    return out.select(*rows.columns, "stream", "queue")
