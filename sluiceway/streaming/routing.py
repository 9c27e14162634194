"""Routing of a stream by a channel table that changes while the stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.operators.asof import live_table_after, route_by_live_table
from sluiceway.session import written
from sluiceway.streaming.runs import with_batches
from sluiceway.streaming.tables import batch_table, keep_from, put_batch


def route_live_stream(
    log: DataFrame, path: str, checkpoint: str, channel: str = "ch", seq: str = "seq"
) -> DataStreamWriter:
    """``route_by_live_table`` of a stream that carries rows and control rows, in order between batches.

    ``op`` is null for rows and ``put``, ``putIfAbsent`` or ``remove`` for control rows. Routed
    rows go to ``path/out``. One row per channel is kept from batch to batch (``path/state``):
    whether the table lists it, and the type of its last row.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = batch_table(spark, f"{path}/state", number - 1)
        batch = batch.persist()
        try:
            changes = batch.where(F.col("op").isNotNull()).select(channel, seq, "op")
            rows = batch.where(F.col("op").isNull()).drop("op")
            routed = written(route_by_live_table(rows, changes, channel, seq, start), "live-routed")
            put_batch(routed, f"{path}/out", number)
            put_batch(live_table_after(routed, changes, channel, seq, start), f"{path}/state", number)
            keep_from(spark, f"{path}/state", number - 1)
        finally:
            batch.unpersist()

    return with_batches(log, checkpoint, handle)
