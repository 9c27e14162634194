"""Window operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.operators.anchored import closed_windows, place_rows, state_after, window_edges
from sluiceway.operators.joins import join_placed
from sluiceway.streaming.runs import with_batches
from sluiceway.streaming.tables import batch_table, keep_from, last_batch, put_batch


def anchored_window_stream(
    rows: DataFrame,
    channel: str,
    ms: str,
    tie: str,
    width_ms: int,
    path: str,
    checkpoint: str,
    start: DataFrame | None = None,
) -> DataStreamWriter:
    """First-event-anchored windows of a stream whose micro-batches arrive in order.

    Inside a micro-batch rows are taken in the order ``(ms, tie)`` by the batch operator. The
    state that crosses batches is one row per channel (``path/state``); ``start`` takes over the
    state of another query.
    """

    def handle(batch: DataFrame, number: int) -> None:
        carry = batch_table(batch.sparkSession, f"{path}/state", number - 1)
        carry = start if carry is None else carry
        batch = batch.persist()
        try:
            edges = window_edges(batch, channel, ms, tie, width_ms, carry)
            placed = place_rows(batch, edges, channel, ms, tie, width_ms, carry)
            put_batch(placed, f"{path}/out", number)
            put_batch(state_after(edges, carry), f"{path}/state", number)
            keep_from(batch.sparkSession, f"{path}/state", number - 1)
        finally:
            batch.unpersist()

    return with_batches(rows, checkpoint, handle)


def window_join_anchored_stream(
    rows: DataFrame,
    kinds: tuple[str, str],
    channel: str,
    key: str,
    ms: str,
    tie: str,
    width_ms: int,
    columns: tuple[dict[str, str], dict[str, str]],
    path: str,
    checkpoint: str,
    start: tuple[DataFrame, DataFrame] | None = None,
) -> DataStreamWriter:
    """Join of two kinds inside anchored windows. A window is joined when it closes.

    State across batches: anchors (``path/state``) and the rows of the still open windows
    (``path/open``). ``start`` = (anchors, open rows) takes both over from another query, so a
    handover loses nothing of the open window.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        carry = batch_table(spark, f"{path}/state", number - 1)
        waiting = batch_table(spark, f"{path}/open", number - 1)
        if carry is None and start is not None:
            carry, waiting = start
        batch = batch.persist()
        try:
            edges = window_edges(batch, channel, ms, tie, width_ms, carry)
            placed = place_rows(batch, edges, channel, ms, tie, width_ms, carry)
            inside = placed.where(~F.col("is_closer")).drop("is_closer")
            if waiting is not None:
                inside = waiting.unionByName(inside)
            closed = closed_windows(edges).withColumnRenamed("_ch", channel)
            out = join_placed(inside, closed, kinds, channel, key, columns)
            put_batch(out, f"{path}/out", number)
            still = inside.join(closed, channel, "left").where(
                F.col("_closed").isNull() | (F.col("win") > F.col("_closed"))
            )
            put_batch(still.drop("_closed").select(*inside.columns), f"{path}/open", number)
            keep_from(spark, f"{path}/open", number - 1)
            put_batch(state_after(edges, carry), f"{path}/state", number)
            keep_from(batch.sparkSession, f"{path}/state", number - 1)
        finally:
            batch.unpersist()

    return with_batches(rows, checkpoint, handle)


def window_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Anchors and, for joins, open rows that a query left behind."""
    number = last_batch(spark, f"{path}/state")
    has_open = last_batch(spark, f"{path}/open") >= 0
    waiting = batch_table(spark, f"{path}/open", number) if has_open else None
    return batch_table(spark, f"{path}/state", number), waiting
