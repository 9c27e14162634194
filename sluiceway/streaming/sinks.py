"""Sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.functions.names import task_line
from sluiceway.operators.rows import tap_rows
from sluiceway.streaming.runs import with_batches, writer


def console_sink(df: DataFrame, line: Column, task: Column, checkpoint: str) -> DataStreamWriter:
    """Print rendered rows, prefixed by the task name."""
    printed = df.select(task_line(task, line).alias("line"))
    return writer(printed, checkpoint).format("console").option("truncate", False)


def discard_sink(df: DataFrame, checkpoint: str) -> DataStreamWriter:
    return writer(df, checkpoint).format("noop")


def foreach_sink(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> DataStreamWriter:
    """User hook per micro-batch, a DataFrame, so that its work stays distributed."""
    return with_batches(df, checkpoint, handle)


def tapped_sink(
    df: DataFrame,
    operator: str,
    instance: Column,
    instances: int,
    switches: Callable[[], DataFrame],
    sink: Callable[[DataFrame, int], None],
    tap: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> DataStreamWriter:
    """Hand every micro-batch to ``sink``, and the rows of switched-on instances to ``tap``.

    ``switches`` is asked anew for every micro-batch, so logging can be turned on while running.
    """

    def handle(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        tap(tap_rows(batch, operator, instance, instances, switches()), number)

    return with_batches(df, checkpoint, handle)
