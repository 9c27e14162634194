"""Durable channels: rows in flight parked in files until a reader takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.streaming.runs import writer

PARTITIONS = ("channel", "epoch")


def parked(rows: DataFrame, channel: str, epoch: int) -> DataFrame:
    """The rows as they lie in a channel folder; ``epoch`` numbers the stretches between cuts."""
    return rows.withColumn("channel", F.col(channel).cast("int")).withColumn("epoch", F.lit(epoch))


def channel_write(
    rows: DataFrame, path: str, checkpoint: str, channel: str = "ch", epoch: int = 0
) -> DataStreamWriter:
    """Append a stream to its channels, exactly once."""
    out = writer(parked(rows, channel, epoch), checkpoint)
    return out.format("parquet").partitionBy(*PARTITIONS).option("path", path)


def append_to_channels(rows: DataFrame, path: str, channel: str = "ch", epoch: int = 0) -> None:
    """Append a batch to the channels."""
    parked(rows, channel, epoch).write.mode("append").partitionBy(*PARTITIONS).parquet(path)
