"""Reading named durable channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def channel_read(
    spark: SparkSession,
    streams: dict[str, str],
    channels: list[int] | None = None,
    epochs: tuple[int, int | None] = (0, None),
) -> DataFrame:
    """Rows parked in the folders of one or more streams (stream id -> folder).

    ``channel`` and ``epoch`` are partition columns, so other channels are not even listed.
    """
    return _select(lambda path: spark.read.parquet(path), streams, channels, epochs)


def channel_stream(
    spark: SparkSession,
    streams: dict[str, str],
    schema: StructType,
    channels: list[int] | None = None,
    epochs: tuple[int, int | None] = (0, None),
) -> DataFrame:
    """The same as a stream; the checkpoint of the query remembers which files were taken.

    A micro-batch takes all files that are there, so what was parked before a query starts is
    never cut in the order of file names. Stateful operators order a micro-batch by the rows' own
    position (event time, sequence number), and results don't depend on the number of files.
    """
    return _select(lambda path: spark.readStream.schema(schema).parquet(path), streams, channels, epochs)


def _select(open_one, streams: dict[str, str], channels, epochs) -> DataFrame:
    def one(stream: str, path: str) -> DataFrame:
        df = open_one(path)
        if channels is not None:
            df = df.where(F.col("channel").isin(*channels))
        first, last = epochs
        if first:
            df = df.where(F.col("epoch") >= first)
        if last is not None:
            df = df.where(F.col("epoch") <= last)
        return df.withColumn("stream", F.lit(stream))

    return reduce(DataFrame.unionByName, [one(s, p) for s, p in streams.items()])
