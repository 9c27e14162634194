"""Metrics of the rows that pass a tap, kept in a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent

METRICS = "name string, metric string, value long"


class _Recorder(StreamingQueryListener):
    """Writes what taps have seen to ``path/query=<id>/batch=<n>``; a batch that runs again overwrites it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        progress = event.progress
        rows = [
            (name, metric, None if value is None else int(value))
            for name, seen in progress.observedMetrics.items()
            for metric, value in seen.asDict().items()
        ]
        if rows:
            folder = f"{self.path}/query={progress.id}/batch={progress.batchId}"
            self.spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("overwrite").parquet(folder)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def recorded(spark: SparkSession, path: str) -> Iterator[None]:
    """Within it, the metrics of every tap on a stream go to the table in ``path`` after each micro-batch.

    At the end all micro-batches that have finished are in the table. Metrics are whole numbers.
    """
    recorder = _Recorder(spark, path)
    spark.streams.addListener(recorder)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(recorder)


def recorded_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``query, batch, name, metric, value`` as recorded so far."""
    schema = f"{METRICS}, query string, batch long"
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/query=*/batch=*")
    return rows.select("query", "batch", "name", "metric", "value")


def tap(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """A table whose rows are measured as they pass; ``get`` of the observation waits for the first action."""
    seen = Observation()
    counted = F.count(F.lit(1)).alias("rows")
    return df.observe(seen, counted, *[column.alias(name) for name, column in metrics.items()]), seen
