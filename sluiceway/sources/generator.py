"""Rows as a function of a running index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sluiceway.session import written


def index_range(spark: SparkSession, stop: int, start: int = 0) -> DataFrame:
    """Indexes ``start .. stop - 1``; ``start`` lets a successor go on where a source stopped."""
    return spark.range(start, stop).withColumnRenamed("id", "idx")


def generate(
    indexes: DataFrame, columns: dict[str, Column], ends: Column | None = None, index: str = "idx"
) -> DataFrame:
    """Evaluate ``columns`` for every index, up to the first index where ``ends`` is true."""
    if ends is not None:
        first_end = indexes.where(ends).agg(F.min(index)).scalar()
        indexes = indexes.where(F.coalesce(F.col(index) < first_end, F.lit(True)))
    return indexes.select(F.col(index).alias("idx"), *[c.alias(n) for n, c in columns.items()])


def generate_with(
    indexes: DataFrame, make: Callable[[int], tuple | None], schema: str, index: str = "idx"
) -> DataFrame:
    """As ``generate`` with a Python function; it runs per Arrow batch and ``None`` ends the source.

    Indexes after the first ``None`` are found by an aggregate, not by running in order, so the
    partitions stay independent. The made rows are written once, so ``make`` runs once per index;
    it must depend on its index alone.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    payload = _parse_datatype_string(schema)

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            made = [(i, make(i)) for i in batch[index].tolist()]
            data = [
                (i, row is None, *(row if row is not None else (None,) * len(payload.fields)))
                for i, row in made
            ]
            yield pd.DataFrame(data, columns=["idx", "_end", *payload.names], dtype=object)

    full = StructType.fromDDL("idx long, _end boolean")
    full = StructType([*full.fields, *[StructField(f.name, f.dataType) for f in payload.fields]])
    made = written(indexes.select(index).mapInPandas(rows, full), "generated")
    first_end = made.where("_end").agg(F.min("idx")).scalar()
    return made.where(F.coalesce(F.col("idx") < first_end, F.lit(True))).drop("_end")


def before(df: DataFrame, n: int | Column, index: str) -> DataFrame:
    """The first ``n`` events of an indexed source, as a predicate that prunes the scan."""
    return df.where(F.col(index) < n)


def from_index(df: DataFrame, start: int | Column, index: str) -> DataFrame:
    """The events a successor still has to emit after ``start`` events."""
    return df.where(F.col(index) >= start)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _IndexReader(DataSourceStreamReader):
    def __init__(self, options):
        self.start = int(options.get("start", 0))
        self.stop = int(options.get("stop", 2**62))
        self.rows = int(options.get("rowsPerBatch", 1000))
        self.splits = int(options.get("splits", 8))
        self.planned = None

    def initialOffset(self) -> dict:
        return {"idx": self.start}

    def latestOffset(self) -> dict:
        at = self.start if self.planned is None else self.planned
        self.planned = min(self.stop, at + self.rows)
        return {"idx": self.planned}

    def partitions(self, start: dict, end: dict):
        a, b = start["idx"], end["idx"]
        self.planned = max(self.planned or 0, b)
        width = max(1, -(-(b - a) // self.splits))
        return [_Range(i, min(b, i + width)) for i in range(a, b, width)]

    def read(self, partition: _Range):
        import pyarrow as pa

        for at in range(partition.start, partition.stop, 10_000):
            stop = min(partition.stop, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(range(at, stop), pa.int64())], ["idx"])

    def commit(self, end: dict) -> None:
        self.planned = max(self.planned or 0, end["idx"])


class IndexSource(DataSource):
    """Streaming indexes, ``rowsPerBatch`` per micro-batch, split into ranges.

    The offset in the checkpoint is the event counter: a restarted query goes on from it.
    """

    @classmethod
    def name(cls) -> str:
        return "running-index"

    def schema(self) -> str:
        return "idx long"

    def streamReader(self, schema):
        return _IndexReader(self.options)


def index_stream(spark: SparkSession, rows_per_batch: int, start: int = 0, stop: int | None = None):
    spark.dataSource.register(IndexSource)
    reader = spark.readStream.format("running-index")
    reader = reader.option("rowsPerBatch", rows_per_batch).option("start", start)
    return (reader if stop is None else reader.option("stop", stop)).load()
