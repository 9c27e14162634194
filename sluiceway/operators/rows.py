"""Row-wise operators: keys, envelopes, branches, unions, user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.text import words
from sluiceway.model import NATIVE


def tokenize(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """One row per word with its place ``pos`` in the text, from 1."""
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    # Split in a projection of its own: inside explode it would be computed several times. The
    # outer form keeps the optimizer from adding a filter on the array, which splits once more.
    split = df.select(*keep, words(text).alias("_words"))
    placed = split.select(*keep, F.posexplode_outer("_words").alias("_pos", "word"))
    return placed.where(F.col("word").isNotNull()).select(
        *keep, (F.col("_pos") + 1).cast("long").alias("pos"), "word"
    )


def flat_map(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """User function from Arrow record batches to record batches: each row becomes 0..n rows."""
    return df.mapInArrow(fn, schema)


def flat_map_rows(df: DataFrame, fn: Callable[[dict], list[dict] | None], schema: str) -> DataFrame:
    """User function from one row to a list of rows; nothing or an empty list drops the row.

    The slow but simple form of ``flat_map``. Rows cross to Python in Arrow batches and keep their
    types: nulls are ``None``, whole numbers stay whole.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            made = [out for row in batch.to_pylist() for out in fn(row) or ()]
            if made:
                yield pa.RecordBatch.from_pylist(made, kind)

    return df.mapInArrow(each, schema)


def key_by(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("key"), *df.columns)


def envelope(
    df: DataFrame,
    operator: str,
    parallelism: int,
    dest: Column,
    instance: Column | None = None,
    channel_type: Column | None = None,
) -> DataFrame:
    """Wrap rows with their source instance, destination channel and channel type."""
    instance = F.spark_partition_id() if instance is None else instance
    channel_type = F.lit(NATIVE) if channel_type is None else channel_type
    src = F.struct(
        F.lit(operator).alias("operator"),
        instance.cast("int").alias("instance"),
        F.lit(parallelism).alias("parallelism"),
    )
    return df.select(
        src.alias("src"),
        dest.cast("int").alias("dest"),
        channel_type.cast("int").alias("channel_type"),
        F.struct(*df.columns).alias("data"),
    )


def unwrap(df: DataFrame) -> DataFrame:
    return df.select("data.*")


def union_tagged(branches: dict[str, DataFrame]) -> DataFrame:
    """Merge differently shaped streams into one; ``kind`` tells where a row came from."""
    tagged = [df.withColumn("kind", F.lit(kind)) for kind, df in branches.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_inputs(inputs: list[DataFrame]) -> DataFrame:
    """One operator reading several streams of the same shape."""
    return reduce(DataFrame.unionByName, inputs)


def dispatch(df: DataFrame, kind: str, columns: list[str], tag: str = "kind") -> DataFrame:
    """The rows of one kind with the columns that kind has."""
    return df.where(F.col(tag) == kind).select(*columns)


def data_events_only(df: DataFrame, tag: str = "event_class") -> DataFrame:
    """Leave out control events, which never reach user functions."""
    return df.where(F.col(tag) == "data")


def assert_channel(df: DataFrame, dest: str, instance: Column | None = None) -> DataFrame:
    """Fail the query if a row was delivered to another instance than its destination.

    The check is part of the ``dest`` column itself, so the optimizer cannot leave it out while
    the column is used.
    """
    instance = F.spark_partition_id() if instance is None else instance
    message = F.lit("a row reached a task that is not its destination")
    checked = F.when(F.col(dest) == instance, F.col(dest)).otherwise(
        F.raise_error(message).cast("int")
    )
    return df.withColumn(dest, checked)


def in_channel_order(df: DataFrame, channel: str, seq: str) -> DataFrame:
    """First-in first-out order per channel.

    Partitions are ranges of ``(channel, seq)``: each one is in order, and so are the partitions
    among themselves. A large channel takes several partitions.
    """
    return df.repartitionByRange(channel, seq).sortWithinPartitions(channel, seq)


def debug_tap(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Count the rows that pass, without changing them, and take further aggregates if any are given.

    They are read from the query's progress, or from the table that ``streaming.metrics`` keeps.
    """
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])


def tap_rows(
    df: DataFrame, operator: str, instance: Column, instances: int, switches: DataFrame
) -> DataFrame:
    """Rows of the instances whose ``instance-output`` switch is ``with-log``.

    ``switches`` (``operator, instance, output``) is a topology view or a part of one; at most
    ``instances`` rows of it are broadcast.
    """
    on = switches.where((F.col("operator") == operator) & (F.col("output") == "with-log"))
    on = on.where(F.col("instance").between(0, instances - 1))
    on = on.select(F.col("instance").cast("int").alias("_instance")).distinct()
    tagged = df.withColumn("_instance", instance.cast("int"))
    return tagged.join(F.broadcast(on), "_instance", "left_semi").drop("_instance")
