"""Which channel a row goes to. Each function gives an int column or adds one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.hashing import key_hash
from sluiceway.model import StreamSpec
from sluiceway.operators.lookup import HOT_ROWS
from sluiceway.operators.ordinal import running_ordinal


def hash_channel(df: DataFrame, key: str, n: int) -> Column:
    """``abs(hash % n)``; a null key is an error."""
    hashed = key_hash(F.col(key), dict(df.dtypes)[key])
    channel = F.abs(hashed % F.lit(n)).cast("int")
    missing = F.raise_error(F.lit(f"null key in column {key}")).cast("int")
    return F.when(F.col(key).isNull(), missing).otherwise(channel)


def rebalance_channel(
    df: DataFrame, n: int, order: list[str], name: str = "ch", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Round robin in the given order; the first row goes to channel ``1 % n``."""
    ranked = running_ordinal(df, [], order, "_rank", hot_rows)
    return ranked.withColumn(name, (F.col("_rank") % n).cast("int")).drop("_rank")


def rebalance_indexed(index: Column, n: int) -> Column:
    """Round robin for sources that already carry an index from 0; needs no ordering."""
    return F.pmod(index + 1, F.lit(n)).cast("int")


def forward_channel(n: int, instance: Column | None = None) -> Column:
    """Same instance index, modulo ``n``. A narrow dependency: nothing moves."""
    instance = F.spark_partition_id() if instance is None else instance
    return F.when(instance >= 0, instance % n).otherwise(_bad_instance(instance)).cast("int")


def direct_channel(n: int, dest: Column) -> Column:
    """The row's own destination, which must lie in ``[0, n)``."""
    valid = (dest >= 0) & (dest < n)
    return F.when(valid, dest).otherwise(_bad_instance(dest)).cast("int")


def _bad_instance(value: Column) -> Column:
    message = F.concat(F.lit("no such channel: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.raise_error(message).cast("int")


def channel_for(
    df: DataFrame,
    spec: StreamSpec,
    name: str = "ch",
    instance: Column | None = None,
    order: list[str] | None = None,
    custom: Column | None = None,
) -> DataFrame:
    """Add the channel that the stream's descriptor asks for."""
    n = spec.parallelism
    if spec.mode == "hash":
        return df.withColumn(name, hash_channel(df, spec.key, n))
    if spec.mode == "forward":
        return df.withColumn(name, forward_channel(n, instance))
    if spec.mode == "direct":
        return df.withColumn(name, direct_channel(n, F.col(spec.key or "dest")))
    if spec.mode == "custom":
        if custom is None:
            raise ValueError("a custom stream needs a channel column")
        return df.withColumn(name, direct_channel(n, custom))
    if order is None:
        raise ValueError("round robin needs the arrival order")
    return rebalance_channel(df, n, order, name)


def deliver(df: DataFrame, n: int, channel: str = "ch") -> DataFrame:
    """Move each row to the partition with the number of its channel.

    Spark wraps partition ids that are out of range, so the range is checked first.
    """
    return df.withColumn(channel, direct_channel(n, F.col(channel))).repartitionById(n, channel)
