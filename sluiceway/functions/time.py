"""Event time as whole milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_ms(df: DataFrame, column: str) -> Column:
    """Milliseconds of a timestamp column; zone-less timestamps are read as UTC."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        return F.expr(f"(`{column}` - timestamp_ntz'1970-01-01') div interval '0.001' second")
    if kind == "timestamp":
        return F.unix_millis(F.col(column))
    if kind == "bigint":
        return F.col(column)
    raise TypeError(f"{column} is no event time: {kind}")


def now_ms() -> Column:
    """Wall-clock milliseconds; one value per query or micro-batch."""
    return F.unix_millis(F.current_timestamp())


def from_ms(ms: Column) -> Column:
    """Zone-less timestamp of a number of milliseconds (UTC)."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        secs=ms.cast("decimal(18,0)") / F.lit(1000).cast("decimal(6,0)")
    )


def bucket_start(ms: Column, width_ms: int) -> Column:
    """Start of the aligned window of ``width_ms`` that holds ``ms``; exact below zero too."""
    return ms - F.pmod(ms, F.lit(width_ms).cast("long"))
