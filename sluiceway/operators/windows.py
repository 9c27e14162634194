"""Aligned tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.time import bucket_start


def tumbling_counts(df: DataFrame, ms: str, width_ms: int) -> DataFrame:
    start = bucket_start(F.col(ms), width_ms).alias("window_ms")
    return df.groupBy(start).agg(F.count(F.lit(1)).alias("cnt"))
