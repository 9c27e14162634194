"""Word and event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.numbers import floored
from sluiceway.functions.time import bucket_start
from sluiceway.operators.lookup import HOT_ROWS, same_keys
from sluiceway.operators.ordinal import running_ordinal
from sluiceway.operators.rows import merge_inputs


def word_count(words: DataFrame, word: str = "word") -> DataFrame:
    """Total per word, counted before and after the shuffle; works on streams."""
    return words.groupBy(word).agg(F.count(F.lit(1)).alias("cnt"))


def running_count(
    words: DataFrame,
    order: list[str],
    word: str = "word",
    start: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For every row the count of its word so far, in the given order.

    ``start`` (``word, cnt``) continues from counts reached before. No task gets all rows of a
    frequent word. A null word is counted like any other.
    """
    return running_ordinal(words, [word], order, "cnt", hot_rows, start)


def shared_count(jobs: list[DataFrame], word: str = "word") -> DataFrame:
    """Counters named by the bare word: all jobs add to the same count."""
    return word_count(merge_inputs([job.select(word) for job in jobs]), word)


def event_rates(events: DataFrame, sources: list[str], ms: str) -> DataFrame:
    """Rows per source and second of event time."""
    second = bucket_start(F.col(ms), 1000).alias("second")
    return events.groupBy(*sources, second).agg(F.count(F.lit(1)).alias("rate_counter"))


def event_counters(events: DataFrame, source: str, ms: str, block_ms: int = 1 << 22) -> DataFrame:
    """Rows per source and second of event time, and the source's total up to that second.

    Seconds are summed in blocks of about an hour, the totals before a block come from a table
    with one row per source and block, so that no task sorts all seconds of a source.
    """
    per_second = event_rates(events, [source], ms).withColumn("_block", floored(F.col("second"), block_ms))
    blocks = per_second.groupBy(source, "_block").agg(F.sum("rate_counter").alias("_n"))
    earlier = Window.partitionBy(source).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(source, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(source, "_block").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    total = (F.sum("rate_counter").over(inside) + F.col("_before")).alias("event_counter")
    joined = same_keys(per_second, before, [source, "_block"])
    return joined.select(source, "second", "rate_counter", total)
