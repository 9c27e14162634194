"""Rate limits that hold rows back: when each row is let through."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.numbers import floored, whole
from sluiceway.operators.lookup import HOT_ROWS, same_keys
from sluiceway.operators.ordinal import running_ordinal


def admit(
    rows: DataFrame,
    keys: list[str],
    ms: str,
    order: list[str],
    rate: int,
    slot_ms: int = 1000,
    block_rows: int = 1 << 20,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``admitted``: the time at which a limit of ``rate`` rows per key and slot lets a row through.

    Rows of a key queue in the order of ``ms`` (event time, not null), then ``order``, which must be
    unique together. A row that needn't wait is admitted at its own time, another at the start of
    the first slot that still has room. A null key is a key; no ``keys`` means one queue.

    A queue served in turn is sequential as it is told, but has a closed form. Row i leaves one
    slot or more after row i - ``rate``, so rows i, i - rate, i - 2 rate, ... are a lane, in which
    the slot of the q-th row is the greatest (arrival - q') + q over the rows q' <= q. That is a
    running maximum: taken in blocks of a lane, with what is carried between blocks in a table of
    one row per lane and block. No task holds a lane or a key.
    """
    if rate < 1:
        raise ValueError("a rate limit lets at least one row through in a slot")
    number, lane, turn, lead, block, top = (f"{c}_{uuid.uuid4().hex[:8]}" for c in ("n", "lane", "turn", "lead", "block", "top"))
    queue = running_ordinal(rows, keys, [ms, *order], number, hot_rows)
    queue = queue.withColumn(lane, F.pmod(F.col(number) - 1, F.lit(rate))).withColumn(turn, whole(F.col(number) - 1, rate))
    queue = queue.withColumn(lead, floored(F.col(ms).cast("long"), slot_ms) - F.col(turn))
    queue = queue.withColumn(block, whole(F.col(turn), block_rows))
    tops = queue.groupBy(*keys, lane, block).agg(F.max(lead).alias(top))
    earlier = Window.partitionBy(*keys, lane).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    brought = tops.select(*keys, lane, block, F.max(top).over(earlier).alias(top))
    inside = Window.partitionBy(*keys, lane, block).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.withColumn(lead, F.max(lead).over(inside))
    known = same_keys(queue, brought, [*keys, lane, block], "left")
    slot = (F.greatest(lead, top) + F.col(turn)) * slot_ms
    return known.select(*rows.columns, F.greatest(F.col(ms).cast("long"), slot).alias("admitted"))
