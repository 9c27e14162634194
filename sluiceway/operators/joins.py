"""Window joins of two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.time import bucket_start
from sluiceway.operators.anchored import closed_windows, place_rows, window_edges


def window_join(
    left: DataFrame, right: DataFrame, key: tuple[str, str], ms: tuple[str, str], width_ms: int
) -> DataFrame:
    """Inner join on the key inside aligned tumbling windows; adds ``window_ms``, the start.

    ``key`` and ``ms`` name the key and event-time columns of the two sides. Window and key are
    both join keys, so one shuffle of the needed columns does it.
    """
    left = left.withColumn("window_ms", bucket_start(F.col(ms[0]), width_ms)).withColumn(
        "_key", F.col(key[0])
    )
    right = right.withColumn("window_ms", bucket_start(F.col(ms[1]), width_ms)).withColumn(
        "_key", F.col(key[1])
    )
    right = right.drop(*[c for c in (key[1], ms[1]) if c in left.columns])
    return left.join(right, ["_key", "window_ms"]).drop("_key")


def window_join_anchored(
    rows: DataFrame,
    left_kind: str,
    right_kind: str,
    channel: str,
    key: str,
    ms: str,
    tie: str,
    width_ms: int,
    left_columns: dict[str, str],
    right_columns: dict[str, str],
    carry: DataFrame | None = None,
) -> DataFrame:
    """Inner join of two kinds of rows inside the channel's first-event-anchored windows.

    Rows that close a window take no part, and neither does a window that never closes. All rows
    of a ``key`` must share a channel. ``*_columns`` map source to result names.
    """
    edges = window_edges(rows, channel, ms, tie, width_ms, carry)
    placed = place_rows(rows, edges, channel, ms, tie, width_ms, carry)
    closed = closed_windows(edges).withColumnRenamed("_ch", channel)
    inside = placed.where(~F.col("is_closer"))
    columns = (left_columns, right_columns)
    return join_placed(inside, closed, (left_kind, right_kind), channel, key, columns)


def join_placed(
    inside: DataFrame,
    closed: DataFrame,
    kinds: tuple[str, str],
    channel: str,
    key: str,
    columns: tuple[dict[str, str], dict[str, str]],
) -> DataFrame:
    """Join two kinds of placed rows per channel, closed window and key.

    ``closed`` has one row per channel; Spark broadcasts it if it is small. The filter on the kind reaches the scan of each side.
    """
    kept = inside.join(closed, channel).where(F.col("win") <= F.col("_closed"))
    on = [channel, "win", key]

    def side(kind: str, chosen: dict[str, str]) -> DataFrame:
        named = [F.col(c).alias(n) for c, n in chosen.items()]
        return kept.where(F.col("kind") == kind).select(*on, *named)

    return side(kinds[0], columns[0]).join(side(kinds[1], columns[1]), on)


def key_equality(left: DataFrame, right: DataFrame, left_key: int, right_key: int) -> DataFrame:
    """Inner equi-join on key field positions of two positional rows (columns ``l0.. r0..``)."""
    left = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    right = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    return left.join(right, left[f"l{left_key}"] == right[f"r{right_key}"])
