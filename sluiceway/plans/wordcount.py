"""The first job: lines, words, running counts per word."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sluiceway.operators.counting import running_count
from sluiceway.operators.rows import tokenize


def wordcount(lines: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``word, cnt`` for every word in the order of lines and places (also ``idx, pos``).

    ``start`` continues the counts of an earlier job.
    """
    return running_count(tokenize(lines, "line"), ["idx", "pos"], start=start)
