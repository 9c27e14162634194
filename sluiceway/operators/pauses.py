"""Pausing single instances: their rows are held and come out when the instance resumes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.model import PAUSED
from sluiceway.operators.asof import asof_join
from sluiceway.operators.lookup import HOT_ROWS
from sluiceway.operators.ordinal import running_ordinal
from sluiceway.session import written


def hold_rows(
    rows: DataFrame, changes: DataFrame, keys: list[str], seq: str, status: str = "status", start: DataFrame | None = None
) -> DataFrame:
    """Add ``held`` and ``release``: whether a row's instance is paused when it comes, and when it goes on.

    ``changes`` (``keys, seq, status``) are control rows in the same order as the rows; ``seq`` is a
    whole number, unique over both. An instance is paused from a control row with ``PAUSED`` to its
    next one with another status (null included); repeated ones change nothing. Instances without
    a control row so far have the status in ``start`` (``keys, status``), or run. ``release`` is the
    row's own ``seq`` if it is not held, otherwise that of the control row that lets its instance go
    on, or null where there is none. Null keys are an instance like any other.

    Both ends of a pause come from as-of joins, the second one backwards and with the held rows
    only, so an instance with a third of all rows is spread over many tasks.
    """
    state, back = (f"{c}_{uuid.uuid4().hex[:8]}" for c in ("state", "back"))
    versions = changes.select(*keys, seq, F.col(status).alias(state))
    start = None if start is None else start.select(*keys, F.col(status).alias(state))
    known = asof_join(rows, versions, keys, seq, [state], start)
    known = written(known.withColumn("held", F.coalesce(F.col(state) == PAUSED, F.lit(False))).drop(state), "pause-known")
    resumes = versions.where(F.coalesce(F.col(state) != PAUSED, F.lit(True)))
    resumes = resumes.select(*keys, (-F.col(seq)).alias(back), F.col(seq).alias("release"))
    waiting = asof_join(known.where("held").withColumn(back, -F.col(seq)), resumes, keys, back, ["release"])
    going = known.where("not held").withColumn("release", F.col(seq).cast(waiting.schema["release"].dataType))
    return going.unionByName(waiting.drop(back))


def resequenced(
    released: DataFrame, seq: str, name: str = "position", start: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Released rows with their place in the output, from ``start + 1`` on.

    Rows that a pause held stand where their instance resumed, in their own order and ahead of all
    later rows. Rows that nothing has released yet are left out.
    """
    numbered = running_ordinal(released.where("release is not null"), [], ["release", seq], name, hot_rows)
    return numbered.withColumn(name, F.col(name) + F.lit(start).cast("long"))
