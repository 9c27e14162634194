"""Moving a running operator from one query to another without losing or repeating rows.

1. The operator's input is parked in durable channels (``channel_write``), its output goes to a
   table. 2. The channel opens a new epoch; the old query drains the epochs before it and stops.
3. Its state is read. 4. The new query starts from that state with the new epoch, and writes
where the old one wrote to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.operators.control import PUT, PUT_IF_ABSENT
from sluiceway.sources.channel import channel_stream
from sluiceway.streaming.runs import PAUSED, RUNNING, drain


@dataclass
class Operator:
    """One side of a handover.

    ``build(input, checkpoint, state)`` gives the writer; ``state(checkpoint)`` what it left.
    """

    checkpoint: str
    build: Callable[[DataFrame, str, DataFrame | None], DataStreamWriter]
    state: Callable[[str], DataFrame]


def handover(
    spark: SparkSession,
    channel: str,
    schema: str,
    old: Operator,
    new: Operator,
    cut: int,
    stream: str = "in",
    channels: list[int] | None = None,
) -> None:
    """``old`` takes the epochs before ``cut``, ``new`` goes on from its state with the rest."""
    schema = f"{schema}, channel int, epoch int"
    first = channel_stream(spark, {stream: channel}, schema, channels, (0, cut - 1))
    drain(old.build(first, old.checkpoint, None))
    rest = channel_stream(spark, {stream: channel}, schema, channels, (cut, None))
    drain(new.build(rest, new.checkpoint, old.state(old.checkpoint)))


def handover_changes(
    old_job: str,
    new_job: str,
    operator: str,
    inputs: dict[str, int],
    output: str,
    instances: list[int] | None = None,
) -> list[tuple[str, str, str, str]]:
    """Control rows ``(tbl, key, op, value)`` that move an operator's instances, by default all.

    ``inputs`` maps the operator's input streams to their parallelism. Rows are in the order they
    have to be applied: buffer the channels, pause the old instances, point the new ones at the
    buffered input and the old output, run.
    """
    n = max(inputs.values())
    moved = list(range(n)) if instances is None else instances
    old_table, new_table = f"{old_job}-task-{operator}", f"{new_job}-task-{operator}"
    changes = [
        (stream, str(i), PUT_IF_ABSENT, f"{stream}-{i}")
        for stream, channels in {**inputs, output: n}.items()
        for i in moved
        if i < channels
    ]
    changes += [(old_table, f"instance-status-{i}", PUT, PAUSED) for i in moved]
    for i in moved:
        changes.append((new_table, f"input-stream-{i}", PUT, ",".join(inputs)))
        changes.append((new_table, f"output-stream-{i}", PUT, output))
        changes.append((new_table, f"instance-status-{i}", PUT, RUNNING))
    return changes
