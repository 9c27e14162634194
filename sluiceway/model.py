"""Schemas (as DDL text) and stream descriptors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

LINE = "idx LONG, line STRING"
WORD_COUNT = "word STRING, cnt LONG"
PERSON = "id LONG, name STRING, email STRING, city STRING, ts TIMESTAMP"
AUCTION = "id LONG, item STRING, seller LONG, category LONG, initial_bid LONG, reserve LONG, ts TIMESTAMP"
OPERATOR_INSTANCE = "operator STRING, instance INT, parallelism INT"
CHANGELOG = "seq LONG, tbl STRING, key STRING, op STRING, value STRING"
CHANNEL_TABLE = "stream STRING, channel INT, queue STRING"

NATIVE, DURABLE = 0, 1  # channel_type of a row
RUNNING, PAUSED = "Running", "Paused"  # status of an operator instance


def new_stream_id() -> str:
    """Stream ids are drawn once while a job is built, never per row."""
    return str(uuid.uuid4())


@dataclass(frozen=True)
class StreamSpec:
    """A named output stream: its channel count, how rows pick a channel, and the key column.

    ``mode`` is ``hash``, ``rebalance``, ``forward``, ``direct`` or ``custom``.
    """

    parallelism: int
    mode: str
    key: str | None = None
    id: str = field(default_factory=new_stream_id)

    def __post_init__(self) -> None:
        if self.parallelism < 1:
            raise ValueError("a stream needs at least one channel")
        if self.mode not in ("hash", "rebalance", "forward", "direct", "custom"):
            raise ValueError(f"unknown partitioning mode: {self.mode}")
        if self.mode == "hash" and self.key is None:
            raise ValueError("hash partitioning needs a key column")

    def queue(self, channel: int) -> str:
        """Physical name of one channel."""
        return f"{self.id}-{channel}"
