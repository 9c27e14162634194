"""Keyed state of user functions: put and get per key, read back, and taken over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sluiceway.session import use_rocksdb

ROWS_OUT = 100_000


class CountingState(StatefulProcessor):
    """Emits the count so far for every row of a key, in the order of ``order`` in a micro-batch.

    The key's rows of a micro-batch are held as two columns of numbers, not as Python objects.
    """

    def __init__(self, key: str, order: str):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "cnt long")

    def get(self) -> int:
        return self.count.get()[0] if self.count.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        so_far = self.get()
        places = np.sort(np.concatenate([batch[self.order].to_numpy() for batch in rows]))
        self.count.update((so_far + len(places),))
        for at in range(0, len(places), ROWS_OUT):
            part = places[at : at + ROWS_OUT]
            counts = so_far + at + 1 + np.arange(len(part))
            yield pd.DataFrame({self.order: part, self.key: key[0], "cnt": counts})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.count.update((int(initialState["cnt"].iloc[0]),))

    def close(self) -> None:
        pass


def counting_state(
    rows: DataFrame, key: str, order: str, key_type: str = "string", start: DataFrame | None = None
) -> DataFrame:
    """``order, key, cnt`` for every row of a stream; ``order`` is a unique whole number.

    ``start`` (``key, cnt``) is the state another query left. One task takes a key's rows of a
    micro-batch; keys that are too frequent for that belong to ``running_count_stream``.
    """
    use_rocksdb(rows.sparkSession)
    return rows.select(order, key).groupBy(key).transformWithStateInPandas(
        statefulProcessor=CountingState(key, order),
        outputStructType=f"{order} long, {key} {key_type}, cnt long",
        outputMode="Append",
        timeMode="None",
        initialState=None if start is None else start.select(key, "cnt").groupBy(key),
    )


def read_state(spark: SparkSession, checkpoint: str, name: str = "count") -> DataFrame:
    """State of a stopped query: key columns and value columns."""
    store = spark.read.format("statestore").option("path", checkpoint)
    return store.option("stateVarName", name).load().select("key.*", "value.*")
