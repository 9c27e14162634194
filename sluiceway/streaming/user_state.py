"""User functions with value, list and map state on streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sluiceway.functions.numbers import floored
from sluiceway.operators.lookup import same_keys
from sluiceway.session import use_rocksdb

BLOCK = "block"
BLOCK_ROWS = 1 << 16  # places of the order per block, so at most as many rows in one group


class State:
    """What a user function may keep for its key and block: named values, lists and maps.

    Values are single columns of the types that the function declares; absent ones are ``None``.
    """

    def __init__(self, handle: StatefulProcessorHandle, values: dict[str, str], lists: dict[str, str], maps: dict[str, tuple[str, str]]):
        self._values = {n: handle.getValueState(n, f"value {t}") for n, t in values.items()}
        self._lists = {n: handle.getListState(n, f"value {t}") for n, t in lists.items()}
        self._maps = {n: handle.getMapState(n, f"map_key {k}", f"value {v}") for n, (k, v) in maps.items()}

    def get(self, name: str, default: Any = None) -> Any:
        kept = self._values[name]
        return kept.get()[0] if kept.exists() else default

    def put(self, name: str, value: Any) -> None:
        self._values[name].update((value,))

    def items(self, name: str) -> list:
        return [row[0] for row in self._lists[name].get()] if self._lists[name].exists() else []

    def put_items(self, name: str, items: list) -> None:
        """The whole list anew; an empty one is removed."""
        self._lists[name].put([(item,) for item in items]) if items else self._lists[name].clear()

    def append(self, name: str, item: Any) -> None:
        self._lists[name].appendValue((item,))

    def get_entry(self, name: str, key: Any, default: Any = None) -> Any:
        kept = self._maps[name]
        return kept.getValue((key,))[0] if kept.containsKey((key,)) else default

    def entries(self, name: str) -> dict:
        """The whole map, in one call and not one for every key; as large as its key and block have made it."""
        kept = self._maps[name]
        return {key[0]: value[0] for key, value in kept.iterator()} if kept.exists() else {}

    def put_entry(self, name: str, key: Any, value: Any) -> None:
        self._maps[name].updateValue((key,), (value,))

    def remove_entry(self, name: str, key: Any) -> None:
        self._maps[name].removeKey((key,))


class StateFunction:
    """What a user writes: the state's names and types, the output, and what to do with rows.

    ``process`` gets the key, one micro-batch's rows of the key and block in their order, and the
    state that earlier micro-batches left; it gives back rows of ``output``, without key and block.
    State names differ from each other.
    """

    values: dict[str, str] = {}
    lists: dict[str, str] = {}
    maps: dict[str, tuple[str, str]] = {}
    output: str

    def process(self, key: Any, rows: pd.DataFrame, state: State) -> pd.DataFrame:
        raise NotImplementedError


class _Processor(StatefulProcessor):
    def __init__(self, function: StateFunction, key: str, order: str):
        self.function, self.key, self.order = function, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        f = self.function
        self.state = State(handle, f.values, f.lists, f.maps)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        mine = pd.concat(rows).sort_values(self.order, kind="stable", ignore_index=True)
        out = self.function.process(key[0], mine, self.state)
        out.insert(0, BLOCK, key[1])
        out.insert(0, self.key, key[0])
        yield out

    def close(self) -> None:
        pass


def with_state(rows: DataFrame, key: str, order: str, function: StateFunction, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of a user function with state, as ``key, block`` and the columns of its ``output``.

    State is kept per key and block: ``block`` is ``order`` (a unique whole number) divided by
    ``block_rows``, rounded down. So a group has at most ``block_rows`` rows, whatever its key's share
    of all rows, and blocks of one key run side by side. A function whose results reach across
    blocks has what the blocks before bring added afterwards (``earlier_sums``). Rows of a block
    come in their order from micro-batch to micro-batch. A null key is a key.
    """
    use_rocksdb(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    blocked = rows.withColumn(BLOCK, floored(F.col(order), block_rows))
    return blocked.groupBy(key, BLOCK).transformWithStateInPandas(
        statefulProcessor=_Processor(function, key, order),
        outputStructType=f"{key} {kind}, {BLOCK} long, {function.output}",
        outputMode="Append",
        timeMode="None",
    )


def kept_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A named state as a stopped query left it: key, block and ``value``.

    A list has one row per item, a map one per entry, with ``map_key``.
    """
    store = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    parts = [c for c in ("key", "user_map_key", "user_map_value", "list_element", "value") if c in store.columns]
    return store.select(*[f"{part}.*" for part in parts])


def earlier_sums(sums: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, block, name``: the sum of ``value`` over the blocks before, one row per key and block."""
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, BLOCK, F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name))


def across_blocks(rows: DataFrame, sums: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` (so far in its block) made the value so far in all blocks.

    ``sums`` (``keys, block, value``) is what each block has come to.
    """
    before = earlier_sums(sums, keys, value, "_before")
    known = same_keys(rows, before, [*keys, BLOCK])
    return known.withColumn(value, F.col(value) + F.col("_before")).select(*rows.columns)
