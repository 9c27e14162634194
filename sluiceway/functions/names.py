"""Names built from and parsed into parts: channel names, control keys, printed lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSTANCE_KEY = r"^(.*)-(\d+)$"


def queue_name(stream: Column, channel: Column) -> Column:
    return F.concat_ws("-", stream, channel.cast("string"))


def key_attribute(key: Column) -> Column:
    """``instance-status-3`` -> ``instance-status``; a key without instance is its own attribute."""
    return F.when(key.rlike(_INSTANCE_KEY), F.regexp_extract(key, _INSTANCE_KEY, 1)).otherwise(key)


def key_instance(key: Column) -> Column:
    """``instance-status-3`` -> 3; null for a key of the whole operator."""
    return F.when(key.rlike(_INSTANCE_KEY), F.regexp_extract(key, _INSTANCE_KEY, 2).cast("int"))


def join_ids(ids: Column) -> Column:
    return F.array_join(ids, ",")


def split_ids(text: Column) -> Column:
    return F.split(text, ",")


def count_line(word: Column, count: Column) -> Column:
    return F.concat(word, F.lit(": "), count.cast("string"))


def row_line(*columns: Column) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in columns])


def task_line(task: Column, message: Column) -> Column:
    return F.format_string("[%s] Message: %s", task, message)
