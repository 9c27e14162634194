"""Counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.operators.counting import running_count, word_count
from sluiceway.operators.lookup import HOT_ROWS, same_keys
from sluiceway.session import written
from sluiceway.streaming.runs import with_batches
from sluiceway.streaming.segments import Segments
from sluiceway.streaming.tables import put_batch


def word_count_stream(words: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Totals per word; each batch writes the words it changed (see ``latest_rows``)."""

    def handle(batch: DataFrame, number: int) -> None:
        put_batch(batch, path, number)

    return with_batches(word_count(words), checkpoint, handle, "update")


def running_count_stream(
    words: DataFrame,
    order: list[str],
    path: str,
    checkpoint: str,
    start: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataStreamWriter:
    """The count so far for every row, rows ordered by ``order`` inside a micro-batch.

    The counters are a bucketed table next to the output (``path/state``), of which a micro-batch
    reads the buckets of its words and to which it writes the words it has changed: they outlive
    the query, and ``start`` takes over those of another one. A micro-batch is counted by the batch
    operator, so a word with a third of all rows is still spread.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept, before = _state(batch.schema["word"].dataType.simpleString(), path), None
        if number > 0 or start is not None:
            counts = written(word_count(batch), "batch-counts")
            before = kept.at(spark, number - 1, near=counts)
            if start is not None:
                before = add_missing(before, start)
            before = written(same_keys(counts.select("word"), before, ["word"]), "counts-before")
        put_batch(running_count(batch, order, start=before, hot_rows=hot_rows), f"{path}/out", number)
        out = spark.read.schema(kept.schema).parquet(f"{path}/out/batch={number}")
        kept.put(out.groupBy("word").agg(F.max("cnt").alias("cnt")), number)

    return with_batches(words, checkpoint, handle)


def _state(kind: str, path: str) -> Segments:
    return Segments(f"{path}/state", f"word {kind}, cnt long", ["word"], ["word"])


def add_missing(now: DataFrame, start: DataFrame) -> DataFrame:
    """``now`` and the words of ``start`` that it doesn't have yet."""
    old = start.select("word", "cnt").withColumnsRenamed({"word": "_word"})
    missing = old.join(now.select("word"), F.col("_word").eqNullSafe(F.col("word")), "left_anti")
    return now.select("word", "cnt").union(missing)


def counters(spark: SparkSession, path: str, start: DataFrame | None = None) -> DataFrame | None:
    """The counters a running count has reached; those of ``start`` that it didn't touch as well."""
    kept = _state("string", path)
    last = kept.last(spark)
    now = None if last < 0 else kept.at(spark, last)
    return now if start is None else start if now is None else add_missing(now, start)
