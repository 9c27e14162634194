"""One counter per word that several running queries add to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.operators.counting import word_count
from sluiceway.operators.lookup import same_keys
from sluiceway.session import written
from sluiceway.streaming.runs import with_batches
from sluiceway.streaming.segments import Segments


def _totals_of(path: str, job: str, kind: str) -> Segments:
    return Segments(f"{path}/job={job}", f"word {kind}, cnt long", ["word"], ["word"])


def shared_count_stream(words: DataFrame, path: str, job: str, checkpoint: str) -> DataStreamWriter:
    """Add a stream's words to the counters in ``path`` under the name ``job``, one name per query.

    A grow-only counter: each job keeps its own total per word and writes no other's, so jobs need
    no lock and may run at once. A micro-batch reads and writes the buckets of its own words. One
    that runs again starts from what the one before left and overwrites itself, so nothing counts twice.
    """

    def handle(batch: DataFrame, number: int) -> None:
        kept = _totals_of(path, job, batch.schema["word"].dataType.simpleString())
        counts = written(word_count(batch), "shared-counts")
        before = kept.at(batch.sparkSession, number - 1, near=counts).withColumnRenamed("cnt", "_before")
        now = F.col("cnt") + F.coalesce("_before", F.lit(0))
        kept.put(same_keys(counts, before, ["word"], "left").select("word", now.alias("cnt")), number)

    return with_batches(words.select("word"), checkpoint, handle)


def shared_totals(spark: SparkSession, path: str, jobs: list[str], kind: str = "string") -> DataFrame:
    """``word, cnt``: the newest totals of all jobs, added up; jobs that have not begun count nothing.

    Finished micro-batches only. Jobs that run on merge old segments from time to time; a read that
    loses its files to this is to be made again.
    """
    mine = [_totals_of(path, job, kind) for job in jobs]
    totals = [kept.at(spark, kept.last(spark)) for kept in mine]
    both = reduce(DataFrame.unionByName, totals)
    return both.groupBy("word").agg(F.sum("cnt").alias("cnt"))
