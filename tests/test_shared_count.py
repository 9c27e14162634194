"""Counters of several running queries, and metrics that are read back."""

from __future__ import annotations

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from sluiceway.operators.rows import debug_tap
from sluiceway.session import shared_dir
from sluiceway.streaming import metrics
from sluiceway.streaming.runs import drain
from sluiceway.streaming.shared_count import shared_count_stream, shared_totals
from sluiceway.streaming.sinks import discard_sink


def forget_commit(checkpoint, number):
    """As if the query had ended after its micro-batch's work and before its commit."""
    for name in (str(number), f".{number}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def test_two_live_writers(spark):
    rng = random.Random(5)
    root, jobs, want = shared_dir(spark, "test-shared"), ["a", "b"], Counter()

    def start(job):
        words = spark.readStream.schema("word string").parquet(f"{root}/in-{job}")
        return shared_count_stream(words, f"{root}/counters", job, f"{root}/{job}").trigger(availableNow=True).start()

    def now():
        return {r.word: r.cnt for r in shared_totals(spark, f"{root}/counters", jobs).collect()}

    for part in range(2):
        for job in jobs:
            words = [rng.choice(["hot", "hot", "x", "", None, job]) for _ in range(50)]
            want.update(words)
            spark.createDataFrame([(w,) for w in words], "word string").write.mode("append").parquet(f"{root}/in-{job}")
        for query in [start(job) for job in jobs]:
            query.awaitTermination()
        assert now() == want
        forget_commit(f"{root}/a", part)  # its micro-batch is done again
        start("a").awaitTermination()
        assert now() == want
    only_a = shared_totals(spark, f"{root}/counters", ["a", "not-begun"])
    assert only_a.agg(F.sum("cnt")).first()[0] == 100


def test_metrics_of_micro_batches(spark):
    root = shared_dir(spark, "test-metrics")

    def run(n):
        stream = spark.readStream.schema("id long").parquet(f"{root}/in")
        drain(discard_sink(debug_tap(stream, "tap", top=F.max("id")), f"{root}/checkpoint"))

    with metrics.recorded(spark, f"{root}/metrics"):
        for n in range(3):
            spark.range(10 * n, 10 * n + n + 1).write.mode("append").parquet(f"{root}/in")
            run(n)
        forget_commit(f"{root}/checkpoint", 2)  # runs again and is counted once
        run(2)
    spark.range(5).write.mode("append").parquet(f"{root}/in")
    run(3)  # nobody records any more
    seen = metrics.recorded_metrics(spark, f"{root}/metrics")
    assert seen.select("query").distinct().count() == 1
    got = {(r.batch, r.name, r.metric): r.value for r in seen.collect()}
    assert got == {(n, "tap", m): v for n in range(3) for m, v in (("rows", n + 1), ("top", 11 * n))}
    assert seen.count() == 6


def test_tap_of_a_table(spark):
    rows, seen = metrics.tap(spark.range(100), odd=F.count_if(F.col("id") % 2 == 1))
    assert rows.agg(F.sum("id")).first()[0] == 4950
    assert seen.get == {"rows": 100, "odd": 50}
