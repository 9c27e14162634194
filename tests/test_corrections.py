"""Joins and counts of windows whose rows arrive in any order."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from sluiceway.session import shared_dir
from sluiceway.streaming.corrections import (
    counts_table,
    folded,
    tumbling_counts_delta_stream,
    window_join_delta_stream,
)
from sluiceway.streaming.runs import drain
from sluiceway.streaming.segments import Segments
from sluiceway.streaming.tables import all_batches

WIDTH = 100
SCHEMA = "id long, k int, ms long, kind string"


def some_rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if rng.random() < 0.3 else rng.choice([2, 3, 4, 5, None])
        ms = None if rng.random() < 0.05 else rng.randrange(-500, 1500)
        out.append((i, key, ms, rng.choice(["a", "b", "c"])))
    return out


def arrive(spark, rows, cuts, build):
    """One micro-batch for each file, in one run of the query."""
    folder = shared_dir(spark, "test-arrivals")
    df = spark.createDataFrame(rows, SCHEMA)
    for at, part in enumerate(cuts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        name = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(name, (at + 1, at + 1))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return drain(build(stream))


def dealt_out(rows, parts, seed):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return [rows[i::parts] for i in range(parts)]


def pairs_of(rows):
    out = Counter()
    for a in rows:
        for b in rows:
            if a[3] == "a" and b[3] == "b" and a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]):
                if a[2] // WIDTH == b[2] // WIDTH:
                    out[a[1], a[2] // WIDTH * WIDTH, a[0], b[0]] += 1
    return out


@pytest.mark.parametrize("fan", [2, 8])
def test_join_in_five_shuffled_batches(spark, fan):
    rows = some_rows(1, 300)
    root = shared_dir(spark, "test-delta-join")

    def build(stream):
        columns = ({"id": "left_id"}, {"id": "right_id"})
        return window_join_delta_stream(
            stream, ("a", "b"), "k", "ms", WIDTH, columns, root, f"{root}/checkpoint", buckets=4, fan=fan
        )

    arrive(spark, rows, dealt_out(rows, 5, 2), build)
    out = all_batches(spark, f"{root}/out", "k int, window_ms long, left_id long, right_id long, batch int")
    got = Counter(tuple(r) for r in out.select("k", "window_ms", "left_id", "right_id").collect())
    assert got == pairs_of(rows)
    assert out.select("batch").distinct().count() == 5


def test_counts_are_corrected(spark):
    rows = some_rows(3, 200)
    root = shared_dir(spark, "test-delta-counts")
    build = lambda s: tumbling_counts_delta_stream(s, "ms", WIDTH, root, f"{root}/checkpoint", 4, 2)
    parts = dealt_out(rows, 5, 4)
    arrive(spark, rows, parts, build)
    window = lambda r: None if r[2] is None else r[2] // WIDTH * WIDTH
    expected = Counter(window(r) for r in rows)
    assert dict(map(tuple, folded(spark, f"{root}/out", "window_ms long, cnt long").collect())) == expected
    kept = counts_table(spark.createDataFrame([], "window_ms long"), ["window_ms"], root, 4, 2)
    assert dict(map(tuple, kept.at(spark, 4).collect())) == expected
    log = all_batches(spark, f"{root}/out", "window_ms long, cnt long, diff int, batch int").collect()
    so_far = Counter()
    for at, part in enumerate(parts):
        before, so_far = so_far, so_far + Counter(map(window, part))
        changed = {w for w in so_far if so_far[w] != before[w]}
        told = Counter((r.window_ms, r.cnt, r.diff) for r in log if r.batch == at)
        given = Counter((w, so_far[w], 1) for w in changed)
        assert told == given + Counter((w, before[w], -1) for w in changed if before[w])


def table_of(spark, keys=None, fan=2):
    root = shared_dir(spark, "test-segments")
    return Segments(root, "k int, v long", ["k"], keys, buckets=4, fan=fan)


def test_segments_merge_and_repeat(spark):
    """Merged or not, run once or again, a table has every micro-batch's rows once."""
    kept, rows = table_of(spark), []
    for n in range(11):
        added = [(k, n) for k in range(n % 3)] + [(None, n)]
        before = Counter(map(tuple, kept.at(spark, n - 1).collect()))
        assert before == Counter(rows)
        df = spark.createDataFrame(added, "k int, v long")
        kept.put(df, n)
        if n in (2, 4, 8):
            assert Counter(map(tuple, kept.at(spark, n - 1).collect())) == before
            kept.put(df, n)
        rows += added
    assert len(kept._complete(spark)) <= 4


def test_segments_newest_row_stands(spark):
    kept, newest = table_of(spark, ["k"]), {}
    for n in range(9):
        changed = {k: 10 * n + k for k in range(n % 4)}
        kept.put(spark.createDataFrame(list(changed.items()), "k int, v long"), n)
        newest |= changed
        assert dict(map(tuple, kept.at(spark, n).collect())) == newest


def test_unfinished_merge_is_not_read(spark):
    kept = table_of(spark, fan=8)
    for n in range(3):
        kept.put(spark.createDataFrame([(n, n)], "k int, v long"), n)
    os.makedirs(f"{kept.path}/batches_=0-1")
    assert kept.at(spark, 2).count() == 3


def test_only_touched_buckets_are_read(spark):
    kept = table_of(spark)
    kept.put(spark.createDataFrame([(k, k) for k in range(100)], "k int, v long"), 0)
    near = spark.createDataFrame([(7, 0)], "k int, v long")
    some = kept.at(spark, 0, near=near)
    assert some.where("k = 7").count() == 1
    assert len(some.inputFiles()) <= len(kept.at(spark, 0).inputFiles())
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket_" in plan.split("PartitionFilters")[1].split("]")[0]
    assert kept.at(spark, 0, near=near.limit(0)).count() == 0
