"""As-of joins and live channel tables next to a sequential fold."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from sluiceway.operators.asof import asof_join, live_table_after, route_by_live_table
from sluiceway.session import shared_dir
from sluiceway.streaming.routing import route_live_stream
from sluiceway.streaming.runs import drain
from sluiceway.streaming.tables import all_batches

LOG = "seq long, ch int, op string, extra string"


def log_of(seed, n, hot=0.6):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        ch = 0 if rng.random() < hot else rng.choice([1, 2, 3, None])
        op = rng.choice([None, None, None, None, "put", "remove", "putIfAbsent"])
        out.append((seq, ch, op, f"x{seq}"))
    return out


def fold(log):
    listed, last, out = {}, {}, Counter()
    for seq, ch, op, extra in sorted(log):
        if op is not None:
            listed[ch] = op != "remove"
            continue
        kind = int(listed.get(ch, False))
        before = last.get(ch, kind)
        out[seq, ch, extra, kind, before != kind, before] += 1
        last[ch] = kind
    return out


def parts(spark, log):
    df = spark.createDataFrame(log, LOG)
    return df.where("op is null").drop("op"), df.where("op is not null").select("ch", "seq", "op")


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_batch_equals_fold(spark, n):
    log = log_of(n, n)
    rows, changes = parts(spark, log)
    got = route_by_live_table(rows, changes).select("seq", "ch", "extra", "channel_type", "switched", "path").collect()
    assert Counter(map(tuple, got)) == fold(log)


def test_in_stretches(spark):
    log = log_of(3, 300)
    start, got = None, Counter()
    for at in (slice(0, 40), slice(40, 41), slice(41, 200), slice(200, 300)):
        rows, changes = parts(spark, log[at])
        routed = route_by_live_table(rows, changes, start=start)
        got += Counter(map(tuple, routed.select("seq", "ch", "extra", "channel_type", "switched", "path").collect()))
        state = live_table_after(routed, changes, start=start).collect()
        start = spark.createDataFrame(state, "ch int, listed boolean, last_type int")
    assert got == fold(log)


def test_stream_equals_fold(spark):
    log = log_of(11, 240)
    root = shared_dir(spark, "test-live")
    df = spark.createDataFrame(log, LOG)
    for low, high in ((0, 100), (100, 101), (101, 240)):
        df.where(f"seq >= {low} and seq < {high}").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(LOG).parquet(f"{root}/in")
        drain(route_live_stream(stream, root, f"{root}/checkpoint"))
    out = all_batches(spark, f"{root}/out", "seq long, ch int, extra string, channel_type int, switched boolean, path int")
    got = out.select("seq", "ch", "extra", "channel_type", "switched", "path").collect()
    assert Counter(map(tuple, got)) == fold(log)


def test_asof_values_and_ties(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5), (None, 7)], "k string, at int")
    versions = spark.createDataFrame([("a", 5, "v", 1), ("a", 8, None, 2), (None, 1, "n", 3)], "k string, at int, v string, w int")
    start = spark.createDataFrame([("a", "s", 0), ("b", "t", 4)], "k string, v string, w int")
    got = asof_join(rows, versions, ["k"], "at", ["v", "w"], start).collect()
    assert {(r.k, r["at"], r.v, r.w) for r in got} == {
        ("a", 1, "s", 0), ("a", 5, "v", 1), ("a", 9, None, 2), ("b", 5, "t", 4), (None, 7, "n", 3)}
