"""Rate limits that hold rows back, pauses of single instances, seeded values: next to plain loops."""

from __future__ import annotations

import os
import random
import struct
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sluiceway.functions.numbers import seeded
from sluiceway.model import PAUSED, RUNNING, StreamSpec
from sluiceway.operators.admission import admit
from sluiceway.operators.pauses import hold_rows, resequenced
from sluiceway.session import shared_dir
from sluiceway.streaming.pauses import pausable_stream
from sluiceway.streaming.runs import drain
from sluiceway.streaming.tables import all_batches


def served(rows, rate, slot):
    """Serve each queue row by row: the next slot with room that isn't before the last one used."""
    out, at, used = {}, defaultdict(lambda: -(10**9)), defaultdict(int)
    for key, ms, n in sorted(rows, key=lambda r: (r[1], r[2])):
        now = max(ms // slot, at[key])
        if now == at[key] and used[key] == rate:
            now += 1
        if now > at[key]:
            used[key] = 0
        at[key] = now
        used[key] += 1
        out[n] = max(ms, now * slot)
    return out


@pytest.mark.parametrize("rate, block_rows", [(1, 4), (3, 2), (3, 1 << 20), (50, 8)])
def test_admission(spark, rate, block_rows):
    rng = random.Random(rate)
    # bursts, calm stretches, times before the epoch, ties, a key with most rows, a null key
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([-2500, 0, 100, rng.randrange(20000)]), n) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, ms long, n long")
    out = admit(df, ["k"], "ms", ["n"], rate, 1000, block_rows, hot_rows=50)
    assert out.columns == ["k", "ms", "n", "admitted"]
    assert {r.n: r.admitted for r in out.collect()} == served(rows, rate, 1000)


def test_admission_of_one_queue_and_of_nothing(spark):
    rows = [("x", 0, n) for n in range(5)]
    df = spark.createDataFrame(rows, "k string, ms long, n long")
    assert sorted(r.admitted for r in admit(df, [], "ms", ["n"], 2).collect()) == [0, 0, 1000, 1000, 2000]
    assert admit(df.where("false"), [], "ms", ["n"], 2).count() == 0
    with pytest.raises(ValueError):
        admit(df, [], "ms", ["n"], 0)


LOG = "seq long, i int, is_control boolean, status string, batch string"


def log_of(seed, n, controls=0.15):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        control = rng.random() < controls
        status = rng.choice([PAUSED, PAUSED, RUNNING, None]) if control else None
        out.append((seq, rng.choice([0, 0, 0, 1, 2, None]), control, status, f"x{seq}"))
    return out


def played(log, start=()):
    """Walk along the log with a queue per instance."""
    paused, queues, out = dict(start), defaultdict(list), []
    for seq, i, control, status, _ in sorted(log):
        if not control:
            if paused.get(i):
                queues[i].append(seq)
            else:
                out.append((seq, False, seq))
            continue
        paused[i] = status == PAUSED
        if not paused[i]:
            out += [(held, True, seq) for held in queues.pop(i, [])]
    return [(*row, at + 1) for at, row in enumerate(out)], sum(map(len, queues.values()))


def split(spark, log):
    df = spark.createDataFrame(log, LOG).withColumnRenamed("batch", "extra")
    return df.where("not is_control").select("seq", "i", "extra"), df.where("is_control").select("i", "seq", "status")


@pytest.mark.parametrize("seed, n", [(1, 300), (2, 40), (3, 3)])
def test_held_rows_come_out_where_their_instance_goes_on(spark, seed, n):
    log = log_of(seed, n)
    rows, changes = split(spark, log)
    known = hold_rows(rows, changes, ["i"], "seq")
    out = resequenced(known, "seq")
    assert out.columns == ["seq", "i", "extra", "held", "release", "position"]
    want, waiting = played(log)
    assert sorted((r.seq, r.held, r.release, r.position) for r in out.collect()) == sorted(want)
    assert known.where("release is null").count() == waiting


def test_instances_that_start_paused(spark):
    log = [(0, 0, False, None, ""), (1, 1, False, None, ""), (2, 0, True, RUNNING, ""), (3, 0, False, None, "")]
    rows, changes = split(spark, log)
    start = spark.createDataFrame([(0, PAUSED)], "i int, status string")
    out = resequenced(hold_rows(rows, changes, ["i"], "seq", start=start), "seq").collect()
    want, _ = played(log, {0: True}.items())
    assert sorted((r.seq, r.held, r.release, r.position) for r in out) == sorted(want)
    assert [r[0] for r in want] == [1, 0, 3]


def test_pauses_of_a_stream(spark):
    """Each micro-batch runs twice for one of them, as after a crash before its commit."""
    log = log_of(11, 240, controls=0.06)
    root = shared_dir(spark, "test-pauses")
    df = spark.createDataFrame(log, LOG).withColumnRenamed("batch", "extra")
    for part in range(6):
        df.where(f"seq div 40 = {part}").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{root}/in")
        drain(pausable_stream(stream, ["i"], "seq", "is_control", "status", root, f"{root}/checkpoint"))
        if part == 3:
            _forget_last_commit(spark, f"{root}/checkpoint", part)
            drain(pausable_stream(stream, ["i"], "seq", "is_control", "status", root, f"{root}/checkpoint"))
    out = all_batches(spark, f"{root}/out", "seq long, i int, extra string, held boolean, release long, position long")
    want, waiting = played(log)
    assert sorted((r.seq, r.held, r.release, r.position) for r in out.collect()) == sorted(want)
    assert waiting > 0 and any(release // 40 > seq // 40 + 1 for seq, _, release, _ in want)


def _forget_last_commit(spark, checkpoint, number):
    path = f"{checkpoint}/commits/{number}"
    os.remove(path)
    crc = f"{checkpoint}/commits/.{number}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_seeded_values(spark):
    ids = [0, 1, 2, -5, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.v for r in df.select("id", seeded(F.col("id"), 9, 1000).alias("v")).collect()}

    def plain(i):
        h = 42
        for part in (i, 9):
            h = xxhash.xxh64_intdigest(struct.pack("<q", part), seed=h)
        return (h - 2**64 if h >= 2**63 else h) % 1000

    assert got == {i: plain(i) for i in ids}


def test_stream_ids_are_drawn_once_per_stream():
    one, other = StreamSpec(2, "rebalance"), StreamSpec(2, "rebalance")
    assert one.id != other.id and one.queue(1) == f"{one.id}-1" == one.queue(1)
