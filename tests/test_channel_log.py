"""Ordered channels: positions, exactly-once appends, bounded micro-batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sluiceway.session import shared_dir
from sluiceway.streaming import channel_log
from sluiceway.streaming.channel_log import LogReader, append_blocks, channel_log_read, take_blocks
from sluiceway.streaming.tables import all_batches, put_batch, put_batches

SCHEMA = "seq long, ch int"


def frame(spark, low, high):
    return spark.createDataFrame([(i, 0 if i % 5 else 1) for i in range(low, high)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def log(spark):
    path = shared_dir(spark, "test-channel-log")
    append_blocks(frame(spark, 0, 40), path, 0, ["seq"], block_rows=10)
    append_blocks(frame(spark, 40, 47), path, 1, ["seq"], block_rows=10)
    append_blocks(frame(spark, 47, 90), path, 2, ["seq"], block_rows=10)
    append_blocks(frame(spark, 47, 90), path, 2, ["seq"], block_rows=10)  # again, as after a failure
    return path


def test_positions(spark, log):
    rows = channel_log_read(spark, log, SCHEMA).collect()
    want = {}
    for i in range(90):
        ch = 0 if i % 5 else 1
        want[i] = (ch, sum(1 for k in range(i) if (0 if k % 5 else 1) == ch))
    assert len(rows) == 90 and {r.seq: (r.ch, r.position) for r in rows} == want
    blocks = sorted(all_batches(spark, f"{log}/manifest", "ch int, block long, first long, last long, nth long, until long").collect(),
                    key=lambda b: b.nth)
    assert [b.nth for b in blocks] == list(range(1, len(blocks) + 1)) and blocks[-1].until == 90
    assert all(b.last - b.first < 10 for b in blocks)


def test_micro_batches_are_bounded_and_whole(spark, log):
    root, seen = shared_dir(spark, "test-log-reader"), []

    def handle(rows, number):
        got = rows.collect()
        seen.append((number, got))

    assert LogReader(spark, log, SCHEMA, f"{root}/p", budget=15).drain(handle) >= 6
    assert all(len(rows) <= 15 for _, rows in seen)
    for ch in (0, 1):
        places = [p for _, rows in seen for p in sorted(r.position for r in rows if r.ch == ch)]
        assert places == list(range(len(places)))
    assert sum(len(rows) for _, rows in seen) == 90


def test_a_failed_micro_batch_comes_again(spark, log):
    root = shared_dir(spark, "test-log-retry")
    reader = lambda: LogReader(spark, log, SCHEMA, f"{root}/p", budget=25)

    def handle(rows, number):
        put_batch(rows, f"{root}/out", number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    failed: list[int] = []
    with pytest.raises(RuntimeError):
        reader().drain(handle)
    reader().drain(handle)
    out = all_batches(spark, f"{root}/out", "seq long, ch int, position long")
    assert failed and out.count() == 90 and out.select("seq").distinct().count() == 90
    assert reader().drain(handle) == 0


def test_a_micro_batch_opens_its_own_blocks_only(spark, log):
    blocks, _ = take_blocks(spark, log, 4, 20)
    want = {(b.batch, b.ch, b.block) for b in blocks.collect()}
    files = channel_log_read(spark, log, SCHEMA, blocks).inputFiles()
    assert want and len(files) == len(want)
    assert {tuple(int(part.split("=")[1]) for part in f.split("/")[-4:-1]) for f in files} == want


def test_nothing_there(spark):
    assert take_blocks(spark, shared_dir(spark, "test-no-log"), 0, 10) == (None, 0)


@pytest.mark.parametrize("bound", [1_000, 5])
def test_rounds_have_the_micro_batches_of_single_steps(spark, log, monkeypatch, bound):
    monkeypatch.setattr(channel_log, "MICRO_BATCH_BLOCKS", bound)
    root, alone, rounds = shared_dir(spark, "test-log-rounds"), {}, []

    def one(rows, number):
        alone[number] = {(r.seq, r.ch, r.position, r.block) for r in rows.collect()}

    def several(rows, numbers):
        rounds.append((numbers, rows.collect()))

    steps = LogReader(spark, log, SCHEMA, f"{root}/p", budget=15).drain(one)
    assert LogReader(spark, log, SCHEMA, f"{root}/q", budget=15).drain(several, together=True) == steps >= 6
    assert [n for numbers, _ in rounds for n in numbers] == list(range(steps))
    assert len(rounds) == 1 or bound < 1_000
    for numbers, rows in rounds:
        for n in numbers:
            got = [(r.seq, r.ch, r.position, r.block) for r in rows if r.number == n]
            assert set(got) == alone[n] and len(got) == len(alone[n]) <= 15
        assert {r.number for r in rows} == set(numbers)


def test_a_failed_round_comes_again(spark):
    root = shared_dir(spark, "test-log-round-retry")
    path, seen = f"{root}/log", []
    append_blocks(frame(spark, 0, 40), path, 0, ["seq"], block_rows=10)
    reader = lambda: LogReader(spark, path, SCHEMA, f"{root}/p", budget=15)

    def several(rows, numbers):
        put_batches(rows, f"{root}/out", "number")
        seen.append(numbers)
        if len(seen) == 1:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        reader().drain(several, together=True)
    append_blocks(frame(spark, 40, 90), path, 1, ["seq"], block_rows=10)  # must not change what the round has
    # what is left of a round can be taken one by one, and a round can follow
    assert reader().step(lambda rows, number: put_batch(rows, f"{root}/out", number))
    reader().drain(several, together=True)
    assert len(seen[0]) > 1 and list(seen[1]) == list(seen[0])[1:] and seen[2][0] == seen[0][-1] + 1
    out = all_batches(spark, f"{root}/out", "seq long, batch int")
    assert out.count() == 90 and out.select("seq").distinct().count() == 90
    assert out.groupBy("batch").count().agg({"count": "max"}).first()[0] <= 15
    assert reader().drain(several, together=True) == 0


def test_the_query_takes_a_small_number_of_jobs(spark, small, tmp_path):
    """Ten times the micro-batches must not take ten times the jobs."""
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    for times in (4, 40):
        folder = tmp_path / str(times)
        events = spark.read.parquet(f"{small}/events.parquet")
        copies = spark.range(times).withColumnRenamed("id", "copy").crossJoin(events)
        copies = copies.withColumn("event_id", F.col("event_id") + F.col("copy") * 1_000_000).drop("copy")
        copies.coalesce(2).write.parquet(f"{folder}/events.parquet")
        before = spark.sparkContext.parallelize([1], 1).count() and max(tracker.getJobIdsForGroup(None) or [0])
        df = queries()["channel_log"](spark, str(folder))
        got = df.agg(F.count("*"), F.countDistinct("event_id"), F.countDistinct("ch", "position")).first()
        assert tuple(got) == (1_000 * times,) * 3
        jobs.append(max(tracker.getJobIdsForGroup(None)) - before)
    assert jobs[1] < 2 * jobs[0], jobs
