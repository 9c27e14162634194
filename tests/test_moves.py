"""Operator instances that move by control rows, with a crash after every step."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluiceway.session import shared_dir
from sluiceway.streaming import channels, counting, moves
from sluiceway.streaming.tables import all_batches

ROWS = "id long, k string, ch int"
LOG = "seq long, tbl string, key string, op string, value string"


class Crash(Exception):
    pass


def mover_of(spark, root):
    def build(rows, path, checkpoint, start):
        words = rows.select("id", F.concat_ws("-", "channel", "k").alias("word"))
        return counting.running_count_stream(words, ["id"], path, checkpoint, start)

    def left(path, start):
        counts = counting.counters(spark, path, start)
        return counts and counts.withColumn("channel", F.split_part("word", F.lit("-"), F.lit(1)).cast("int"))

    return moves.Mover(spark, f"{root}/channel", ROWS, moves.Movable(build, left), f"{root}/jobs")


def test_steps_only_grow():
    versions = [{0: "a", 1: "a", 3: "c"}, {0: "a", 1: "b", 3: "c"}, {1: "b", 3: "c"}, {0: "b", 1: "b", 3: "c"}]
    before = []
    for n in range(1, 5):
        steps, running = moves.steps_of(versions[:n])
        assert [str(s) for s in steps][: len(before)] == before
        before = [str(s) for s in steps]
        assert sorted(c for s in running for c in s.unread) == sorted(versions[n - 1])
        assert [s.version for s in running if s.job == "c"] == [0]
    assert before == [
        "drain a-0 [0, 1]", "hand a-1 [0]", "hand b-1 [1]", "drain a-1 [0]", "drain b-1 [1]", "hand b-3 [0, 1]",
    ]
    assert running[-1].unread == {0: 2, 1: 3}


def test_every_step_crashes_once(spark):
    """Channel 1 moves, channel 2 pauses and comes back elsewhere, channel 3 stays; later epochs lie there from the start."""
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), rng.choice([0, 1, 1, 2, 3])) for i in range(90)]
    root = shared_dir(spark, "test-moves")
    for epoch in range(3):
        part = spark.createDataFrame(rows[epoch * 30 : epoch * 30 + 30], ROWS)
        channels.append_to_channels(part, f"{root}/channel", epoch=epoch)
    versions = [
        {0: "a", 1: "a", 2: "b", 3: "c"},
        {0: "a", 1: "b", 3: "c"},
        {0: "a", 1: "b", 2: "a", 3: "c"},
    ]
    acted, crashed = Counter(), set()
    seen = {}
    for n in (1, 2, 3):
        while True:
            mover = mover_of(spark, root)

            def act(step):
                mover.act(step)
                acted[str(step)] += 1
                if str(step) not in crashed:
                    crashed.add(str(step))
                    raise Crash

            try:
                running = mover.follow(versions[:n], act)
                break
            except Crash:
                continue
        seen |= {s.name: s for s in running}
    assert acted and set(acted.values()) == {2}
    assert {s.job for s in seen.values()} == {"a", "b", "c"} and "c-1" not in seen
    got = Counter()
    for stretch in seen.values():
        out = all_batches(spark, f"{mover.folder(stretch)}/out", "word string, id long, cnt long")
        got.update((r.id, r.word, r.cnt, stretch.job) for r in out.collect())
    so_far, expected = Counter(), Counter()
    for i, k, ch in rows:
        so_far[ch, k] += 1
        # Rows of the epoch in which channel 2 is paused wait for the job that it comes back to.
        job = versions[i // 30].get(ch, "a")
        expected[i, f"{ch}-{k}", so_far[ch, k], job] += 1
    assert got == expected


def test_owners_follow_the_log(spark):
    rows = [
        ("j1-task-Op", "instance-status-0", "put", "Running"),
        ("j1-task-Op", "instance-status-1", "put", "Running"),
        ("j1-task-Other", "instance-status-0", "put", "Running"),
        ("j1-task-Op", "instance-status-1", "put", "Paused"),
        ("j2-task-Op", "instance-status-1", "put", "Running"),
        ("j1-task-Op", "instance-status-1", "put", "Running"),
    ]
    log = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], LOG)
    assert moves.owners(log, "Op", 2) == {0: "j1", 1: "j1"}
    assert moves.owners(log, "Op", 3) == {0: "j1"}
    assert moves.owners(log, "Op", 4) == {0: "j1", 1: "j2"}
    with pytest.raises(ValueError):
        moves.owners(log, "Op", 5)


def test_changed_history_is_refused(spark):
    root = shared_dir(spark, "test-steps")
    first = moves.Step(moves.DRAIN, moves.Stretch("a", 0, {0: 0}))
    moves.execute(spark, root, [first], lambda _: None)
    with pytest.raises(ValueError):
        moves.execute(spark, root, [moves.Step(moves.DRAIN, moves.Stretch("b", 0, {0: 0}))], lambda _: None)
