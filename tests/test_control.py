from __future__ import annotations

import random

import pytest

from sluiceway.operators.control import changelog_view, mode_switch_marker, topology_view
from sluiceway.operators.routing import channel_members, channel_others, route_by_table
from sluiceway.operators.rows import tap_rows
from sluiceway.streaming.handover import handover_changes
from pyspark.sql import functions as F


def fold(changes):
    view = {}
    for key, _, op, value in sorted(changes, key=lambda c: c[1]):
        if op == "put" or (op == "putIfAbsent" and key not in view):
            view[key] = value
        elif op == "remove":
            view.pop(key, None)
    return view


def view_of(spark, changes, hot_rows=10_000_000):
    log = spark.createDataFrame(changes, "key string, seq long, op string, value string")
    return {r.key: r.value for r in changelog_view(log, ["key"], hot_rows=hot_rows).collect()}


def test_changelog_golden(spark):
    steps = [("put", "1"), ("putIfAbsent", "2"), ("put", "3"), ("remove", None),
             ("putIfAbsent", "4"), ("putIfAbsent", "5"), ("put", "6")]
    after = {3: {"k": "3"}, 4: {}, 6: {"k": "4"}, 7: {"k": "6"}}
    for n, want in after.items():
        changes = [("k", i, op, v) for i, (op, v) in enumerate(steps[:n])]
        assert view_of(spark, changes) == want


@pytest.mark.parametrize("hot_rows", [10_000_000, 5])
def test_changelog_equals_fold(spark, hot_rows):
    rng = random.Random(7)
    changes = [
        (rng.choice("hhhhabcdefg"), i, rng.choice(["put", "putIfAbsent", "putIfAbsent", "remove"]), str(i))
        for i in range(400)
    ]
    for n in (1, 17, 200, 400):
        assert view_of(spark, changes[:n], hot_rows) == fold(changes[:n])


def test_topology_after_a_handover(spark):
    changes = handover_changes("j1", "j2", "Counter", {"tok": 2}, "out")
    assert [c[2] for c in changes[:4]] == ["putIfAbsent"] * 4
    log = [(i, *c) for i, c in enumerate(changes)]
    log += [(100, "j2-task-Counter", "parallelism", "put", "2")]
    df = spark.createDataFrame(log, "seq long, tbl string, key string, op string, value string")
    got = {(r.operator, r.instance): r for r in topology_view(df).collect()}
    new = got["j2-task-Counter", 1]
    assert (new.status, new.input_streams, new.output_stream, new.parallelism) == ("Running", "tok", "out", 2)
    assert got["j1-task-Counter", 0].status == "Paused"


def test_marker_across_blocks(spark):
    kinds = [0, 0, 1, 1, 0, 1, 1, 1, 0, 0]
    df = spark.createDataFrame(
        [(i * 700_000, 0, k) for i, k in enumerate(kinds)], "seq long, ch int, channel_type int"
    )
    marked = mode_switch_marker(df, "ch", "seq").orderBy("seq").collect()
    assert [r.seq // 700_000 for r in marked] == [2, 4, 5, 8]


def test_router_keeps_every_row(spark):
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("ch"))
    table = spark.createDataFrame([("s", 1), ("s", 3), ("s", 3)], "stream string, channel int")
    inside, outside = channel_members(rows, table, 4), channel_others(rows, table, 4)
    assert inside.count() + outside.count() == 100 and inside.where("ch % 2 = 0").count() == 0
    routed = route_by_table(rows, table, 4)
    assert routed.count() == 100
    assert routed.where("channel_type = 1").count() == inside.count()


def test_tap(spark):
    rows = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("ch"))
    switches = spark.createDataFrame(
        [("Sink", 1, "with-log"), ("Sink", 0, "off"), ("Other", 0, "with-log")],
        "operator string, instance int, output string",
    )
    assert {r.ch for r in tap_rows(rows, "Sink", F.col("ch"), 2, switches).collect()} == {1}
