from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceway.operators import anchored
from sluiceway.operators.joins import key_equality, window_join, window_join_anchored
from sluiceway.operators.window_maps import UNSET, block_map, replay
from sluiceway.plans import QUERIES

# seq, ms, kind, key, reserve: the golden rows for a width of one second
ROWS = [
    (1, 0, "person", 1, None),
    (2, 400, "auction", 1, 10),
    (3, 900, "auction", 2, 20),
    (4, 950, "person", 2, None),
    (5, 1000, "auction", 1, 30),
    (6, 1100, "person", 3, None),
    (7, 1500, "auction", 3, 40),
    (8, 1600, "auction", 1, 50),
    (9, 2099, "person", 1, None),
    (10, 2200, "person", 9, None),
]


def walk(ms, width, anchor=UNSET, window=0):
    """The definition, row by row."""
    numbers, closes = [], []
    for t in ms:
        if anchor == UNSET:
            anchor, window = t, window + 1
        numbers.append(window)
        closes.append(t - anchor >= width)
        if closes[-1]:
            anchor = UNSET
    return numbers, closes, anchor, window


times = st.lists(st.integers(0, 120), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(times, st.integers(1, 40), st.booleans(), st.integers(0, 40))
def test_block_maps_chain(ms, width, in_order, cut):
    ms = np.array(sorted(ms) if in_order else ms, dtype=np.int64)
    entries = np.array([UNSET, *range(-50, 130, 3)])
    whole = block_map(ms, width)
    cut = min(cut, len(ms))
    maps = [block_map(p, width) for p in (ms[:cut], ms[cut:]) if len(p)]
    chained = maps[0] if len(maps) == 1 else maps[0].then(maps[1])
    for m in (whole, chained):
        exits, opened = m(entries)
        for entry, after, more in zip(entries, exits, opened):
            numbers, closes, anchor, window = walk(ms.tolist(), width, int(entry), 7)
            assert (anchor, window) == (after, more + 7)
            got = replay(ms, width, int(entry), 7)
            assert got[0].tolist() == numbers and got[1].tolist() == closes


def golden(spark):
    return spark.createDataFrame(
        [(*r, 0) for r in ROWS], "seq long, ms long, kind string, key long, reserve long, ch int"
    )


def anchored_join(df):
    out = window_join_anchored(
        df, "person", "auction", "ch", "key", "ms", "seq", 1000, {"key": "id"}, {"reserve": "reserve"}
    )
    return sorted((r.id, r.reserve) for r in out.collect())


def test_golden_windows(spark):
    out = anchored.anchored_window(golden(spark), "ch", "ms", "seq", 1000).orderBy("seq").collect()
    assert [r.win for r in out] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    assert [r.seq for r in out if r.is_closer] == [5, 10]


def test_golden_joins(spark):
    df = golden(spark)
    assert anchored_join(df) == [(1, 10), (1, 50), (2, 20), (3, 40)]
    assert anchored_join(df.where("seq < 10")) == [(1, 10), (2, 20)]  # an open window is not joined
    people = df.where("kind = 'person'").select("key", "ms")
    sold = df.where("kind = 'auction'").select("key", "ms", "reserve")
    aligned = window_join(people, sold, ("key", "key"), ("ms", "ms"), 1000).collect()
    assert sorted((r.key, r.reserve) for r in aligned) == [(1, 10), (2, 20), (3, 40)]


@pytest.mark.parametrize("numbered", [True, False])
def test_one_of_equal_rows_closes(spark, numbered):
    """Rows that repeat, or share their id or have none, are rows of their own."""
    df = golden(spark).crossJoin(spark.range(3).select()).withColumn("seq", F.expr("seq" if numbered else "cast(null as long)"))
    rows = sorted([tuple(r) for r in df.collect()], key=lambda r: r[1])
    numbers, closes, _, _ = walk([r[1] for r in rows], 1000)
    want = sorted((r[1], w, x) for r, w, x in zip(rows, numbers, closes))
    out = anchored.anchored_window(df, "ch", "ms", "seq", 1000).collect()
    assert sorted((r.ms, r.win, r.is_closer) for r in out) == want
    inside = [(*r, w) for r, w, x in zip(rows, numbers, closes) if not x and w <= max(n for n, c in zip(numbers, closes) if c)]
    assert anchored_join(df) == sorted(
        (p[3], a[4]) for p in inside for a in inside
        if (p[2], a[2]) == ("person", "auction") and p[3] == a[3] and p[-1] == a[-1]
    )


def test_late_row_stays_in_the_window(spark):
    df = spark.createDataFrame(
        [(1, 0, 0), (2, -50, 0), (3, 1000, 0)], "seq long, ms long, ch int"
    )
    out = anchored.anchored_window_by_arrival(df, "ch", "ms", "seq", 1000).orderBy("seq").collect()
    assert [(r.win, r.is_closer) for r in out] == [(1, False), (1, False), (1, True)]


def brute(df, order, width):
    rows = sorted(map(tuple, df.select("ch", *order, "seq", "ms").collect()))
    want = []
    for c in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == c]
        numbers, closes, _, _ = walk([r[-1] for r in mine], width)
        want += [(r[-2], w, x) for r, w, x in zip(mine, numbers, closes)]
    return sorted(want)


@pytest.mark.parametrize("width", [1, 25, 400])
def test_many_small_blocks(spark, monkeypatch, width):
    """Blocks and runs far smaller than usual, many rows per millisecond, three channels."""
    monkeypatch.setattr(anchored, "TIME_BLOCK_MS", 50)
    monkeypatch.setattr(anchored, "ARRIVAL_BLOCK_ROWS", 40)
    monkeypatch.setattr(anchored, "FAN_IN", 3)
    df = spark.range(3000).select(
        F.col("id").alias("seq"),
        (F.when(F.col("id") % 3 == 0, 777).otherwise(F.col("id") * 7919 % 2000) - 300).alias("ms"),
        (F.col("id") % 5 % 3).cast("int").alias("ch"),
    )
    by_time = anchored.anchored_window(df, "ch", "ms", "seq", width)
    got = sorted((r.seq, r.win, r.is_closer) for r in by_time.collect())
    assert got == brute(df, ["ms"], width)
    by_arrival = anchored.anchored_window_by_arrival(df, "ch", "ms", "seq", width)
    got = sorted((r.seq, r.win, r.is_closer) for r in by_arrival.collect())
    assert got == brute(df, ["seq"], width)


@pytest.mark.parametrize("cut", [1, 4, 5, 6, 9])
def test_state_goes_on_after_a_cut(spark, cut):
    df = golden(spark)
    whole = anchored.anchored_window(df, "ch", "ms", "seq", 1000)
    want = sorted((r.seq, r.win, r.is_closer) for r in whole.collect())
    first, second = df.where(F.col("seq") <= cut), df.where(F.col("seq") > cut)
    edges = anchored.window_edges(first, "ch", "ms", "seq", 1000)
    carry = anchored.state_after(edges)
    parts = anchored.place_rows(first, edges, "ch", "ms", "seq", 1000).unionByName(
        anchored.anchored_window(second, "ch", "ms", "seq", 1000, carry)
    )
    assert sorted((r.seq, r.win, r.is_closer) for r in parts.collect()) == want


def test_key_positions(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y long")
    right = spark.createDataFrame([(2, "z"), (3, "q")], "u long, v string")
    assert [tuple(r) for r in key_equality(left, right, 1, 0).collect()] == [("b", 2, 2, "z")]


@pytest.mark.parametrize("width,late", [(1000, 0), (1000, 300), (3_600_000, 0)])
def test_maps_stay_bounded(width, late):
    """Rows one millisecond apart: chained maps have no more steps than the width and lateness."""
    rng = np.random.default_rng(1)
    ms = np.arange(40_000) * (1 if width == 1000 else 500) - rng.integers(0, late + 1, 40_000)
    blocks = np.array_split(ms, 20)
    peaks = np.maximum.accumulate([b.max() for b in blocks])
    maps = [block_map(b, width, UNSET + 1 if i == 0 else int(peaks[i - 1]) + 1) for i, b in enumerate(blocks)]
    bound = width + 2 * late + 2
    assert all(len(m.upto) <= bound for m in maps)
    total = maps[0]
    state, opened = np.array([UNSET]), 0
    for m in maps[1:]:
        total = total.then(m)
        assert len(total.upto) <= bound
    tail = maps[5]
    for m in maps[6:]:
        tail = tail.then(m)
        assert len(tail.upto) <= bound
    for m in maps:
        state, more = m(state)
        opened += int(more[0])
    exits, more = total(np.array([UNSET]))
    assert int(exits[0]) == int(state[0]) and int(more[0]) == opened


@pytest.mark.parametrize("name", ["stream_window_join_anchored", "handover_window_join", "stream_anchored_window"])
def test_parts_follow_time_where_ids_do_not(spark, small, tmp_path, name):
    """Every event twice at the same time, the second time with ids after all others."""
    ev = spark.read.parquet(f"{small}/events.parquet")
    again = ev.withColumns({"event_id": F.col("event_id") + 1000, "user_id": F.col("user_id") + 100})
    ev.unionByName(again).write.parquet(f"{tmp_path}/events.parquet")
    base = "anchored_window" if name == "stream_anchored_window" else "window_join_anchored"
    got, want = (sorted(map(tuple, QUERIES[n](spark, str(tmp_path)).collect())) for n in (name, base))
    assert got == want and got
