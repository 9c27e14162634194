"""User functions with state next to plain dictionaries and lists."""

from __future__ import annotations

import random
from collections import defaultdict

import pandas as pd

from sluiceway.session import shared_dir
from sluiceway.streaming.runs import drain, writer
from sluiceway.streaming.user_state import StateFunction, across_blocks, kept_state, with_state


def notes():
    """A function whose class goes to the workers by value, as they can't import a test."""

    class Notes(StateFunction):
        """Uses every call: last word, the words that wait for a stop, and how often each word came."""

        values = {"last": "string"}
        lists = {"waiting": "string"}
        maps = {"times": ("string", "long")}
        output = "seq long, word string, before string, waited string, cnt long"

        def process(self, key, rows, state):
            out = []
            for seq, word in zip(rows["seq"].tolist(), rows["word"].tolist()):
                cnt = state.get_entry("times", word, 0) + 1
                state.put_entry("times", word, cnt)
                if word == "forget":
                    state.remove_entry("times", "a")
                waited = None
                if word == "stop":
                    waited = " ".join(state.items("waiting"))
                    state.put_items("waiting", [])
                else:
                    state.append("waiting", word)
                out.append((seq, word, state.get("last"), waited, cnt))
                state.put("last", word)
            return pd.DataFrame(out, columns=["seq", "word", "before", "waited", "cnt"])

    return Notes()


def plain(log, block_rows):
    out, kept = [], defaultdict(lambda: {"last": None, "waiting": [], "times": defaultdict(int)})
    for seq, key, word in log:
        mine = kept[key, seq // block_rows]
        mine["times"][word] += 1
        cnt = mine["times"][word]
        if word == "forget":
            mine["times"].pop("a", None)
        waited = None
        if word == "stop":
            waited, mine["waiting"] = " ".join(mine["waiting"]), []
        else:
            mine["waiting"].append(word)
        out.append((seq, key, seq // block_rows, word, mine["last"], waited, cnt))
        mine["last"] = word
    return out, kept


def test_all_kinds_of_state(spark):
    rng = random.Random(3)
    log = [(n, rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice(["a", "b", "stop", "forget"])) for n in range(240)]
    root = shared_dir(spark, "test-user-state")
    df = spark.createDataFrame(log, "seq long, key string, word string")
    for part in range(3):  # borders of micro-batches (80) lie inside blocks (50)
        df.where(f"seq div 80 = {part}").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{root}/in")
        out = with_state(stream, "key", "seq", notes(), block_rows=50)
        drain(writer(out, f"{root}/checkpoint").format("parquet").option("path", f"{root}/out"))
    want, kept = plain(log, 50)
    got = spark.read.parquet(f"{root}/out").select("seq", "key", "block", "word", "before", "waited", "cnt").collect()
    assert sorted(map(tuple, got)) == want

    times = {(k, b, w, n) for (k, b), mine in kept.items() for w, n in mine["times"].items()}
    entries = kept_state(spark, f"{root}/checkpoint", "times").select("key", "block", "map_key", "value")
    assert set(map(tuple, entries.collect())) == times
    items = kept_state(spark, f"{root}/checkpoint", "waiting").collect()
    assert sorted((str(r.key), r.block, r.value) for r in items) == sorted(
        (str(k), b, w) for (k, b), mine in kept.items() for w in mine["waiting"]
    )
    last = kept_state(spark, f"{root}/checkpoint", "last").select("key", "block", "value").collect()
    assert set(map(tuple, last)) == {(k, b, mine["last"]) for (k, b), mine in kept.items()}


def test_blocks_add_up(spark):
    rng = random.Random(4)
    log = [(n, rng.choice(["x", "x", None])) for n in range(60)]
    rows, sums, so_far, want = [], defaultdict(int), defaultdict(int), {}
    for n, key in log:
        sums[key, n // 7] += 1
        rows.append((n, key, n // 7, sums[key, n // 7]))
        so_far[key] += 1
        want[n] = so_far[key]
    got = across_blocks(
        spark.createDataFrame(rows, "n long, key string, block long, cnt long"),
        spark.createDataFrame([(k, b, c) for (k, b), c in sums.items()], "key string, block long, cnt long"),
        ["key"], "cnt",
    )
    assert got.columns == ["n", "key", "block", "cnt"]
    assert {r.n: r.cnt for r in got.collect()} == want


def test_counts_ask_for_their_map_once():
    """One call for the whole map and one for each entry that changes, no look-up per key."""
    from sluiceway.plans.stream_queries import CountPerUser

    class Kept:
        def __init__(self):
            self.map, self.calls = {7: 3}, 0

        def entries(self, name):
            self.calls += 1
            return dict(self.map)

        def put_entry(self, name, key, value):
            self.calls += 1
            self.map[key] = value

    kept, rows = Kept(), pd.DataFrame({"event_id": [1, 2, 3, 4], "user_id": [7, 8, 7, 9]})
    out = CountPerUser().process("x", rows, kept)
    assert out["cnt"].tolist() == [4, 1, 5, 1] and kept.map == {7: 5, 8: 1, 9: 1} and kept.calls == 4
