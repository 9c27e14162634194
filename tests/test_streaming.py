from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluiceway.functions.names import count_line, task_line
from sluiceway.operators.counting import running_count
from sluiceway.session import shared_dir
from sluiceway.sources.channel import channel_read
from sluiceway.streaming import channels, counting, handover, sinks, state
from sluiceway.streaming.runs import Switchable, drain, writer
from sluiceway.streaming.tables import ChangedRows, all_batches, last_batch, put_batch

SCHEMA = "seq long, word string, ch int"


def word_rows(spark, n=120):
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("word"),
        (F.col("id") % 2).cast("int").alias("ch"),
    )


def park(rows, path, cuts):
    """One epoch per stretch between the cuts."""
    bounds = [0, *cuts, 10**9]
    for epoch, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = rows.where((F.col("seq") >= a) & (F.col("seq") < b))
        channels.append_to_channels(part, path, epoch=epoch)


@pytest.mark.parametrize("cut", [1, 40, 119])
def test_handover_equals_one_uninterrupted_run(spark, cut):
    root = shared_dir(spark, "test-handover")
    rows = word_rows(spark)
    park(rows, f"{root}/in", [cut])

    def operator(name):
        def build(df, checkpoint, start):
            return counting.running_count_stream(
                df.select("seq", "word"), ["seq"], f"{root}/{name}", checkpoint, start, hot_rows=10
            )

        return handover.Operator(f"{root}/{name}-cp", build, lambda _: counting.counters(spark, f"{root}/{name}"))

    handover.handover(spark, f"{root}/in", SCHEMA, operator("a"), operator("b"), cut=1)
    got = [
        tuple(r)
        for name in "ab"
        for r in all_batches(spark, f"{root}/{name}/out", "seq long, word string, cnt long")
        .select("seq", "word", "cnt")
        .collect()
    ]
    want = running_count(rows.select("seq", "word"), ["seq"]).select("seq", "word", "cnt")
    assert sorted(got) == sorted(map(tuple, want.collect()))


def test_handover_does_not_depend_on_the_files(spark):
    """Eight files per epoch, written in shuffled order of their rows, give every row its count."""
    root = shared_dir(spark, "test-files")
    rows = word_rows(spark)
    for epoch, (low, high) in enumerate([(0, 60), (60, 120)]):
        for k in (5, 2, 7, 0, 3, 6, 1, 4):
            part = rows.where((F.col("seq") >= low) & (F.col("seq") < high) & (F.col("seq") % 8 == k))
            channels.append_to_channels(part.coalesce(1), f"{root}/in", epoch=epoch)

    def operator(name):
        def build(df, checkpoint, start):
            out = state.counting_state(df.select("seq", "word"), "word", "seq", start=start)
            return writer(out, checkpoint).format("parquet").option("path", f"{root}/{name}-out")

        return handover.Operator(f"{root}/{name}-cp", build, lambda c: state.read_state(spark, c))

    handover.handover(spark, f"{root}/in", SCHEMA, operator("a"), operator("b"), cut=1)
    got = [
        tuple(r)
        for name in "ab"
        for r in spark.read.schema("seq long, word string, cnt long").parquet(f"{root}/{name}-out").collect()
    ]
    want = running_count(rows.select("seq", "word"), ["seq"]).select("seq", "word", "cnt")
    assert sorted(got) == sorted(map(tuple, want.collect()))


def test_one_instance_moves_and_the_other_stays(spark):
    """Only channel 1 is handed over; channel 0 stays with the old query."""
    root = shared_dir(spark, "test-instance")
    rows = word_rows(spark)
    park(rows, f"{root}/in", [50])

    def build(name):
        def writer_of(df, checkpoint, start):
            keyed = df.select("seq", F.concat_ws("/", "ch", "word").alias("k"))
            out = state.counting_state(keyed, "k", "seq", start=start)
            return writer(out, checkpoint).format("parquet").option("path", f"{root}/{name}-out")

        return handover.Operator(f"{root}/{name}-cp", writer_of, lambda c: state.read_state(spark, c))

    handover.handover(spark, f"{root}/in", SCHEMA, build("a"), build("b"), 1, channels=[1])
    schema = f"{SCHEMA}, channel int, epoch int"
    from sluiceway.sources.channel import channel_stream

    stay = channel_stream(spark, {"in": f"{root}/in"}, schema, [0])
    drain(build("c").build(stay, f"{root}/c-cp", None))
    got = sorted(
        tuple(r)
        for n in "abc"
        for r in spark.read.schema("seq long, k string, cnt long").parquet(f"{root}/{n}-out").collect()
    )
    keyed = rows.select("seq", F.concat_ws("/", "ch", "word").alias("word"))
    assert got == sorted((r.seq, r.word, r.cnt) for r in running_count(keyed, ["seq"]).collect())


@pytest.mark.parametrize("finish", [True, False])
def test_pause_loses_nothing(spark, finish):
    root = shared_dir(spark, "test-pause")
    rows = word_rows(spark).select("seq", "word")
    rows.where("seq < 30").write.parquet(f"{root}/in")

    def build():
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        return counting.running_count_stream(stream, ["seq"], root, f"{root}/cp")

    job = Switchable(build, paused=True)
    assert job.status == "Paused" and job.query is None
    job.resume()
    job.pause(finish=finish)
    rows.where("seq >= 30").write.mode("append").parquet(f"{root}/in")
    job.resume()
    job.pause()
    got = all_batches(spark, f"{root}/out", "seq long, word string, cnt long").select("seq", "word", "cnt")
    want = running_count(rows, ["seq"]).select("seq", "word", "cnt")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not finish or last_batch(spark, f"{root}/out") == 1


def test_channels_are_pruned_and_ordered_by_epoch(spark):
    root = shared_dir(spark, "test-channel")
    park(word_rows(spark), f"{root}/in", [60])
    one = channel_read(spark, {"in": f"{root}/in"}, [1], (1, None))
    assert {(r.channel, r.epoch) for r in one.select("channel", "epoch").distinct().collect()} == {(1, 1)}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan
    both = channel_read(spark, {"a": f"{root}/in", "b": f"{root}/in"})
    assert both.count() == 240


def test_retried_batch_overwrites_itself(spark):
    root = shared_dir(spark, "test-retry")
    for _ in range(2):
        put_batch(spark.range(5), f"{root}/t", 0)
    assert all_batches(spark, f"{root}/t", "id long, batch int").count() == 5


def test_sinks(spark):
    root = shared_dir(spark, "test-sinks")
    rows = word_rows(spark, 10)
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    drain(sinks.discard_sink(stream, f"{root}/cp-discard"))
    line = count_line(F.col("word"), F.col("seq"))
    printed = drain(sinks.console_sink(stream, line, F.lit("Sink (1/1)"), f"{root}/cp-console"))
    assert "Console" in printed.lastProgress["sink"]["description"]
    assert sum(p["numInputRows"] for p in printed.recentProgress) == 10
    one = rows.where("seq = 3").select(task_line(F.lit("Sink (1/1)"), line).alias("line"))
    assert one.first().line == "[Sink (1/1)] Message: hot: 3"

    got, tapped = [], []
    switches = spark.createDataFrame([("Sink", 1, "with-log")], "operator string, instance int, output string")
    query = sinks.tapped_sink(
        stream,
        "Sink",
        F.col("ch"),
        2,
        lambda: switches,
        lambda df, _: got.extend(df.collect()),
        lambda df, _: tapped.extend(df.collect()),
        f"{root}/cp-tap",
    )
    drain(query)
    assert len(got) == 10 and {r.ch for r in tapped} == {1} and len(tapped) == 5


def test_index_source_goes_on_from_its_offset(spark):
    from sluiceway.sources.generator import index_stream

    root = shared_dir(spark, "test-index")
    for stop in (50, 120):
        out = writer(index_stream(spark, 30, stop=stop), f"{root}/cp").format("parquet")
        Switchable(lambda: out.option("path", f"{root}/out")).pause()
    got = spark.read.schema("idx long").parquet(f"{root}/out").collect()
    assert sorted(r.idx for r in got) == list(range(120))


def test_changed_rows_are_compacted(spark):
    path = f"{shared_dir(spark, 'test-changed')}/t"
    kept = ChangedRows(path, ["k"], "k string, v long", compact=3)
    want = {}
    for n in range(12):
        changed = {f"k{n % 5}": n, None: -n}
        want.update(changed)
        for _ in range(2):  # a batch that is run again
            before = kept.at(spark, n - 1)
            assert before is None or len(before.collect()) == min(n, 5) + 1
            kept.put(spark.createDataFrame(list(changed.items()), kept.schema), n)
        assert {r.k: r.v for r in kept.at(spark, n).collect()} == want
        folders = kept._folders(spark)
        assert len(folders["batch"]) + len(folders["full"]) <= 6
    assert kept.last(spark) == 11
