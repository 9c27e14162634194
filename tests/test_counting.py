from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluiceway.operators.control import previous_in_channel
from sluiceway.operators.counting import event_counters, running_count, shared_count, word_count
from sluiceway.operators.lookup import lookup
from sluiceway.operators.ordinal import running_ordinal
from sluiceway.plans.wordcount import wordcount
from sluiceway.sources.lines import LINES, lines_source


def test_running_count_golden(spark):
    words = "to be or to".split()
    df = spark.createDataFrame(list(enumerate(words)), "seq long, word string")
    got = running_count(df, ["seq"]).orderBy("seq").collect()
    assert [(r.word, r.cnt) for r in got] == [("to", 1), ("be", 1), ("or", 1), ("to", 2)]


@pytest.mark.parametrize("hot_rows", [10_000_000, 64, 7])
def test_hot_words_are_counted_in_blocks(spark, hot_rows):
    """One word holds a third of the rows and one place in the order is crowded."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("word"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") * 7 % 1000).alias("a"),
        F.col("id").alias("b"),
    )
    rows = sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[2]))
    seen, want = Counter(), []
    for word, a, b in rows:
        seen[word] += 1
        want.append((word, a, b, seen[word]))
    got = running_count(df, ["a", "b"], hot_rows=hot_rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("hot_rows", [10_000_000, 20])
def test_running_count_goes_on(spark, hot_rows):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("word"), F.col("id").alias("seq"))
    first, second = df.where("seq < 90"), df.where("seq >= 90")
    start = word_count(first)
    got = running_count(first, ["seq"], hot_rows=hot_rows).unionByName(
        running_count(second, ["seq"], start=start, hot_rows=hot_rows)
    )
    whole = running_count(df, ["seq"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("hot_rows", [10_000_000, 5])
def test_null_keys_are_counted(spark, hot_rows):
    df = spark.range(40).select(F.when(F.col("id") % 4 > 0, F.lit(None)).otherwise("w").alias("word"), "id")
    start = spark.createDataFrame([(None, 100)], "word string, cnt long")
    got = {r.id: r.cnt for r in running_count(df, ["id"], start=start, hot_rows=hot_rows).collect()}
    nulls = [i for i in range(40) if i % 4]
    assert [got[i] for i in nulls] == list(range(101, 131)) and len(got) == 40
    before = previous_in_channel(df, "word", "id", "id", "previous", block_rows=8).collect()
    assert {r.id: r.previous for r in before if r.word is None} == dict(zip(nulls, [None, *nulls]))


def test_rows_are_shuffled_once_however_many_keys(spark):
    """The table that rows look their earlier ranges up in has one row per range, not one per key."""
    df = spark.range(30_000).select(F.col("id").cast("string").alias("word"), "id")
    start = df.where("id % 2 = 0").select("word", F.lit(5).alias("cnt"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "65536")
    try:
        for got in (running_count(df, ["id"]), running_count(df, ["id"], start=start)):
            assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
        assert {(r.id % 2, r.cnt) for r in got.collect()} == {(0, 6), (1, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("hot_rows", [10_000_000, 9])
def test_ordinal_by_keys_of_all_kinds(spark, hot_rows):
    """Null, NaN and both zeros are keys as they are for Spark, lists too, and over ranges and batches."""
    pick = "element_at(array(null, double('nan'), 0.0d, -0.0d, 1.5d), cast(id % 5 + 1 as int))"
    df = spark.range(200).selectExpr(f"{pick} as x", "array(id % 2, null) as y", "id")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy("id")))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = running_ordinal(df, ["x", "y"], ["id"], "n", hot_rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert {r.id: r.n for r in got} == {r.id: r.n for r in want.collect()} and len(got) == 200


def test_event_counters_in_blocks(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("s"), (F.col("id") * 700).alias("ms"))
    got = {(r.s, r.second): r.event_counter for r in event_counters(df, "s", "ms", block_ms=4000).collect()}
    for (s, second), total in got.items():
        assert total == sum(1 for i in range(500) if i % 2 == s and i * 700 < second + 1000)


def test_ordinal_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 17 % 1000).alias("k"))
    for hot_rows in (10_000_000, 30):
        got = running_ordinal(df, [], ["k"], hot_rows=hot_rows).collect()
        assert {r.k: r.ordinal for r in got} == {k: k + 1 for k in range(1000)}


def test_lookup_with_hot_keys(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 60, 1).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 80).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = rows.groupBy("k").count().where("count > 10")
    got = sorted(map(tuple, lookup(rows, table, ["k"], hot).select("id", "k", "v").collect()))
    want = sorted(map(tuple, rows.join(table, "k").select("id", "k", "v").collect()))
    assert got == want and len(got) == 80


def test_shared_count(spark):
    a = spark.createDataFrame([("x",), ("y",)], "word string")
    b = spark.createDataFrame([("x",)], "word string")
    assert {r.word: r.cnt for r in shared_count([a, b]).collect()} == {"x": 2, "y": 1}


def test_lines_job(spark):
    source = lines_source(spark, 70)
    assert [r.line for r in source.orderBy("idx").collect()] == LINES * 2
    counts = wordcount(source)
    top = {r.word: r.m for r in counts.groupBy("word").agg(F.max("cnt").alias("m")).collect()}
    assert top == {r.word: r.n for r in counts.groupBy("word").agg(F.count("*").alias("n")).collect()}
    assert lines_source(spark, 70, start=60).count() == 10
