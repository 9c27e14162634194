from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluiceway.functions.hashing import key_hash
from sluiceway.model import StreamSpec
from sluiceway.operators import channels, rows


def java_string_hash(text: str) -> int:
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def java_long_hash(value: int) -> int:
    bits = value & (2**64 - 1)
    h = (bits ^ (bits >> 32)) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_string_hash_golden(spark):
    golden = {"to": (3707, 1), "question": (-1165870106, 0), "outrageous": (-82927150, 0)}
    df = spark.createDataFrame([(w,) for w in golden], "w string")
    out = df.select("w", key_hash(F.col("w"), "string").alias("h"), channels.hash_channel(df, "w", 2).alias("c"))
    assert {r.w: (r.h, r.c) for r in out.collect()} == golden


def test_string_hash_any(spark):
    words = ["", "a", "é", "a😀b", "𝒳", "漢字", "x" * 5000, "polygenelubricants"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.h for r in df.select("w", key_hash(F.col("w"), "string").alias("h")).collect()}
    assert got == {w: java_string_hash(w) for w in words}


def test_long_hash(spark):
    values = [0, 1, -1, 2**31, 2**32 + 5, -(2**63), 2**63 - 1, -123456789012345]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r.v: r.h for r in df.select("v", key_hash(F.col("v"), "bigint").alias("h")).collect()}
    assert got == {v: java_long_hash(v) for v in values}


def test_null_key_is_an_error(spark):
    df = spark.createDataFrame([(None,)], "v long")
    with pytest.raises(Exception, match="null key"):
        df.select(channels.hash_channel(df, "v", 2)).collect()


@pytest.mark.parametrize("hot_rows", [10_000_000, 10])
def test_round_robin(spark, hot_rows):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("at"))
    out = channels.rebalance_channel(df, 3, ["at"], hot_rows=hot_rows)
    assert [r.ch for r in out.orderBy("at").collect()] == [(i + 1) % 3 for i in range(500)]
    assert [(i + 1) % 3 for i in range(6)] == [1, 2, 0, 1, 2, 0]


def test_forward_and_direct(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "i int")
    got = df.select(channels.forward_channel(2, F.col("i")).alias("c")).collect()
    assert [r.c for r in got] == [0, 1, 0, 1]
    ok = df.where("i < 2").select(channels.direct_channel(2, F.col("i")).alias("c")).collect()
    assert [r.c for r in ok] == [0, 1]
    for bad in (2, -1, None):
        row = spark.createDataFrame([(bad,)], "i int")
        with pytest.raises(Exception, match="no such channel"):
            row.select(channels.direct_channel(2, F.col("i"))).collect()
    with pytest.raises(Exception, match="no such channel"):
        spark.createDataFrame([(-1,)], "i int").select(channels.forward_channel(2, F.col("i"))).collect()


def test_delivery_and_check(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("ch"))
    delivered = channels.deliver(df, 3)
    assert rows.assert_channel(delivered, "ch").count() == 100
    placed = delivered.select("ch", F.spark_partition_id().alias("p")).distinct().collect()
    assert {(r.ch, r.p) for r in placed} == {(0, 0), (1, 1), (2, 2)}
    with pytest.raises(Exception, match="not its destination"):
        wrong = df.repartition(1).withColumn("ch", F.lit(2))
        rows.assert_channel(wrong, "ch").collect()


def test_stream_spec():
    assert StreamSpec(2, "forward", id="s").queue(1) == "s-1"
    assert StreamSpec(2, "forward").id != StreamSpec(2, "forward").id
    for bad in ((0, "forward"), (2, "nearest"), (2, "hash")):
        with pytest.raises(ValueError):
            StreamSpec(*bad)


def test_channel_order_is_total(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).cast("int").alias("ch"))
    out = rows.in_channel_order(df, "ch", "id").collect()
    for c in (0, 1):
        ids = [r.id for r in out if r.ch == c]
        assert ids == sorted(ids) and len(ids) == 500
