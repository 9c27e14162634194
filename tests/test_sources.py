from __future__ import annotations

from pyspark.sql import functions as F

from sluiceway.operators.rows import envelope, flat_map, flat_map_rows, union_tagged, unwrap
from sluiceway.sources import generator


def test_generator_ends_at_the_first_end(spark):
    idx = generator.index_range(spark, 100)
    out = generator.generate(idx, {"double": F.col("idx") * 2}, ends=F.col("idx").isin(40, 20, 60))
    assert out.agg(F.max("idx"), F.count("*")).first() == (19, 20)
    everything = generator.generate(idx, {"double": F.col("idx") * 2}, ends=F.lit(False))
    assert everything.count() == 100


def test_generator_function_ends_at_none(spark):
    idx = generator.index_range(spark, 100, start=5)
    out = generator.generate_with(idx, lambda i: None if i in (30, 50) else (f"r{i}",), "name string")
    got = sorted(map(tuple, out.collect()))
    assert got == sorted((i, f"r{i}") for i in range(5, 30))


def test_limit_reaches_the_scan(spark, small):
    df = generator.before(spark.read.parquet(f"{small}/events.parquet"), 100, "event_id")
    assert "LessThan(event_id,100)" in df._jdf.queryExecution().executedPlan().toString()


def test_flat_map_rows_keeps_types(spark):
    df = spark.createDataFrame([(2**60 + 1, None), (3, "x")], "n long, s string")
    got = flat_map_rows(df, lambda row: [row, row] if row["s"] is None else None, "n long, s string").collect()
    assert [tuple(r) for r in got] == [(2**60 + 1, None)] * 2


def test_flat_map_drops_and_multiplies(spark):
    def repeat(batches):
        import pyarrow as pa

        for b in batches:
            out = [v for v in b.column("id").to_pylist() for _ in range(v)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["id"])

    got = flat_map(spark.range(4), repeat, "id long").collect()
    assert sorted(r.id for r in got) == [1, 2, 2, 3, 3, 3]


def test_envelope_round_trip(spark):
    df = spark.range(10).withColumn("name", F.lit("x"))
    wrapped = envelope(df, "Op", 3, F.col("id") % 3)
    assert wrapped.select("src.operator", "src.parallelism", "dest", "channel_type").first() == ("Op", 3, 0, 0)
    assert sorted(map(tuple, unwrap(wrapped).collect())) == sorted(map(tuple, df.collect()))


def test_union_of_different_shapes(spark):
    a = spark.createDataFrame([(1, "n")], "id long, name string")
    b = spark.createDataFrame([(2, 9)], "id long, reserve long")
    got = union_tagged({"person": a, "auction": b}).select("kind", "id", "name", "reserve").collect()
    assert sorted(map(tuple, got)) == [("auction", 2, None, 9), ("person", 1, "n", None)]
