"""Windows over streams in any order of arrival: late rows correct results, none is dropped.

No watermark is set. What a late row may still meet is kept in buckets (``segments``), of which a
micro-batch reads those of its own windows and to which it writes its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.functions.time import bucket_start
from sluiceway.operators.lookup import same_keys
from sluiceway.session import written
from sluiceway.streaming.runs import with_batches
from sluiceway.streaming.segments import Segments
from sluiceway.streaming.tables import all_batches, put_batch


def window_join_delta_stream(
    rows: DataFrame,
    kinds: tuple[str, str],
    key: str,
    ms: str,
    width_ms: int,
    columns: tuple[dict[str, str], dict[str, str]],
    path: str,
    checkpoint: str,
    buckets: int = 64,
    fan: int = 8,
) -> DataStreamWriter:
    """Inner join of two kinds of rows on the key inside aligned windows (``path/out``).

    A micro-batch joins its new left rows with all right rows, and the left rows before it with
    its new right rows, so every pair comes out once, when the later of its rows arrives.
    ``columns`` map source to result names. Rows without key or time meet nothing, as in the batch
    form. Adaptive execution splits a frequent key of a frequent window.
    """
    kept = [
        Segments(f"{path}/{side}", _side(rows, kind, key, ms, width_ms, chosen), ["window_ms"], None, buckets, fan)
        for side, kind, chosen in zip(("left", "right"), kinds, columns)
    ]

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            new = [_of_kind(batch, kind, key, ms, width_ms, c) for kind, c in zip(kinds, columns)]
            left = kept[0].at(spark, number - 1, near=new[1])
            right = kept[1].at(spark, number - 1, near=new[0])
            on = [key, "window_ms"]
            out = new[0].join(right.unionByName(new[1]), on).unionByName(left.join(new[1], on))
            put_batch(out, f"{path}/out", number)
            for table, added in zip(kept, new):
                table.put(added, number)
        finally:
            batch.unpersist()

    return with_batches(rows, checkpoint, handle)


def _of_kind(
    rows: DataFrame, kind: str, key: str, ms: str, width_ms: int, chosen: dict[str, str]
) -> DataFrame:
    mine = rows.where((F.col("kind") == kind) & F.col(key).isNotNull() & F.col(ms).isNotNull())
    named = [F.col(c).alias(n) for c, n in chosen.items()]
    return mine.select(key, bucket_start(F.col(ms), width_ms).alias("window_ms"), *named)


def _side(rows: DataFrame, *args) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in _of_kind(rows, *args).dtypes)


def counts_delta_stream(
    rows: DataFrame, keys: list[str], path: str, checkpoint: str, buckets: int = 64, fan: int = 8
) -> DataStreamWriter:
    """Rows per key as a changelog (``path/out``): ``keys, cnt, diff``.

    A count that changes is taken back (``diff`` -1) and given anew (+1) in the micro-batch that
    changes it; a new key is only given. Null keys count like others.
    """
    kept = counts_table(rows, keys, path, buckets, fan)

    def handle(batch: DataFrame, number: int) -> None:
        added = written(batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")), "added-counts")
        before = kept.at(batch.sparkSession, number - 1, near=added).withColumnRenamed("cnt", "_before")
        both = written(same_keys(added, before, keys, "left"), "changed-counts")
        now = both.select(*keys, (F.col("cnt") + F.coalesce("_before", F.lit(0))).alias("cnt"))
        gone = both.where("_before is not null").select(*keys, F.col("_before").alias("cnt"), F.lit(-1).alias("diff"))
        put_batch(gone.unionByName(now.withColumn("diff", F.lit(1))), f"{path}/out", number)
        kept.put(now, number)

    return with_batches(rows, checkpoint, handle)


def tumbling_counts_delta_stream(
    rows: DataFrame, ms: str, width_ms: int, path: str, checkpoint: str, buckets: int = 64, fan: int = 8
) -> DataStreamWriter:
    """The changelog of rows per aligned window (``window_ms, cnt, diff``)."""
    placed = rows.select(bucket_start(F.col(ms), width_ms).alias("window_ms"))
    return counts_delta_stream(placed, ["window_ms"], path, checkpoint, buckets, fan)


def counts_table(rows: DataFrame, keys: list[str], path: str, buckets: int = 64, fan: int = 8) -> Segments:
    """The kept counts: their present state without a fold of the changelog."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return Segments(f"{path}/counts", f"{schema}, cnt long", keys, keys, buckets, fan)


def folded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a changelog comes to: rows that were given and not taken back."""
    changes = all_batches(spark, path, f"{schema}, diff int")
    names = [c for c in changes.columns if c not in ("diff", "batch")]
    return changes.groupBy(*names).agg(F.sum("diff").alias("_n")).where("_n > 0").select(*names)
