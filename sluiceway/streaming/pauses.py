"""Pausing single instances of a running stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.model import PAUSED
from sluiceway.operators.lookup import same_keys
from sluiceway.operators.pauses import hold_rows, resequenced
from sluiceway.session import written
from sluiceway.streaming.runs import with_batches
from sluiceway.streaming.tables import ChangedRows, all_batches, batch_table, keep_from, put_batch


def pausable_stream(
    stream: DataFrame, keys: list[str], seq: str, control: str, status: str, root: str, checkpoint: str
) -> DataStreamWriter:
    """Rows and the control rows among them, in the order of ``seq`` from micro-batch to micro-batch.

    Where the boolean column ``control`` is true, a row sets its instance's ``status`` (see
    ``hold_rows``). ``root/out`` gets the rows that go on, with ``held``, ``release`` and
    ``position``; positions go on from micro-batch to micro-batch.

    Rows that are held when their micro-batch ends are written once, to ``root/held``. A
    micro-batch in which a paused instance resumes reads those of that instance from there; the
    folder is emptied when no instance is paused. Besides there is a row per instance (its status
    and its last resume) and the number of rows that went out. A repeated micro-batch starts from
    what the one before it left.
    """
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    kept = ChangedRows(f"{root}/status", keys, f"{kinds}, {status} string, resumed long")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = written(batch, "pause-batch")
        is_control = F.coalesce(F.col(control), F.lit(False))
        changes = batch.where(is_control).select(*keys, seq, status)
        rows = batch.where(~is_control).drop(control, status)
        before = kept.at(spark, number - 1)
        start = None if before is None else before.select(*keys, status)
        new = written(hold_rows(rows, changes, keys, seq, status, start), "pause-new")
        gone = new.where("release is not null")

        runs = F.coalesce(F.col(status) != PAUSED, F.lit(True))
        if before is not None:
            paused = before.where(F.col(status) == PAUSED).select(*keys, F.col("resumed").alias("_since"))
            resumes = changes.where(runs).groupBy(*keys).agg(F.min(seq).alias("_release"))
            resumes = written(same_keys(paused, resumes, keys), "pause-resumes")
            if not resumes.isEmpty():
                held = all_batches(spark, f"{root}/held", new.drop("release").schema).where(F.col("batch") < number)
                back = same_keys(held.drop("batch"), resumes, keys)
                back = back.where(F.coalesce(F.col(seq) > F.col("_since"), F.lit(True)))
                gone = gone.unionByName(back.select(*held.drop("batch").columns, F.col("_release").alias("release")))
            if paused.isEmpty():  # then the batch before left no row either
                keep_from(spark, f"{root}/held", number)

        total = batch_table(spark, f"{root}/sent", number - 1)
        sent = 0 if total is None else total.first()[0]
        out = written(resequenced(gone, seq, start=sent), "pause-out")
        put_batch(out, f"{root}/out", number)
        put_batch(new.where("release is null").drop("release"), f"{root}/held", number)
        put_batch(out.agg((F.count(F.lit(1)) + sent).alias("sent")), f"{root}/sent", number)
        keep_from(spark, f"{root}/sent", number - 1)

        last = changes.groupBy(*keys).agg(
            F.max_by(status, seq).alias(status), F.max(F.when(runs, F.col(seq))).alias("resumed")
        )
        if before is not None:
            known = before.select(*keys, F.col("resumed").alias("_resumed"))
            last = same_keys(last, known, keys, "left").withColumn("resumed", F.coalesce("resumed", "_resumed"))
        kept.put(last.select(*keys, status, "resumed"), number)

    return with_batches(stream, checkpoint, handle)
