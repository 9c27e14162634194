"""Ordered durable channels: numbered blocks of rows with positions, appended exactly once.

Every channel is a sequence of rows with positions 0, 1, 2, ... An append puts its rows after those
that are there, in an order that the caller names, and cuts each channel's rows into blocks. The
manifest tells each block's channel and its first and last position. Readers take whole blocks in
the order of the manifest, up to a number of rows per micro-batch, so a long backlog comes in many
micro-batches of bounded size and still in the channel's order. Many small micro-batches can be
handled in one round of jobs, each with the blocks and number that it would have alone.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.operators.lookup import same_keys
from sluiceway.operators.ordinal import running_ordinal
from sluiceway.session import written
from sluiceway.streaming.runs import with_batches
from sluiceway.streaming.tables import all_batches, batch_numbers, batch_table, keep_from, last_batch, put_batch

BLOCK_ROWS = 100_000
MICRO_BATCH_BLOCKS = 1_000  # a reader's micro-batch, or round of them, names its blocks' folders one by one
MANIFEST = "ch int, block long, first long, last long, nth long, until long"


def append_blocks(rows: DataFrame, path: str, batch: int, order: list[str], channel: str = "ch", block_rows: int = BLOCK_ROWS) -> None:
    """Append ``rows`` to their channels in the order of ``order``, as batch ``batch`` of the log.

    ``order`` is unique within a channel; a null channel is an error. Rows get ``position`` (their
    place in the channel) and ``block``. A batch that is appended again after a failure overwrites
    itself with the same positions. Batches are appended one after the other; the manifest is
    written last, and a batch without it isn't there for readers.

    ``path/rows`` has the rows by batch and block, ``path/manifest`` one row per block with its
    number in the log (``nth``) and the rows of the log up to its end (``until``), ``path/next`` one
    row per channel: the next position.
    """
    spark = rows.sparkSession
    known = F.when(F.col(channel).isNull(), F.raise_error(F.lit("null channel")).cast("int")).otherwise(F.col(channel).cast("int"))
    start = batch_table(spark, f"{path}/next", batch - 1)
    numbered = running_ordinal(rows.withColumn(channel, known), [channel], order, "position")
    if start is not None:
        numbered = same_keys(numbered, start.select(channel, F.col("next").alias("_next")), [channel], "left")
        numbered = numbered.withColumn("position", F.col("position") + F.coalesce("_next", F.lit(0))).drop("_next")
    numbered = numbered.withColumn("position", F.col("position") - 1)
    numbered = written(numbered.withColumn("block", F.expr(f"position div {block_rows}")), "channel-rows")
    # One file per block: a block holds a bounded number of rows.
    placed = numbered.repartition(channel, "block").sortWithinPartitions(channel, "block", "position")
    placed.withColumn("_ch", F.col(channel)).withColumn("_block", F.col("block")).write.mode("overwrite").partitionBy(
        "_ch", "_block").parquet(f"{path}/rows/batch={batch}")
    blocks = numbered.groupBy(channel, "block").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    blocks = written(blocks, "channel-blocks")
    held = batch_table(spark, f"{path}/ends", batch - 1)
    nth, until = (0, 0) if held is None else held.first()
    # One row per block of this batch.
    before = Window.orderBy("block", channel)
    manifest = written(
        blocks.select(
            F.col(channel).cast("int").alias("ch"), "block", "first", "last",
            (F.row_number().over(before) + F.lit(nth)).cast("long").alias("nth"),
            (F.sum(F.col("last") - F.col("first") + 1).over(before) + F.lit(until)).cast("long").alias("until"),
        ), "channel-manifest")
    now = blocks.groupBy(channel).agg((F.max("last") + 1).alias("next"))
    if start is not None:
        rest = same_keys(start, now.select(channel, F.lit(True).alias("_here")), [channel], "left").where("_here is null")
        now = now.unionByName(rest.select(channel, "next"))
    put_batch(now, f"{path}/next", batch)
    ends = manifest.agg(F.coalesce(F.max("nth"), F.lit(nth)).cast("long").alias("nth"), F.coalesce(F.max("until"), F.lit(until)).cast("long").alias("until"))
    put_batch(ends, f"{path}/ends", batch)
    put_batch(manifest, f"{path}/manifest", batch)
    keep_from(spark, f"{path}/next", batch - 1)
    keep_from(spark, f"{path}/ends", batch - 1)


def channel_log_write(
    rows: DataFrame, path: str, checkpoint: str, order: list[str], channel: str = "ch", block_rows: int = BLOCK_ROWS
) -> DataStreamWriter:
    """Append a stream to a channel log, every micro-batch as one batch, exactly once."""
    return with_batches(rows, checkpoint, lambda batch, number: append_blocks(batch, path, number, order, channel, block_rows))


def channel_log_read(spark: SparkSession, path: str, schema: str, blocks: DataFrame | None = None) -> DataFrame:
    """Rows of the log, of all blocks or of those in ``blocks`` (rows of the manifest), with ``position``.

    If blocks have a ``number``, their rows get it too.
    """
    full = f"{schema}, position long, block long"
    reader = spark.read.schema(f"{full}, batch int, _ch int, _block long").option("basePath", f"{path}/rows")
    if blocks is None:
        rows = reader.parquet(f"{path}/rows/batch=*").where(F.col("batch") <= last_batch(spark, f"{path}/manifest"))
    else:
        # Their folders only: listing the whole log for every micro-batch would grow with its square.
        folders = [f"{path}/rows/batch={b.batch}/_ch={b.ch}/_block={b.block}" for b in blocks.select("batch", "ch", "block").collect()]
        rows = reader.parquet(*folders) if folders else spark.createDataFrame([], f"{full}, batch int, _ch int, _block long")
    if blocks is not None and "number" in blocks.columns:
        numbers = blocks.select("batch", F.col("ch").alias("_ch"), F.col("block").alias("_block"), "number")
        rows = rows.join(F.broadcast(numbers), ["batch", "_ch", "_block"])  # one row per block, of a bounded number
    return rows.drop("batch", "_ch", "_block")


def take_blocks(spark: SparkSession, path: str, after: int, budget: int) -> tuple[DataFrame | None, int]:
    """The blocks after the first ``after`` of the log that hold up to ``budget`` rows, at least one
    block and ``MICRO_BATCH_BLOCKS`` at most, and the number of the last of them."""
    if last_batch(spark, f"{path}/manifest") < 0:
        return None, after
    manifest = all_batches(spark, f"{path}/manifest", f"{MANIFEST}, batch int")
    done = manifest.where(F.col("nth") == after).agg(F.coalesce(F.max("until"), F.lit(0))).first()[0]
    left = manifest.where((F.col("nth") > after) & (F.col("nth") <= after + MICRO_BATCH_BLOCKS))
    end = left.where((F.col("until") - F.lit(done) <= budget) | (F.col("nth") == after + 1)).agg(F.max("nth")).first()[0]
    if end is None:
        return None, after
    return left.where(F.col("nth") <= end), end


def cut_blocks(blocks: list[tuple[int, int]], done: int, budget: int, more: bool) -> list[int]:
    """Last blocks of the micro-batches that ``take_blocks`` would take one after the other.

    ``blocks`` are (number in the log, rows up to its end) of the blocks that follow the first
    ``done`` rows. If the log has ``more``, what the last of them belong to is left for later.
    """
    ends, last = [], None
    for nth, until in blocks:
        if last is not None and until - done > budget:
            ends.append(last[0])
            done = last[1]
        last = nth, until
    if last is not None and (not more or not ends):
        ends.append(last[0])
    return ends


class LogReader:
    """Takes a channel log in micro-batches of bounded size and gives each to ``handle(rows, number)``.

    ``progress`` tells of every micro-batch the last block it took. This is written before a
    micro-batch is handled, and a row after it; a micro-batch that was not finished is handed over
    again with the same blocks and number, so that a ``handle`` that overwrites by number sees
    every row exactly once.

    A round is a run of micro-batches, of up to ``MICRO_BATCH_BLOCKS`` blocks together, that costs as
    many jobs as one of them. Its ``handle(rows, numbers)`` gets their numbers and rows that have
    theirs as ``number``; a round that was not finished is handed over again as a whole.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, progress: str, budget: int):
        self.spark, self.path, self.schema, self.progress, self.budget = spark, path, schema, progress, budget

    def _manifest(self) -> DataFrame:
        return all_batches(self.spark, f"{self.path}/manifest", f"{MANIFEST}, batch int")

    def _ends(self, number: int) -> dict[int, int]:
        """Last blocks of the micro-batches that were taken together with ``number``, by number."""
        folder = f"{self.progress}/taken"
        for of in sorted(n for n in batch_numbers(self.spark, folder) if n >= number):
            rows = self.spark.read.schema("nth long, number int").parquet(f"{folder}/batch={of}").collect()
            if rows:  # none if the write was cut short
                return {of if r.number is None else r.number: r.nth for r in rows}
        return {}

    def _plan(self, after: int) -> list[int]:
        """Last blocks of the next round's micro-batches."""
        if last_batch(self.spark, f"{self.path}/manifest") < 0:
            return []
        near = (F.col("nth") >= after) & (F.col("nth") <= after + MICRO_BATCH_BLOCKS + 1)
        rows = sorted((r.nth, r.until) for r in self._manifest().where(near).select("nth", "until").collect())
        done = rows.pop(0)[1] if rows and rows[0][0] == after else 0
        return cut_blocks(rows[:MICRO_BATCH_BLOCKS], done, self.budget, len(rows) > MICRO_BATCH_BLOCKS)

    def _next(self, together: bool) -> tuple[int, dict[int, int]]:
        """The block after which to go on, and the last blocks of what is to be handled, by number."""
        number = last_batch(self.spark, f"{self.progress}/done") + 1
        after = self._ends(number - 1)[number - 1] if number else 0
        ends = {n: end for n, end in self._ends(number).items() if n >= number}
        if not ends:
            if together:
                ends = dict(enumerate(self._plan(after), number))
            else:
                blocks, end = take_blocks(self.spark, self.path, after, self.budget)
                ends = {} if blocks is None else {number: end}
            if ends:
                rows = self.spark.createDataFrame([(end, n) for n, end in ends.items()], "nth long, number int")
                put_batch(rows.coalesce(1), f"{self.progress}/taken", max(ends))
        return after, ends

    def _done(self, number: int, end: int) -> None:
        put_batch(self.spark.range(1).select(F.lit(end).cast("long").alias("nth")), f"{self.progress}/done", number)

    def step(self, handle) -> bool:
        """One micro-batch; false if the log holds nothing new."""
        after, ends = self._next(False)
        if not ends:
            return False
        number = min(ends)
        blocks = self._manifest().where((F.col("nth") > after) & (F.col("nth") <= ends[number]))
        handle(channel_log_read(self.spark, self.path, self.schema, blocks), number)
        self._done(number, ends[number])
        return True

    def round(self, handle) -> int:
        """Several micro-batches in one round of jobs; their number, 0 if the log holds nothing new."""
        after, ends = self._next(True)
        if not ends:
            return 0
        numbers = range(min(ends), max(ends) + 1)
        bounds = [ends[n] for n in numbers]
        taken = self._manifest().where((F.col("nth") > after) & (F.col("nth") <= bounds[-1])).collect()
        blocks = [(b.batch, b.ch, b.block, numbers[bisect_left(bounds, b.nth)]) for b in taken]
        blocks = self.spark.createDataFrame(blocks, "batch int, ch int, block long, number int")
        handle(channel_log_read(self.spark, self.path, self.schema, blocks), numbers)
        self._done(numbers[-1], bounds[-1])
        return len(numbers)

    def drain(self, handle, together: bool = False) -> int:
        """Micro-batches until the log is read, one by one or ``together`` in rounds; gives their number."""
        steps = 0
        while more := (self.round(handle) if together else self.step(handle)):
            steps += more
        return steps
