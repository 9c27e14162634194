"""Running queries: to the end of the present input, or paused and resumed by a control table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.model import PAUSED, RUNNING
from sluiceway.session import written_removed


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process all input that is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def writer(df: DataFrame, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)


def with_batches(
    df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> DataStreamWriter:
    """Run ``handle`` on every micro-batch; intermediate tables go at the end of each."""

    def run(batch: DataFrame, number: int) -> None:
        with written_removed(batch.sparkSession):
            handle(batch, number)

    return writer(df, checkpoint, mode).foreachBatch(run)


class Switchable:
    """A streaming query that can be paused and resumed without losing or repeating rows.

    ``build`` returns the configured writer. Pausing stops the query; resuming starts it again
    on the same checkpoint, so rows that came in between wait in the source.
    """

    def __init__(self, build: Callable[[], DataStreamWriter], paused: bool = False):
        self._build = build
        self._query: StreamingQuery | None = None
        self.status = PAUSED
        if not paused:
            self.resume()

    def resume(self) -> None:
        if self.status == PAUSED:
            self._query = self._build().start()
            self.status = RUNNING

    def pause(self, finish: bool = True) -> None:
        """Stop, by default after what has arrived is done, so that state and offsets agree.

        A source that never runs dry needs ``finish=False``: a micro-batch that is cut short is
        run again, and overwrites its output, when the query resumes.
        """
        if self.status == RUNNING:
            if finish and self._query.isActive:
                self._query.processAllAvailable()
            self._query.stop()
            self.status = PAUSED

    def follow(self, topology: DataFrame, operator: str, finish: bool = True) -> None:
        """Take the status of the operator's instances from a topology view (few rows)."""
        mine = topology.where((F.col("operator") == operator) & (F.col("status") == PAUSED))
        self.resume() if mine.isEmpty() else self.pause(finish)

    @property
    def query(self) -> StreamingQuery | None:
        return self._query
