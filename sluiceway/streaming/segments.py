"""Rows that a stream keeps in buckets, of which a micro-batch reads and writes only its own.

``path/batches_=a-b/bucket_=n`` has what the micro-batches a to b added to bucket n. A micro-batch
writes its own rows only. Every ``fan`` micro-batches their segments become one, and every ``fan``
of those again, so a row is written anew once for each power of ``fan`` in the number of
micro-batches, and about ``fan`` segments of every size are open at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluiceway.session import remove_folder

BATCHES, BUCKET = "batches_", "bucket_"


class Segments:
    """A bucketed table; with ``keys`` the newest row of a key stands, without them every row.

    ``by`` are the columns whose hash is the bucket. A micro-batch that is run again finds the
    table as the one before left it, and overwrites its own segment.
    """

    def __init__(
        self, path: str, schema: str, by: list[str], keys: list[str] | None = None,
        buckets: int = 64, fan: int = 8,
    ):
        self.path, self.schema, self.by, self.keys = path, StructType.fromDDL(schema), by, keys
        self.buckets, self.fan = buckets, fan

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/{BATCHES}={first}-{last}"

    def _complete(self, spark: SparkSession) -> list[tuple[int, int]]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = path(self.path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name, _, span = status.getPath().getName().partition("=")
            if name == BATCHES and fs.exists(path(status.getPath(), "_SUCCESS")):
                first, last = map(int, span.split("-"))
                found.append((first, last))
        return found

    def last(self, spark: SparkSession) -> int:
        """Number of the newest micro-batch; -1 without any."""
        return max((last for _, last in self._complete(spark)), default=-1)

    def at(self, spark: SparkSession, batch: int, near: DataFrame | None = None) -> DataFrame:
        """The table after ``batch``; with ``near`` at least what shares its ``by`` columns.

        ``near`` decides which buckets are read and which range of every ``by`` column reaches the
        scan. One row of it comes to the driver, with at most ``buckets`` numbers.
        """
        return self._rows(spark, 0, batch, near)

    def _rows(self, spark: SparkSession, first: int, last: int, near: DataFrame | None = None) -> DataFrame:
        """What the micro-batches ``first`` to ``last`` added, from as few segments as have it."""
        past = [s for s in self._complete(spark) if first <= s[0] and s[1] <= last]
        whole = [s for s in past if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in past)]
        if not whole:
            return spark.createDataFrame([], self.schema)
        schema = StructType([*self.schema.fields]).add(BATCHES, "string").add(BUCKET, "integer")
        reader = spark.read.schema(schema).option("basePath", self.path)
        rows = reader.parquet(*[self._folder(*s) for s in sorted(whole)])
        if near is not None:
            rows = rows.where(self._shared(near))
        if self.keys:
            number = F.split_part(F.col(BATCHES), F.lit("-"), F.lit(2)).cast("int")
            names = [c for c in self.schema.names if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names), number).alias("_row"))
            rows = rows.select(*self.keys, "_row.*")
        return rows.select(*self.schema.names)

    def _shared(self, near: DataFrame) -> Column:
        ends = [f(c).alias(f"_{f.__name__}_{c}") for c in self.by for f in (F.min, F.max)]
        seen = near.agg(F.collect_set(self._bucket()).alias("_buckets"), *ends).first()
        shared = F.col(BUCKET).isin(seen["_buckets"])
        for c in self.by:
            low, high = seen[f"_min_{c}"], seen[f"_max_{c}"]
            if low is not None:
                shared &= F.col(c).isNull() | F.col(c).between(low, high)
        return shared

    def put(self, rows: DataFrame, batch: int) -> None:
        """Add the rows of ``batch``, which has read all it needs by now, and merge segments."""
        self._write(rows, batch, batch)
        spark, size = rows.sparkSession, 1
        while batch and batch % (size * self.fan) == 0:
            size *= self.fan
        if size == 1:
            return
        # Only finished micro-batches are merged: this one may have to run again.
        first, last = batch - size, batch - 1
        if (first, last) not in self._complete(spark):
            self._write(self._rows(spark, first, last), first, last)
        for a, b in self._complete(spark):
            if first <= a and b <= last and (a, b) != (first, last):
                remove_folder(spark, self._folder(a, b))

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        """A file per bucket, or several where a bucket is large; sorted for the ranges of ``at``."""
        rows = rows.select(*self.schema.names).withColumn(BUCKET, self._bucket())
        rows = rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.by)
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(self._folder(first, last))
