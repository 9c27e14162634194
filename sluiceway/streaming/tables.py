"""Tables that grow by one folder per micro-batch.

A retried micro-batch overwrites its own folder, so a table has each batch exactly once. Folders
lie below ``spark.checkpoint.dir`` or wherever the caller keeps durable data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def put_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def put_batches(df: DataFrame, path: str, number: str) -> None:
    """Rows of many batches, each to the folder of its ``number``; other batches stay."""
    rows = df.withColumnRenamed(number, "batch").repartition("batch")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def all_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(f"{path}/batch=*")


def batch_table(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The table as one batch left it, or nothing before the first batch."""
    return None if batch < 0 else spark.read.parquet(f"{path}/batch={batch}")


def batch_numbers(spark: SparkSession, path: str) -> list[int]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return [int(n.split("=")[1]) for n in names if n.startswith("batch=")]


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the newest batch; -1 without any."""
    return max(batch_numbers(spark, path), default=-1)


def keep_from(spark: SparkSession, path: str, number: int) -> None:
    """Delete the versions of a state table before ``number``; a restart needs the last two."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name.split("=")[1]) < number:
            fs.delete(status.getPath(), True)


def latest_rows(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Current row per key of a table that got the changed rows of each batch."""
    changes = all_batches(spark, path, f"{schema}, batch int")
    names = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*names), "batch").alias("_row")
    return changes.groupBy(*keys).agg(newest).select(*keys, "_row.*")


class ChangedRows:
    """A keyed table that takes the changed rows of each batch and is compacted now and then.

    ``path/batch=n`` has the rows that batch n changed, ``path/full=n`` all rows after batch n.
    A batch writes in proportion to what it changes. Every ``compact`` batches the changes so far
    become one full version, and what is older goes, so at most about ``compact`` folders stay. A
    batch that is run again finds the table as the batch before it left it. Batches that are handled
    together put their changes once, under the number of the last.
    """

    def __init__(self, path: str, keys: list[str], schema: str, compact: int = 16):
        self.path, self.keys, self.schema, self.compact = path, keys, schema, compact

    def _folders(self, spark: SparkSession) -> dict[str, list[int]]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"batch": [], "full": []}
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            kind, _, number = status.getPath().getName().partition("=")
            done = kind == "batch" or fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            if kind in found and number.isdigit() and done:
                found[kind].append(int(number))
        return found

    def at(self, spark: SparkSession, batch: int) -> DataFrame | None:
        """The table after ``batch``; nothing before the first change."""
        found = self._folders(spark)
        base = max((n for n in found["full"] if n <= batch), default=-1)
        later = [f"{self.path}/batch={n}" for n in found["batch"] if base < n <= batch]
        parts = [(f"{self.path}/full={base}", F.lit(-1))] if base >= 0 else []
        schema = StructType.fromDDL(self.schema)
        frames = [spark.read.schema(schema).parquet(p).withColumn("_at", at) for p, at in parts]
        if later:
            number = F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1).cast("int")
            frames.append(spark.read.schema(schema).parquet(*later).withColumn("_at", number))
        if not frames:
            return None
        rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        names = [c for c in schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names), "_at").alias("_row"))
        return newest.select(*self.keys, "_row.*")

    def last(self, spark: SparkSession) -> int:
        found = self._folders(spark)
        return max([*found["batch"], *found["full"]], default=-1)

    def put(self, changed: DataFrame, batch: int) -> None:
        put_batch(changed, self.path, batch)
        spark = changed.sparkSession
        found = self._folders(spark)
        base = max((n for n in found["full"] if n < batch), default=-1)
        if sum(base < n <= batch for n in found["batch"]) <= self.compact:
            return
        # As of the batch before, which a repeated run of this batch starts from.
        self.at(spark, batch - 1).write.mode("overwrite").parquet(f"{self.path}/full={batch - 1}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for kind, numbers in found.items():
            for n in numbers:
                if n < batch - (kind == "full"):
                    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{kind}={n}")
                    fs.delete(old, True)
