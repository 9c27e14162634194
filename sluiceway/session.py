"""Session defaults and the shared folder that durable channels and checkpoints live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sluiceway")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="sluiceway-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder path below ``spark.checkpoint.dir``.

    The cluster names that folder and every executor can reach it. Only in local mode (tests, a
    laptop) a temporary folder can take its place; elsewhere an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider; it also spills, so state may exceed memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


_scope: ContextVar[list[str] | None] = ContextVar("sluiceway-scope", default=None)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


@contextmanager
def written_removed(spark: SparkSession) -> Iterator[None]:
    """What ``written`` leaves in the shared folder within it is deleted at its end.

    For code that is through with its results by then, such as a micro-batch.
    """
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in mine:
            remove_folder(spark, path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts the lineage for results that several later steps use, and gives the planner the true
    size, so that it broadcasts the result only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = shared_dir(df.sparkSession, purpose)
    mine = _scope.get()
    if mine is not None:
        mine.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
