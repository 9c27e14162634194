"""Control tables over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.operators.control import PUT, changelog_view
from sluiceway.operators.lookup import same_keys
from sluiceway.streaming.runs import with_batches
from sluiceway.streaming.tables import ChangedRows


def changelog_stream(
    log: DataFrame, keys: list[str], path: str, checkpoint: str, compact: int = 16
) -> DataStreamWriter:
    """Keeps the current view of a changelog (see ``changelog_table``).

    Changes must arrive in order between micro-batches. What the changed keys had before enters
    as puts that come before everything else; a micro-batch writes the keys it has changed, null
    standing for absent ones.
    """
    names = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    kept = changelog_table({k: names[k] for k in keys}, path, names["value"], compact)

    def handle(batch: DataFrame, number: int) -> None:
        before = kept.at(batch.sparkSession, number - 1)
        changes = batch.select(*keys, "seq", "op", "value")
        touched = changes.select(*keys).distinct()
        if before is not None:
            known = same_keys(before.where("here"), touched, keys).select(
                *keys,
                F.lit(-(2**62)).cast("long").alias("seq"),
                F.lit(PUT).alias("op"),
                "value",
            )
            changes = known.unionByName(changes)
        view = changelog_view(changes, keys).withColumn("here", F.lit(True))
        now = same_keys(touched, view, keys, "left").select(*keys, "value", F.coalesce("here", F.lit(False)).alias("here"))
        kept.put(now, number)

    return with_batches(log, checkpoint, handle)


def changelog_table(keys: dict[str, str], path: str, value: str = "string", compact: int = 16) -> ChangedRows:
    """The table behind a changelog stream: key columns (name -> type), ``value`` and ``here``."""
    columns = ", ".join(f"{k} {t}" for k, t in keys.items())
    return ChangedRows(path, list(keys), f"{columns}, value {value}, here boolean", compact)


def changelog_state(spark: SparkSession, keys: dict[str, str], path: str) -> DataFrame | None:
    """The view a changelog stream has reached."""
    kept = changelog_table(keys, path)
    now = kept.at(spark, kept.last(spark))
    return None if now is None else now.where("here").drop("here")
