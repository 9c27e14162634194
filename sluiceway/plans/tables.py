"""How the given tables stand for the streams of the two jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions.time import epoch_ms
from sluiceway.operators.rows import tokenize, union_tagged

HOUR_MS = 3_600_000
CHANNELS = 2

# The same readings in SQL.
WORDS_SQL = r"""
  words AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos
    FROM (
      SELECT doc_id,
        CASE WHEN text = '' THEN ['']
             WHEN regexp_replace(lower(text), '\W+$', '') = '' THEN []::VARCHAR[]
             ELSE regexp_split_to_array(regexp_replace(lower(text), '\W+$', ''), '\W+')
        END AS ws
      FROM documents))
"""
EVENTS_SQL = """
  ev AS (SELECT event_id, user_id, event_type, value, epoch_ms(ts) AS ms FROM events)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select("event_id", "user_id", "event_type", "value", epoch_ms(df, "ts").alias("ms"))


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running index with one entry per event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pos, word`` of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(docs, "text")


def sign_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons: the event id stands for the name."""
    return events(spark, sf_dir).where("event_type = 'signup'").select(
        "event_id", "user_id", "ms", F.col("event_id").alias("person_event")
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auctions: the value stands for the reserve."""
    return events(spark, sf_dir).where("event_type = 'purchase'").select(
        "event_id", "user_id", "ms", F.col("event_id").alias("auction_event"), "value"
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tie, id, name, ts, ms``: sign-ups with the name of the customer."""
    ev = table(spark, sf_dir, "events").where("event_type = 'signup'")
    ev = ev.select(F.col("event_id").alias("tie"), F.col("user_id").alias("id"), "ts", epoch_ms(ev, "ts").alias("ms"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return ev.join(names, "id")


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, seller, reserve, ts, ms``: purchases, the value in cents as the reserve."""
    ev = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("seller"),
        F.floor(F.col("value") * 100).cast("long").alias("reserve"), "ts", epoch_ms(ev, "ts").alias("ms"),
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and auctions in one stream, with the channel of their key."""
    both = union_tagged({"person": sign_ups(spark, sf_dir), "auction": purchases(spark, sf_dir)})
    return both.withColumn("ch", (F.col("user_id") % CHANNELS).cast("int"))


def halfway(spark: SparkSession, sf_dir: str):
    """The event index that splits the events in two halves, as a scalar subquery."""
    top = table(spark, sf_dir, "events").agg(F.expr("(max(event_id) + 1) div 2").alias("half"))
    return top.scalar()


def earlier_half(spark: SparkSession, sf_dir: str):
    """Whether ``ms`` lies in the first half of the events' time, however their ids run.

    For streams whose micro-batches have to arrive in the order of time. No time counts as late.
    """
    middle = events(spark, sf_dir).agg(F.expr("(min(ms) + max(ms)) div 2").alias("middle"))
    return F.coalesce(F.col("ms") < middle.scalar(), F.lit(False))


HALF_SQL = "(SELECT (max(event_id) + 1) // 2 FROM events)"


def control_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events re-read as changes of a per-user entry."""
    op = (
        F.when(F.col("event_type").isin("click", "view"), "put")
        .when(F.col("event_type") == "signup", "putIfAbsent")
        .when(F.col("event_type") == "error", "remove")
    )
    value = F.concat_ws("-", "event_type", F.col("event_id").cast("string"))
    return (
        events(spark, sf_dir)
        .select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"),
                value.alias("value"))
        .where("op is not null")
    )


CONTROL_LOG_SQL = """
  log AS (
    SELECT user_id AS key, event_id AS seq, concat(event_type, '-', event_id) AS value,
      CASE WHEN event_type IN ('click', 'view') THEN 'put'
           WHEN event_type = 'signup' THEN 'putIfAbsent' ELSE 'remove' END AS op
    FROM events WHERE event_type <> 'purchase')
"""


def topology_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events re-read as control rows of operators with four instances each."""
    names = ["parallelism", "task-name", "allocation-id", "instance-status", "input-stream",
             "output-stream", "instance-output", "instance-status"]
    kind = F.col("event_id") % 8
    name = F.get(F.array(*map(F.lit, names)), kind.cast("int"))
    instance = (F.col("user_id") % 4).cast("string")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("op-"), "event_type").alias("tbl"),
        F.when(kind == 0, name).otherwise(F.concat_ws("-", name, instance)).alias("key"),
        F.when(kind == 7, "remove")
        .when(kind.isin(3, 4, 5) & (F.expr("event_id div 8") % 3 == 0), "putIfAbsent")
        .otherwise("put")
        .alias("op"),
        F.when(kind == 0, (F.col("event_id") % 16 + 1).cast("string"))
        .otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
        .alias("value"),
    )
