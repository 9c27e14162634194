"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

Rows with equal texts share a place on the ring. The ring is cut into a fixed number of arcs;
all rows of an arc form one key, and a text that alone outweighs an arc is split into sub-keys
at its place. Each key asks the shards in the order in which their virtual nodes follow it
clockwise; a shard takes keys until it holds its share. Only the table of keys, whose size does
not depend on the number of rows, passes through the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import fresh, stored

ARCS = 1 << 15
VIRTUAL_NODES = 64


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``at, prefs``: arcs that hold a virtual node, and the shards from there on, clockwise.

    The ring has ``shards * virtual_nodes`` rows whatever the data.
    """
    nodes = spark.range(shards * virtual_nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("copy")
    ).withColumn("at", F.pmod(F.xxhash64("shard", "copy"), F.lit(ARCS)).cast("int"))
    starts = nodes.select("at").distinct()
    # Distance clockwise from each start to the nearest node of each shard.
    near = nodes.groupBy("shard").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    each = starts.select("at", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    pairs = each.join(near, "shard").select(
        "at",
        "shard",
        F.array_min(F.transform("ats", lambda a: F.pmod(a - F.col("at"), F.lit(ARCS)))).alias("gap"),
    )
    return pairs.groupBy("at").agg(
        F.sort_array(F.collect_list(F.struct("gap", F.xxhash64("at", "shard").alias("tie"), "shard"))).alias("p")
    ).select("at", F.col("p.shard").alias("prefs"))


def place_keys(keys: DataFrame, shards: int, load_factor: float, virtual_nodes: int) -> DataFrame:
    """Give every key (``arc, salt, bytes, n``) its ``shard``.

    In each round a key asks its next shard; a shard serves the keys it already holds first, then
    large before small ones, and takes a key while what it holds is below the cap. As the caps
    add up to the total at least, no key is left after as many rounds as there are shards.
    """
    spark = keys.sparkSession
    cap = keys.agg((F.sum("bytes") * F.lit(load_factor) / shards).alias("cap"))
    nodes = ring(spark, shards, virtual_nodes)
    first = nodes.orderBy("at").limit(1)  # the walk goes on at the start of the ring
    # The next node clockwise; both sides have a fixed size.
    both = keys.select("arc", "salt", "bytes", "n", F.lit(None).cast("array<int>").alias("prefs")).unionByName(
        nodes.select(F.col("at").alias("arc"), "prefs"), allowMissingColumns=True
    )
    ahead = Window.orderBy(F.col("arc").desc(), F.col("prefs").isNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = both.withColumn("next", F.last("prefs", ignorenulls=True).over(ahead)).where("bytes is not null")
    placed = (
        found.withColumn("prefs", F.coalesce("next", first.select("prefs").scalar()))
        .withColumn("cap", cap.scalar())
        .select("arc", "salt", "bytes", "n", "prefs", "cap", F.lit(None).cast("int").alias("shard"),
                F.lit(shards).alias("round"))
    )
    for k in range(shards):
        asked = F.coalesce("shard", F.get("prefs", F.lit(k)))
        order = Window.partitionBy("asked").orderBy("round", F.col("bytes").desc(), "arc", "salt")
        before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        fits = F.col("shard").isNotNull() | (F.col("before") < F.col("cap"))
        placed = (
            placed.withColumn("asked", asked)
            .withColumn("before", before)
            .select("arc", "salt", "bytes", "n", "prefs", "cap",
                    F.when(fits, F.col("asked")).alias("shard"),
                    F.when(F.col("shard").isNull() & fits, F.lit(k)).otherwise(F.col("round")).alias("round"))
        )
    return placed.select("arc", "salt", "bytes", "n", "shard")


def bounded_shards(
    docs: DataFrame,
    shards: int = 8,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    load_factor: float = 1.0,
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """``id, size, text_crc32, shard, slot``, one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one (a null text counts as empty). No shard holds more
    than ``load_factor`` times the mean size plus one key, and a key is about one part in 32,768
    of all bytes or a single row. With ``load_factor`` 1 the shards are as equal as that allows;
    a greater one leaves more keys at home. Equal texts stay together unless they alone outweigh
    a key or their key meets a full shard's edge. ``slot`` numbers a shard's rows from 0.

    Rows that agree in id, size and checksum are interchangeable; repeated rows and null ids get
    a slot each. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    group, arc, salt = fresh("g"), "arc", "salt"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias(group),
    )
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("total")).scalar()
    # At most ARCS texts outweigh an arc's mean share.
    sums = rows.groupBy(group).agg(F.sum("size").alias("bytes"))
    heavy = sums.withColumn("share", total / ARCS).where("bytes > share").select(
        group, F.ceil(F.col("bytes") / F.col("share")).alias("parts")
    )
    rows = (
        rows.join(F.broadcast(heavy), group, "left")
        .withColumn(arc, F.pmod(F.col(group), F.lit(ARCS)).cast("int"))
        .withColumn(
            salt,
            F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(
                F.pmod(F.xxhash64("_id", group), F.col("parts"))
            ).cast("long"),
        )
        .drop("parts")
    )
    # A split text keeps its own sub-keys, apart from the other texts of its arc.
    rows = rows.withColumn(group, F.when(F.col(salt) >= 0, F.col(group)).otherwise(F.lit(0)))
    rows = rows.withColumn(salt, F.when(F.col(salt) >= 0, F.xxhash64(group, salt)).otherwise(F.lit(0)))
    sums = rows.groupBy(arc, salt).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    keys = stored(sums, "shard-keys")
    placed = place_keys(keys, shards, load_factor, virtual_nodes)
    order = Window.partitionBy("shard").orderBy(arc, salt)
    starts = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most 2 * ARCS + ARCS keys, so the table of keys can always be broadcast.
    placed = stored(placed.withColumn("start", starts).select(arc, salt, "shard", "start"), "shard-places")
    within = Window.partitionBy(arc, salt).orderBy("_id", "size", "text_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(placed), [arc, salt])
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
        )
    )
