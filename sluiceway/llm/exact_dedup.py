"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations alone.

Rows are dealt to runs by the block of the table that they stand in. A run holds each digest once,
sorted, with its best row and its number of rows. In binomial rounds runs exchange digests: where
a digest and its run differ in the bits of the round, the digest moves to the run that has its
bits. Three rounds of the binomial tree are taken at a time, so that a run merges what up to eight
runs send it. After the last round all entries of a digest are in one run. A text that a third of
all rows share has one entry per run from the start and an eighth of them after each exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import blocks, stored

RUN_ROWS = 1 << 20
BLOCK_BITS = 16  # rows that stand together in the table and go to one run
MERGE_BITS = 3


def merge_round(entries: DataFrame, runs: int, mask: int) -> DataFrame:
    """Send every entry to the run that has the digest's bits under ``mask``, and merge the runs.

    Equal digests are one entry only if length and SHA-256 agree too. The best row of an entry is
    the largest of the best rows merged.
    """
    keys = ["run", "digest", "size", "sha"]
    run = F.col("run").bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("digest").bitwiseAND(F.lit(mask)))
    dealt = entries.withColumn("run", run.cast("int")).repartitionById(runs, "run").sortWithinPartitions(*keys)
    return dealt.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def merged_runs(entries: DataFrame, runs: int) -> DataFrame:
    """All rounds; ``runs`` is a power of two."""
    bits = runs.bit_length() - 1
    for low in range(0, bits, MERGE_BITS):
        width = min(MERGE_BITS, bits - low)
        entries = merge_round(entries, runs, ((1 << width) - 1) << low)
    return entries


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int | None = None,
    digest: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the
    largest id stays (``keep="smallest"``: with the smallest). Exactly one row of a group is
    ``kept``, also where ids repeat. A row with a null id stays only if its group has no other id;
    then ``keep_id`` is null. Other columns are not read. An empty table gives an empty result.

    ``digest`` orders the runs; texts that it confuses are told apart by length and SHA-256 in
    every merge. ``runs`` is raised to a power of two; by default there are as many as shuffle
    partitions, more where a run would pass ``RUN_ROWS`` rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.typeName()
    if keep == "smallest" and kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"keep='smallest' needs integer ids, not {kind}")
    rank = F.col("id") if keep == "largest" else -F.col("id")
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            digest(text).cast("long").alias("digest"),
            F.octet_length(text).alias("size"),
            F.unhex(F.sha2(text, 256)).alias("sha"),
        ),
        "digest-rows",
    )
    wanted = runs or max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks(rows.count(), RUN_ROWS))
    count = 1 << (wanted - 1).bit_length()
    run = F.pmod(F.xxhash64(F.shiftright("row", BLOCK_BITS)), F.lit(count)).cast("int")
    rows = rows.withColumn("run", run)
    keys = ["digest", "size", "sha"]
    best = F.max(F.struct(rank.alias("rank"), F.col("row"), F.col("id"))).alias("best")
    entries = stored(rows.groupBy("run", *keys).agg(best, F.count("*").alias("n")), "digest-runs")
    final = merged_runs(entries, count).select(*keys, "best", F.col("n").alias("group_size"))
    # A digest has at most one entry per run, and a run's rows of a digest are bounded by the run.
    told = entries.select("run", *keys).join(final, keys)
    return rows.join(told, ["run", *keys]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
