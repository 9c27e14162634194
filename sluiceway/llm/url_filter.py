"""Judge URLs by host and path rules through hash joins.

Every URL is expanded into host suffixes and, where a suffix is known to the rules, into path
prefixes of the lengths that occur there. Expansions meet the rules in equi-joins on short hash
prefixes; full SHA-256 digests confirm a meeting, and the longest confirmed rule decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import ascii_lower

SHORT_BITS = 32


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``host, path, verdict`` rows from (host, path, verdict) triples."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for a null URL."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.greatest(F.length(rest), F.lit(1)))
    return ascii_lower(raw), F.regexp_extract(after, "^[^?#]*", 0)


def short(text: Column) -> Column:
    """The prefix of the hash that joins use."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - SHORT_BITS)


def full(text: Column) -> Column:
    return F.sha2(text, 256)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``id, host, path, rule, verdict``, one row per row of ``pages``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains if the path
    starts with the rule's path. The longest rule (host and path together) wins; among equally
    long ones the longer host, then the greater verdict (``block`` before ``allow``). Without a
    fitting rule the verdict is ``default`` and ``rule`` is null.

    Null URLs and URLs without ``://`` have an empty host and path. Rules with a null host or
    path never fit; repeated rules count once; an empty rule table leaves every URL at
    ``default``. Repeated pages and null ids give a row each; other columns of ``pages`` are not
    read. Equal (host, path) pairs are judged once, so a frequent URL costs one expansion; the
    joins with a frequent suffix are left to Spark's broadcast by size and skew splitting.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "verdict")
        .where("r_host is not null and r_path is not null")
        .distinct()
    )
    by_host = (
        rules.groupBy("r_host")
        .agg(F.collect_set(F.length("r_path")).alias("lengths"))
        .select("lengths", short(F.col("r_host")).alias("h_short"), full(F.col("r_host")).alias("h_full"))
    )
    by_rule = rules.select(
        "verdict",
        F.concat("r_host", "r_path").alias("rule"),
        F.length("r_host").alias("host_len"),
        short(F.concat_ws("\n", "r_host", "r_path")).alias("p_short"),
        full(F.concat_ws("\n", "r_host", "r_path")).alias("p_full"),
    )
    # Suffixes with more labels than any rule has cannot fit.
    most = rules.agg(F.coalesce(F.max(F.size(F.split("r_host", "\\."))), F.lit(1)).alias("most"))
    parts = F.split("_host", "\\.")
    kept = F.slice(parts, F.greatest(F.size(parts) - F.col("most") + 1, F.lit(1)), F.col("most"))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("kept")),
        lambda i: F.array_join(F.slice("kept", i, F.size("kept")), "."),
    )
    hosts = (
        urls.select("_host", "_path").distinct()
        .withColumn("most", most.scalar())
        .withColumn("kept", kept)
        .select("_host", "_path", F.explode(suffixes).alias("suffix"))
        .withColumn("h_short", short(F.col("suffix")))
    )
    known = hosts.join(by_host, "h_short").where(full(F.col("suffix")) == F.col("h_full"))
    prefixes = (
        known.select("_host", "_path", "suffix", F.explode("lengths").alias("n"))
        .where(F.col("n") <= F.length("_path"))
        .withColumn("key", F.concat_ws("\n", "suffix", F.expr("substring(_path, 1, n)")))
        .withColumn("p_short", short(F.col("key")))
    )
    fits = prefixes.join(by_rule, "p_short").where(full(F.col("key")) == F.col("p_full"))
    best = fits.groupBy("_host", "_path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_len", "verdict", "rule")).alias("best")
    )
    return urls.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
