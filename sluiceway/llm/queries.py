"""The registered queries of this subpackage, one per operator, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.ann import nearest
from sluiceway.llm.bpe import bpe_round_trip
from sluiceway.llm.common import table
from sluiceway.llm.exact_dedup import exact_duplicates
from sluiceway.llm.hard_negatives import hard_negatives
from sluiceway.llm.licenses import BASE, license_scan
from sluiceway.llm.merkle import verified_documents
from sluiceway.llm.metric_join import near_duplicate_vectors
from sluiceway.llm.packing import packed_documents
from sluiceway.llm.quality import fit, judge
from sluiceway.llm.sharding import bounded_shards
from sluiceway.llm.simhash import simhash_components
from sluiceway.llm.suffix_dedup import without_repeats
from sluiceway.llm.url_filter import judge_urls, rules_table

QUERIES = {}
SQL = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# The rules that the query judges by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query(
    "op2_url_filter",
    """
    WITH u AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (
      SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
      FROM h),
    rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
      ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    fit AS (
      SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p.p)
      GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)
    """.replace("starts_with(path, p.p)", "starts_with(path, rules.p)"),
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = bounded_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_simhash_dedup")
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), TOKENIZER, digests=True)


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), BASE)


@query("op10_embedding_dedup")
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select(
        "doc_id", "source", "lang", F.col("_evidence").alias("evidence"), F.col("_host_rate").alias("host_rate"),
        F.col("_path_rate").alias("path_rate"), F.col("_posterior").alias("posterior"),
        F.col("_rejected").alias("rejected"),
    )


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
    )


@query(
    "op12_exact_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size, sha256(text) AS text_sha256 FROM t GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text)
    """,
)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def _encoded_sql(column: str, value: str | None = None) -> str:
    value = f"CAST({value or column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(strlen({value}), ':', {value}) END"


_FIELDS_SQL = " || ".join(f"({_encoded_sql(c)})" for c in ("doc_id", "source", "lang", "n_chars"))


@query(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE bytes AS (
      SELECT doc_id, flatten(list_transform(range(length(doc_id::VARCHAR)),
        lambda i: [ascii(substr(doc_id::VARCHAR, i + 1, 1)), 0, 0, 0, 0, 0, 0, 0])) AS b
      FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
    crc AS (
      SELECT doc_id, list_reduce(b, lambda acc, x: CASE WHEN xor(acc, x) & 1 = 1 THEN xor(xor(acc, x) >> 1, 3988292384)
        ELSE xor(acc, x) >> 1 END, 4294967295::BIGINT) AS reg FROM bytes),
    leaf AS (
      SELECT d.doc_id, source, sha256({_FIELDS_SQL} || ({_encoded_sql("text")})) AS leaf,
        CASE WHEN reg & 1 = 1 THEN sha256({_FIELDS_SQL} || ({_encoded_sql("text", "replace(text, chr(10), '')")}))
             ELSE sha256({_FIELDS_SQL} || ({_encoded_sql("text")})) END AS shown
      FROM documents d LEFT JOIN crc USING (doc_id)),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n FROM leaf),
    up AS (
      SELECT source, 0 AS lvl, pos, leaf AS h, n FROM placed
      UNION ALL
      SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
      FROM up WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
    sub AS (
      SELECT source, h AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
        count(*) OVER () AS n FROM up WHERE n = 1),
    over AS (
      SELECT 0 AS lvl, pos, subroot AS h, n FROM sub
      UNION ALL
      SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
      FROM over WHERE n > 1 GROUP BY lvl, pos // 3, n),
    top AS (SELECT h AS root, lvl AS height FROM over WHERE n = 1),
    nodes AS (
      SELECT source, false AS upper, lvl, pos, h FROM up WHERE n > 1
      UNION ALL SELECT NULL, true, lvl, pos, h FROM over WHERE n > 1),
    steps AS (
      SELECT p.source, p.pos AS place, false AS upper, p.source AS tree, s.height AS levels, 0 AS base, p.pos AS spot
      FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source
      UNION ALL
      SELECT p.source, p.pos, true, NULL, t.height, s.height, s.pos
      FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source, top t),
    path AS (
      SELECT source, place, upper, tree, base + lvl AS depth, lvl, spot // (3 ** lvl)::BIGINT AS spot
      FROM (SELECT *, unnest(range(levels)) AS lvl FROM steps)),
    sides AS (
      SELECT a.source, a.place, a.depth,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.spot), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.spot), '') AS r
      FROM path a JOIN nodes b ON a.upper = b.upper AND a.tree IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl
        AND b.pos // 3 = a.spot // 3
      GROUP BY a.source, a.place, a.depth),
    fold AS (
      SELECT p.source, p.pos AS place, 0 AS depth, shown AS acc FROM placed p
      UNION ALL
      SELECT f.source, f.place, f.depth + 1, sha256(s.l || f.acc || s.r)
      FROM fold f JOIN sides s ON f.source IS NOT DISTINCT FROM s.source AND f.place = s.place AND f.depth = s.depth),
    folded AS (SELECT source, place, arg_max(acc, depth) AS folded_root FROM fold GROUP BY source, place),
    proofs AS (SELECT source, place, sha256(string_agg(l || r, '' ORDER BY depth)) AS proof FROM sides GROUP BY source, place)
    SELECT p.doc_id, p.leaf, s.subroot, t.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.folded_root,
      f.folded_root = t.root AS verified
    FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source
    JOIN folded f ON p.source IS NOT DISTINCT FROM f.source AND p.pos = f.place
    LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.pos = q.place, top t
    """,
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    beside = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    return verified_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), "folded_root", "verified",
    )


@query(
    "op13_hard_negatives",
    """
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
    p AS (
      SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, positive_id,
      row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
      other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
      AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=relabelled)
