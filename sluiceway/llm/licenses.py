"""License scan by diagonal voting, in DataFrame operations alone.

Every run of ``k`` words in a document is hashed and joined with the same runs of the templates.
A hit at document word i and template word j votes for the diagonal i - j. Votes are counted per
diagonal; a diagonal with every run of a template is an exact place of it. Neighbouring diagonals
are merged to spans, which allows for words put in or left out, and a span is verified by how
much of the template it covers and how long it is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import ascii_lower, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
BROADCAST_ROWS = 100_000  # a template table of more runs is shuffled

# Phrases whose every place counts, with their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Further templates: well-known license sentences, found with gaps.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("this work is dedicated to the public domain", "public-domain"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def template_grams(
    spark: SparkSession, base: Iterable[tuple[str, str]], more: Iterable[tuple[str, str]], k: int
) -> DataFrame:
    """One row per run of ``k`` words of each template: its place, words and hash."""
    rows = []
    for exact, group in ((True, base), (False, more)):
        for phrase, label in group:
            words = phrase.split()
            if len(words) < k:
                raise ValueError(f"{phrase!r} has fewer than {k} words")
            number = len(rows)
            grams = [words[j : j + k] for j in range(len(words) - k + 1)]
            rows += [(number, label, exact, len(words), len(grams), j, gram) for j, gram in enumerate(grams)]
    schema = "template int, label string, exact boolean, words int, grams int, tpos int, gram array<string>"
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn("hash", F.xxhash64(*[F.col("gram")[i] for i in range(k)]))
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def diagonal_scan(
    docs: DataFrame,
    base: Iterable[tuple[str, str]] = BASE,
    more: Iterable[tuple[str, str]] = TEMPLATES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    gap: int = 3,
    coverage: float = 0.8,
) -> DataFrame:
    """Spans of templates: ``id, text_hash, template, label, exact, start, end, covered``.

    For a ``base`` template a span is one exact place. For the others a span joins diagonals that
    lie at most ``gap`` apart; ``covered`` is the share of the template's runs that it holds, and
    spans that cover less than ``coverage`` or are longer than twice the template are kept with
    label null, as evidence only. ``start`` and ``end`` count words from 0, the end excluded.

    Null and empty texts have no spans. Rows that repeat both id and text give one set of spans.
    A document's hits are grouped by template and diagonal, never by template or word alone, so a
    frequent phrase spreads over the documents.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, base, more, k)
    words = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_hash"),
        words_of(F.col(text_col)).alias("words"),
    )
    places = words.select("_id", "_hash", "words", F.posexplode("words").alias("pos", "first"))
    run = [F.get("words", F.col("pos") + i) for i in range(k)]
    # Equal hashes are confirmed by the words themselves.
    runs = places.select("_id", "_hash", "pos", F.xxhash64(*run).alias("hash"), *[w.alias(f"w{i}") for i, w in enumerate(run)])
    same = [F.col(f"w{i}") == F.col("gram")[i] for i in range(k)]
    hits = runs.join(grams, ["hash"])
    for equal in same:
        hits = hits.where(equal)
    hits = hits.select("_id", "_hash", "template", "label", "exact", "words", "grams", "tpos",
                       (F.col("pos") - F.col("tpos")).alias("diagonal"))
    key = ["_id", "_hash", "template", "label", "exact", "words", "grams"]
    # Written once: both kinds of templates read it, and the texts are not scanned again.
    votes = stored(hits.groupBy(*key, "diagonal").agg(F.collect_set("tpos").alias("runs")), "license-votes")
    places = votes.where("exact and size(runs) = grams").select(
        "_id", "_hash", "template", "label", "exact", F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("words")).alias("end"), F.lit(1.0).alias("covered"),
    )
    by = Window.partitionBy("_id", "_hash", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by), F.lit(gap + 1)) > gap
    spans = (
        votes.where("not exact")
        .withColumn("far", far.cast("int"))
        .withColumn("span", F.sum("far").over(by))
        .groupBy(*key, "span")
        .agg(
            F.min(F.col("diagonal") + F.array_min("runs")).alias("start"),
            F.max(F.col("diagonal") + F.array_max("runs") + k).alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("found"),
        )
        .withColumn("covered", F.col("found") / F.col("grams"))
    )
    sure = (F.col("covered") >= coverage) & (F.col("end") - F.col("start") <= 2 * F.col("words"))
    spans = spans.select("_id", "_hash", "template", F.when(sure, F.col("label")).alias("label"), "exact",
                         "start", "end", "covered")
    return places.unionByName(spans).withColumnsRenamed({"_id": id_col, "_hash": "text_hash"})


def license_scan(
    docs: DataFrame,
    base: Iterable[tuple[str, str]] = BASE,
    more: Iterable[tuple[str, str]] = TEMPLATES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """One row per row of ``docs``: word count, places of the base phrases, and labels.

    ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``. Labels are
    distinct, sorted and joined by commas, the empty string if there are none; ``first_word`` and
    ``last_word`` are null without a base place. ``score`` is the largest covered share of any
    template, 0 without a hit. Null texts count as empty. Repeated rows and null ids give a row
    each; other columns are not read.
    """
    spans = diagonal_scan(docs, base, more, id_col=id_col, text_col=text_col, **options)
    found = spans.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("covered").alias("score"),
    ).withColumnsRenamed({"_id": "f_id", "_hash": "f_hash"})
    counted = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_hash"),
        F.regexp_count(ascii_lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD)).cast("long").alias("n_words"),
    )
    return counted.join(
        found, F.col("_id").eqNullSafe(F.col("f_id")) & (F.col("_hash") == F.col("f_hash")), "left"
    ).select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
