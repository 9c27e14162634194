"""Tree merge of digest runs next to a dictionary of texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluiceway.llm.exact_dedup import exact_duplicates, merged_runs

SCHEMA = "doc_id long, text string, run int, digest string, best int, kept boolean, row long, sha string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "d", 1, False, 2, "s", 3) for i, t in rows], SCHEMA)


def expected(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = Counter()
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            out[i, keep, len(ids), sha] += 1
    return out, {hashlib.sha256(t.encode()).hexdigest() for t in by}


def check(got, rows):
    want, texts = expected(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(texts)
    assert all(r.doc_id == r.keep_id for r in kept)


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (5, "A"), (None, "a"), (None, "n"), (None, "n"), (8, "x" * 2_000_000),
       (9, "x" * 2_000_000), (10, "x" * 1_999_999 + "y"), (-4, "é"), (-5, "é"), (6, "a "), (7, "a\x00")]


@pytest.mark.parametrize("runs", [1, 2, 5, 16, None])
def test_odd_rows(spark, runs):
    df = frame(spark, ODD)
    check(exact_duplicates(df, runs=runs).collect(), ODD)
    assert exact_duplicates(df.limit(0), runs=runs).count() == 0


def test_many_copies_over_many_runs(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 700}") for i in range(20_000)]
    df = frame(spark, rows).repartition(40, "doc_id")
    check(exact_duplicates(df, runs=64).collect(), rows)


def test_equal_digests_are_verified(spark):
    rows = [(i, f"{i % 50:03d}") for i in range(500)] + ODD[:8]
    check(exact_duplicates(frame(spark, rows), runs=8, digest=lambda t: F.lit(3)).collect(), rows)


def test_smallest(spark):
    got = exact_duplicates(frame(spark, [(3, "a"), (1, "a"), (None, "a"), (2, "b")]), keep="smallest").collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(3, 1), (1, 1), (None, 1), (2, 2)}
    assert Counter(r.keep_id for r in got if r.kept) == Counter([1, 2])


def test_every_digest_ends_in_the_run_of_its_bits(spark):
    entries = spark.range(4000).selectExpr(
        "cast(id % 32 as int) AS run", "xxhash64(id div 64) AS digest", "1 AS size", "binary('s') AS sha",
        "struct(id AS rank, id AS row, id AS id) AS best", "1L AS n")
    got = merged_runs(entries, 32).select("run", "digest", "n", "best.rank").collect()
    assert len(got) == len({r.digest for r in got}) == 63
    assert all(r.run == r.digest % 32 for r in got) and sum(r.n for r in got) == 4000


def test_no_python_in_the_plan(spark, small):
    df = exact_duplicates(spark.read.parquet(f"{small}/documents.parquet"))
    assert "Python" not in df._jdf.queryExecution().toString()
