"""Held-out accuracy of the classifier, and its shrinkage next to plain sums."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluiceway.llm.quality import Lexicon, QualityModel, fit, judge, shape, site_rates

MIDDLE = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 3 <> 0"))
    rest = labels.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "l")
    judged = judge(docs, model).join(rest, F.col("doc_id") == F.col("l"))
    rows = judged.selectExpr("_rejected r", "quality = 0 or toxic = 1 bad").collect()
    bad = [r.r for r in rows if r.bad]
    good = [r.r for r in rows if not r.bad]
    assert sum(bad) >= 0.97 * len(bad)
    assert sum(good) <= 0.01 * len(good)


def test_odd_rows(spark):
    rows = [(1, None, None, None, 1.0), (None, "", "a", None, 2.0), (2, "x " * 50_000, "a", "b", 3.0), (2, "x " * 50_000, "a", "b", 3.0),
            (3, "plain words here", None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _evidence double")
    labels = spark.createDataFrame([(2, 0, 0), (3, 1, None), (3, None, 0), (None, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    judged = judge(docs, fit(docs, labels)).collect()
    assert len(judged) == 5 and all(0 <= r._posterior <= 1 and r._rejected is not None for r in judged)
    none = judge(docs, fit(docs, labels.limit(0)))
    assert none.where("_rejected").count() == 0 and none.columns[:4] == docs.columns[:4]
    assert judge(docs.limit(0), QualityModel()).count() == 0


def test_shrinkage(spark):
    rows = [("big", "p", 0.9)] * 400 + [("big", "q", 0.1)] + [("small", "p", 0.9)] + [("other", None, 0.1)] * 400 + [(None, "p", 0.2)] * 3
    scored = spark.createDataFrame(rows, "source string, lang string, e double")
    got = {(r.host, r.path): r for r in site_rates(scored, "e", "source", "lang").collect()}
    overall = sum(r[2] for r in rows) / len(rows)
    plain = defaultdict(list)
    for s, p, e in rows:
        plain[s, p].append(e)
    assert set(got) == set(plain)
    for key, r in got.items():
        assert abs(r.global_rate - overall) < 1e-9
        mean = sum(plain[key]) / len(plain[key])
        assert min(mean, r.host_rate) - 1e-9 <= r.path_rate <= max(mean, r.host_rate) + 1e-9
    # the sparse site stays nearer to the global rate than the dense one with the same mean
    assert abs(got["small", "p"].path_rate - overall) < abs(got["big", "p"].path_rate - overall)


@pytest.mark.parametrize("text", ["", " ", "\ud800", "é" * 10, "!!! ??? |", "A" * 5000])
def test_features_are_finite(text):
    assert all(abs(x) < 100 for x in [*shape(text), *Lexicon(["a", "aaaaa~"])(text)])
