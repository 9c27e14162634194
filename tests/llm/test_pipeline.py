"""The stages of the pipeline, each on its own input, next to plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import queries
from sluiceway.llm.simhash import set_nodes, small_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        rows = docs.collect()
        out.append(rows)
        if len(out) <= len(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(rows, SCHEMA)
    return out


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def components_of(texts):
    """Least id that each id reaches by links between sets of shingles that are 0.8 alike."""
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    ids = sorted(texts)
    links = [(a, b) for a in ids for b in ids if a < b and similar(sets[a], sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_near_duplicates_go(steps):
    before, after = {r.doc_id: r.text for r in steps[1]}, {r.doc_id for r in steps[2]}
    least = components_of(before)
    assert after == set(least.values()) and len(after) < len(before)


def test_short_texts_are_no_candidates(spark, small):
    """Six words are two shingles, whose fingerprints are alike by chance."""
    rng = random.Random(5)
    texts = {i: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for i in range(1500)}
    base = [f"b{i}" for i in range(9)]
    texts |= {2000: " ".join(base[:8]), 2001: " ".join(base), 2002: " ".join([*base, "b9"]), 2003: " ".join(base[1:]),
              2004: " ".join(base[:7]), 2005: " ".join(base[:6] + ["x", "y"])}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert {r.doc_id for r in got.collect()} == set(components_of(texts).values())
    prints = set_nodes(docs, id_col="doc_id", text_col="text", words=5, seeds=corpus_pipeline.SEEDS, small=small_sets(0.8))
    assert prints.where(f"size > {small_sets(0.8)}").count() < 10


def test_repeats_are_cut(steps):
    before, after = {r.doc_id: r.text for r in steps[2]}, {r.doc_id: r for r in steps[3]}
    assert set(before) == set(after)
    seen = {}
    for i in sorted(before):
        raw = (before[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 49):
            if seen.setdefault(raw[s : s + 50], i) < i:
                gone[s : s + 50] = True
        left = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
        assert (after[i].text or "") == left and after[i].n_chars == len(left)


def test_packing(steps):
    by = defaultdict(list)
    for r in steps[4]:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert {r.doc_id for r in steps[4]} == {r.doc_id for r in steps[3]}


def test_rejects(spark):
    middle = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, middle).select("doc_id").collect()}
    labels = spark.read.parquet(f"{middle}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id for r in labels if r.quality == 0 or r.toxic == 1]
    assert sum(d in kept for d in good) >= 0.99 * len(good)
    assert sum(d in kept for d in bad) <= 0.15 * len(bad)


CLASHING = ["component_id", "fingerprint", "_k", "_h", "_key", "_at", "_raw", "_kept", "_evidence", "_site_host", "_posterior",
            "_rejected", "_host_rate", "_path_rate", "_n_bytes", "_n_removed", "_n_spans", "_s_copy", "_s_gone", "k", "h", "copy",
            "gone", "row", "node", "root", "_id", "_text"]


def test_odd_rows_pass_every_stage(spark, small):
    rows = [(1, None, None, None, None), (None, "", "a", "b", 0), (2, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11),
            (3, "x" * 100_000, "en", None, 5)]
    values = [77 + i for i in range(len(CLASHING))]
    docs = spark.createDataFrame([(*r, *values) for r in rows], SCHEMA + "".join(f", {c} int" for c in CLASHING))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == docs.columns
        rows_out = got.collect()
        assert len(rows_out) >= 3 or stage is corpus_pipeline.keep_good
        assert all(list(r[5:]) == values for r in rows_out)
        assert stage(spark, docs.limit(0), small).count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs, small).count() >= 5
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), small).count() == 0
    two = corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()
    assert Counter(r.doc_id for r in two) == Counter([1, 2, 3])


def test_registered(spark, small):
    assert "pipeline" in queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries() if q.startswith("op") and q[2].isdigit()}
