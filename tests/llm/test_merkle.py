"""Merkle manifest next to a plain recursive version."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluiceway.llm.merkle import build_manifest, levels_of, pack_records, prove, segment, stages_of, verified_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, code string, place int, tree string, leaf int, digest string, row int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return h("".join(map(enc, (r[0], r[3], r[2], r[4], text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    sides = []
    for level in tree[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        sides.append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        at //= 3
    return sides


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[s] = levels([leaf_of(r, r[1]) for r in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    root = top[-1][0]
    out = Counter()
    for k, s in enumerate(order):
        for at, r in enumerate(by[s]):
            sides = path(trees[s], at) + path(top, k)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            acc = leaf_of(r, text)
            for a, b in sides:
                acc = h(a + acc + b)
            out[r[0], trees[s][0][at], trees[s][-1][0], root, h("".join(a + b for a, b in sides)), acc, acc == root] += 1
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1, "t", 2, "d", 3) for r in rows], SCHEMA)
    beside = F.sha2(F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), ""), 256).alias("proof")
    got = verified_documents(df).select("doc_id", "leaf", "subroot", "root", beside, "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == expected(rows)
    return got


ODD = [(1, "a\nb", "en", "s", 3), (2, None, None, None, None), (3, "", "en", None, 0), (4, "é\n" * 50_000, "日", "é", 1),
       (None, "x\n", "en", "s", 2), (None, None, None, "", None), (5, "r\n", "en", "s", 2), (5, "r\n", "en", "s", 2),
       (5, "q\n", "en", "s", 2), (-7, "-", "-", "-", -1), (2**60 + 1, "big\n", "en", "s", 4), (2**60 + 2, "big\n", "en", "s", 4)]


def test_odd_rows(spark):
    got = check(spark, ODD)
    assert {r.verified for r in got} == {True, False}
    df = spark.createDataFrame([], SCHEMA)
    assert verified_documents(df).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, n):
    check(spark, [(i, f"t\n{i}", "en", "s", i) for i in range(n)])


def test_many_packs_and_a_hot_source(spark):
    rng = random.Random(3)
    rows = [(i, f"t{i}\n", "en", "hot" if i % 3 else f"s{rng.randrange(1000)}", i) for i in range(4000)]
    rows += [(-1, "again\n", "en", "copies", 5)] * 2300
    check(spark, rows)


def test_requests_for_some_leaves(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    m = build_manifest(docs, tree_col="source", order_col="doc_id", columns=["doc_id"], along={"id": F.col("doc_id")})
    asked = m.leaves.where("along_id % 17 = 0")
    got = prove(m, asked, ["along_id"]).collect()
    assert len(got) == docs.where("doc_id % 17 = 0").count()
    for r in got:
        acc = h(enc(r.along_id))
        assert r.leaf == acc
        for a, b in zip(r.lefts, r.rights):
            acc = h(a + acc + b)
        assert acc == r.root == m.root
    assert m.packs.count() == m.packs.select("digest").distinct().count()


def test_segments_meet_the_whole_path():
    leaves = [h(str(i)) for i in range(700)]
    top, names, children = pack_records(leaves, levels_of(700))
    tree = levels(leaves)
    assert top == tree[-1][0]
    for at in (0, 1, 5, 350, 698, 699):
        reached, lefts, rights = segment(dict(zip(names, children)), top, at, levels_of(700))
        assert reached == leaves[at] and list(zip(lefts, rights)) == path(tree, at)
    assert [stages_of(n) for n in (0, 1, 729, 730, 729**2, 729**2 + 1)] == [1, 1, 1, 2, 2, 3]
