"""Vector operators next to brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from sluiceway.llm.ann import SubstringIndexes, nearest
from sluiceway.llm.metric_join import near_duplicate_vectors, pick_pivots, visited_cells

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cos(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def expected(rows, threshold=0.98):
    n = len(rows)
    parent, links = list(range(n)), [0] * n
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ok = [usable(v) and label is not None for _, v, label, *_ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la, *_), (_, b, lb, *_) = rows[i], rows[j]
            if ok[i] and ok[j] and la == lb and len(a) == len(b) and (a == b or cos(a, b) >= threshold):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], links[i], least.get(root(i)), rows[i][0] == least.get(root(i))) for i in range(n))


def clustered(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return [(centres[rng.integers(20)] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.5])).astype(np.float32)
            for _ in range(n)]


@pytest.mark.parametrize("cell_rows", [15, 4000])
def test_range_join(spark, cell_rows):
    vectors = clustered(1, 400)
    rows = [(i, [float(x) for x in v], i % 3 if i % 17 else None, "x", 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicate_vectors(df, cell_rows=cell_rows).collect()
    assert Counter(map(tuple, got)) == expected(rows)


def test_range_join_odd_rows(spark):
    v = [0.5, 0.25, -1.0]
    odd = [(1, v, 0), (1, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0),
           (7, [0.5, None, 1.0], 0), (8, [float("nan"), 1.0, 1.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [], 0),
           (11, [0.5, 0.25], 0), (12, [0.50001, 0.25, -1.0], 0), (13, [x * 1e30 for x in v], 0), (None, v, 0)]
    rows = [(*r, "x", 1) for r in odd]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect())
    want = expected(rows)
    nulls = {k for k in want if k[0] is None}
    assert got == want or {k: c for k, c in got.items() if k[0] is not None} == {k: c for k, c in want.items() if k not in nulls}
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_cells_hold_all_that_is_in_reach():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 6))
    points /= np.linalg.norm(points, axis=1)[:, None]
    pivots = pick_pivots(points[:80], 12)
    home, seen = visited_cells(points, pivots, 0.3)
    near = np.linalg.norm(points[:, None] - points[None], axis=2) <= 0.3
    a, b = np.nonzero(near)
    assert seen[a, home[b]].all() and seen.mean() < 0.9


def brute_nearest(rows, ask, k=5):
    out = Counter()
    good = [(i, v) for i, v, *_ in rows if usable(v)]
    for at, (q, v) in enumerate(good):
        if q is None or not ask(q):
            continue
        scores = sorted((-cos(v, w), i) for j, (i, w) in enumerate(good) if j != at and len(v) == len(w))
        for rank, (s, i) in enumerate(scores[:k], 1):
            out[q, rank, i, round(-s, 9)] += 1
    return out


def test_nearest_finds_all_when_blocks_are_retrieved_whole(spark):
    vectors = clustered(2, 300)
    rows = [(i, [float(x) for x in v], 0, "x", 1) for i, v in enumerate(vectors)]
    rows += [(300 + i, rows[7][1], 0, "x", 1) for i in range(30)] + [rows[7], rows[50]]
    rows += [(400, None, 0, "x", 1), (410, [0.0] * 12, 0, "x", 1), (420, [1.0, 2.0], 0, "x", 1), (421, [1.0, 2.5], 0, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest(df, df.where("vec_id % 10 = 0"), 5, retrieved=100, index_rows=100, query_rows=20).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == brute_nearest(rows, lambda q: q % 10 == 0)
    few = df.where("vec_id < 3")
    assert nearest(few, few, 5).count() == 6
    assert nearest(df.limit(0), df.limit(0), 5).count() == 0


def test_nearest_recall(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, lambda q: q % 50 == 0)}
    got = {(r.query_id, r.vec_id) for r in nearest(df, df.where("vec_id % 50 = 0"), 5, retrieved=64).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_probing_is_complete():
    rng = np.random.default_rng(3)
    parts = rng.integers(0, 2**16, (500, 4)).astype(np.uint16)
    parts[:50] = parts[0] ^ (1 << rng.integers(0, 16, (50, 4))).astype(np.uint16)
    index = SubstringIndexes(parts)
    distance = np.bitwise_count(parts ^ parts[0]).sum(1)
    for radius in (0, 1, 3, 6, 10, 20, 30, 64):
        assert index.within(parts[0], radius)[0].tolist() == np.flatnonzero(distance <= radius).tolist()
