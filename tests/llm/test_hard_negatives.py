"""Hard negatives next to brute force over all pairs of rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm.hard_negatives import LEAST, MOST, Best, Cuts, RTree, exact_matrix, hard_negatives, tiled, together

SCHEMA = "vec_id long, embedding array<double>, label int, node long, v string, ids int, tile int, score long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in rows], SCHEMA)


def whole(v):
    return [math.floor(256 * x) for x in v]


def brute(rows, every, k=5, m=3):
    good = [(i, whole(v), label) for i, v, label in rows
            if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (a, q, label) in enumerate(good):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, other == label)
                  for j, (i, v, other) in enumerate(good) if j != at and len(v) == len(q)]
        scored.sort()
        for p, pid, _ in [s for s in scored if s[2]][:k]:
            fits = [(s, i) for s, i, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p][:m]
            for rank, (s, i) in enumerate(fits, 1):
                out[a, pid, rank, i, -p, -s] += 1
    return out


def clustered(seed, n, dim=8, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, dim))
    return [(i, [float(x) for x in v[i]], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("tile_rows", [32_768, 60])
def test_all_pairs(spark, tile_rows):
    rows = clustered(1, 600)
    hot = rows[10][1]
    rows += [(1000 + i, hot, 1) for i in range(150)] + [(2000 + i, hot, 2) for i in range(20)]
    got = hard_negatives(frame(spark, rows).repartition(7), F.col("vec_id") % 10 == 0, tile_rows=tile_rows).collect()
    assert Counter(map(tuple, got)) == brute(rows, 10)


def test_odd_rows(spark):
    v = [0.5, 0.25, -1.0]
    rows = [(0, v, 0), (0, v, 0), (2, v, 0), (4, [0.4, 0.25, -1.0], 0), (6, [0.3, 0.2, -0.7], 1), (6, [0.3, 0.2, -0.7], 1),
            (8, v, None), (10, None, 0), (12, [0.0, 0.0, 0.0], 0), (14, [0.5, None, 1.0], 1), (16, [math.nan, 1.0, 1.0], 1),
            (18, [math.inf, 1.0, 1.0], 1), (20, [], 0), (22, [0.5, 0.25], 0), (24, [0.5, 0.3], 0), (26, [0.3, 0.2], 1),
            (None, v, 0), (-2, [-0.001, 0.1, -0.4], 3), (28, [1e11, 2e11, -3e10], 5), (30, [1.1e11, 2e11, 0.0], 5),
            (32, [0.7e11, 1.5e11, 0.0], 6)]
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 2 == 0).collect()
    clip = lambda s: max(LEAST, min(MOST, s))
    want = Counter()
    for (*ids, p, s), n in brute(rows, 2).items():
        want[(*ids, clip(p), clip(s))] += n
    small = lambda c: Counter({k: n for k, n in c.items() if abs(k[4]) < MOST})
    got = Counter(map(tuple, got))
    assert small(got) == small(want) and want
    df = frame(spark, rows)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0


def test_tree_finds_all_and_leaves_boxes_out():
    rng = np.random.default_rng(4)
    centres = rng.integers(-20_000, 20_000, (40, 4))
    points = (centres[rng.integers(0, 40, 20_000)] + rng.integers(-300, 300, (20_000, 4))).astype(np.float64)
    labels = rng.integers(0, 3, 20_000)
    tree, ids = RTree(points, labels), [[i] for i in range(len(points))]
    opened = 0
    for q in range(0, 200, 10):
        scores = points @ points[q]
        for same, low, high in ((True, LEAST, MOST), (False, int(0.5 * scores[q]), int(0.95 * scores[q]))):
            seen: list[int] = []
            best = Best(6, low, high, ids)
            tree.search(points[q], labels[q], same, [best], seen)
            fits = np.flatnonzero(((labels == labels[q]) == same) & (scores >= low) & (scores <= high))
            want = sorted((-int(scores[i]), int(i), int(i)) for i in fits)[:6]
            assert best.found == want
            opened += len(seen) / len(tree.spans)
    assert opened / 40 < 0.2


def test_tiles_hold_every_row_once():
    points = np.random.default_rng(2).integers(-5, 5, (1000, 6)).astype(np.float64)
    parts = list(tiled(points, [0, 3, 2], 64))
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and max(map(len, parts)) <= 64
    assert len(parts) <= 2 * 1000 / 64
    cuts = Cuts(points[:300], 12)
    assert cuts.tiles <= 12 and set(cuts.of(points).tolist()) <= set(range(cuts.tiles))


def test_large_numbers_stay_exact():
    a, b = exact_matrix([[2**40, 1]]), exact_matrix([[2**40, 3]])
    a, b = together(a, b)
    assert int((a @ b.T)[0, 0]) == 2**80 + 3
    tree = RTree(a, np.array([0]))
    best = Best(1, 2**79, 2**81, [[7]])
    tree.search(b[0], 1, False, [best])
    assert best.found == [(-(2**80 + 3), 7, 0)]
