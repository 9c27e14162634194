"""Exact range join of vectors in a metric space.

Pivots from a bounded sample cut the space into cells; each vector is at home in the cell of its
nearest pivot. A vector can be within the range of another cell's member only if the triangle
inequality and the bisecting plane allow it, and exactly those cells get a copy. Cells are joined
independently, in parts of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import blocks, stored
from sluiceway.llm.components import components
from sluiceway.llm.simhash import Forest
from sluiceway.llm.vectors import bounded_sample, classes_of, cosine, matrix, unit, with_key

CELL_ROWS = 4000
MAX_PIVOTS = 1024  # bounds what each task holds; beyond it cells are split into parts only
SLACK = 1e-9


def pick_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Greedy far-apart points of the sample."""
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        if nearest.max() < SLACK:
            break
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def visited_cells(points: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each point's home cell, and for each point and cell whether a home member may be in reach.

    A member m of cell j is no nearer to the point's own pivot i than to j. With distance of at
    most ``reach`` to the point, the point lies at most ``reach`` beyond the plane between i and j,
    and d(point, j) - d(point, i) is at most twice ``reach``.
    """
    square = np.maximum(0, (points**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * points @ pivots.T)
    home = square.argmin(1)
    least = square[np.arange(len(points)), home]
    gap = np.maximum(0, (pivots**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * pivots @ pivots.T)
    beyond = (square - least[:, None]) / (2 * np.sqrt(np.maximum(gap[home], 1e-30)))
    seen = (beyond <= reach + SLACK) & (np.sqrt(square) - np.sqrt(least)[:, None] <= 2 * reach + SLACK)
    seen[np.arange(len(points)), home] = True
    return home, seen


def near_duplicate_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``id, n_links, component_id, kept``, one row per row of ``vectors``.

    Rows are linked if their labels are equal and not null, their vectors have equal lengths and
    their cosine in double precision is at least ``threshold``. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the least id reachable, itself included, and ``kept``
    says whether a row's id is that id. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, and neither do rows without a label. Repeated rows
    count as rows of their own and link with each other; a null id is never the least of a
    component that has others. Other columns are not read.

    Equal vectors of a label are one node with a count, so copies are never paired. ``n_links`` is
    summed in the cells and not from emitted pairs; what leaves a cell is one link per node.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v")
    )
    rows = with_key(rows, "_v", "_label").withColumn("key", F.when(F.col("_label").isNotNull(), F.col("key")))
    nodes = classes_of(rows, "_id", "_v", "_label", purpose="vector-nodes")
    rows = stored(rows.select("_id", "key"), "vector-rows")
    nodes_dim = nodes.withColumn("dim", F.size("_v"))
    largest = nodes_dim.groupBy("dim", "_label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    pivots = {}
    for dim, n in largest:  # one entry per vector length
        wanted = min(MAX_PIVOTS, blocks(n, cell_rows))
        sample = bounded_sample(nodes_dim.where(F.col("dim") == dim), "key", 8 * wanted, ["_v"])
        pivots[dim] = pick_pivots(unit(matrix(sample["_v"])), wanted)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                home, seen = visited_cells(unit(matrix(part["_v"])), pivots[dim], reach)
                row, cell = np.nonzero(seen)
                part = part.iloc[row]
                yield part[["node", "n", "_label", "dim", "_v"]].assign(cell=cell, home=home[row] == cell)

    kind = nodes.schema["_v"].dataType.simpleString()
    label = nodes.schema["_label"].dataType.simpleString()
    dealt = nodes_dim.select("node", "n", "_label", "dim", "_v").mapInPandas(
        deal, f"node long, n long, _label {label}, dim int, _v {kind}, cell long, home boolean"
    )
    dealt = stored(dealt, "vector-cells")
    where = ["_label", "dim", "cell"]
    sizes = dealt.groupBy(*where).agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / cell_rows).cast("int").alias("home_parts"),
        F.ceil(F.count("*") / (4 * cell_rows)).cast("int").alias("other_parts"),
    )
    placed = dealt.join(sizes.where("home_parts > 0"), where)
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = placed.where("home").withColumn("i", part("home_parts")).withColumn("j", each("other_parts"))
    others = placed.withColumn("j", part("other_parts")).withColumn("i", each("home_parts"))
    columns = [*where, "i", "j", "node", "n", "_v"]
    both = homes.select(*columns, F.lit(True).alias("asks")).union(others.select(*columns, F.lit(False).alias("asks")))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        node, count = frame["node"].to_numpy(), frame["n"].to_numpy()
        raw = matrix(frame["_v"])
        points = unit(raw)
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        links = np.zeros(len(frame), np.int64)
        forest = Forest(len(frame))
        for i in range(0, len(q), 512):
            for j in range(0, len(m), 4096):
                score = points[q[i : i + 512]] @ points[m[j : j + 4096]].T
                a, b = np.nonzero(score >= threshold - SLACK)
                if not len(a):
                    continue
                close = score[a, b] < threshold + SLACK
                a, b = q[i + a], m[j + b]
                if close.any():
                    ok = ~close
                    ok[close] = (cosine(raw[a[close]], raw[b[close]]) >= threshold) | (node[a[close]] == node[b[close]])
                    a, b = a[ok], b[ok]
                np.add.at(links, a, count[b])
                forest.link(a, b)
        up = node[forest.parent]
        out = pd.DataFrame({"node": node, "links": links, "up": up})
        return out[(links > 0) | (up != node)]

    found = stored(
        both.groupBy(*where, "i", "j").applyInPandas(join, "node long, links long, up long"), "vector-links"
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("up").alias("b")), "vector-links")
    named = nodes.select("node", "key", "least").join(roots, "node", "left").join(links, "node", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "node")), "vector-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    by_key = named.join(least, "root").select("key", "links", "component")
    component = F.coalesce("component", "_id")
    return rows.join(by_key, "key", "left").select(
        F.col("_id").alias(id_col),
        # a node also meets itself, once per row
        F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("_id").eqNullSafe(component)).alias("kept"),
    )
