"""Hard negatives by inner product, searched in STR-packed R-trees.

Rows are packed into tiles by sort-tile-recursive cuts learned on a bounded sample; a task packs a
tile's rows into an R-tree the same way, label first. A node's minimum bounding box gives an
interval for the inner product with a query, coordinate by coordinate. A best-first queue takes
the box with the largest possible score next, and leaves out boxes outside of the wanted score
window and boxes strictly below the kth score so far; equal scores are still looked at, as the
smaller id wins. The same bounds decide which tiles a query visits: its most promising one first,
then those that can still improve on what was found there.

All scores are whole numbers and exact, whatever their size.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import blocks, stored
from sluiceway.llm.vectors import bounded_sample
from sluiceway.operators.lookup import hot_keys, lookup

TILE_ROWS = 32_768
QUERY_ROWS = 8_192
MAX_TILES = 1_024  # bounds what each task holds; beyond it tiles are split into parts only
SAMPLE_ROWS = 8_192
LEAF_ROWS = 256
NODE_BOXES = 8
AXES = 4
LEAST, MOST = -(2**63), 2**63 - 1


def exact_matrix(vectors: list | np.ndarray) -> np.ndarray:
    """Whole numbers as float64 where inner products stay exact in it, else as Python integers."""
    m = np.array([np.asarray(v, np.int64) for v in vectors])
    if not m.size:
        return m.astype(np.float64)
    bound = max(abs(int(m.max())), abs(int(m.min())))
    return m.astype(np.float64) if bound * bound * m.shape[1] < 2**53 else m.astype(object)


def together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a form in which their inner products are exact."""
    if a.dtype == b.dtype == np.float64 and a.size and b.size:
        if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
            return a, b
    whole = lambda m: m if m.dtype == object else m.astype(np.int64).astype(object)
    return whole(a), whole(b)


def widest_axes(points: np.ndarray, axes: int = AXES) -> list[int]:
    spread = points.astype(np.float64).std(axis=0)
    return [int(i) for i in np.argsort(-spread, kind="stable")[:axes]]


def tiled(points: np.ndarray, axes: list[int], cap: int) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: row numbers in runs of at most ``cap``, neighbours together."""

    def cut(rows: np.ndarray, axes: list[int]) -> Iterator[np.ndarray]:
        if len(rows) <= cap:
            yield rows
            return
        slabs = math.ceil(blocks(len(rows), cap) ** (1 / max(1, len(axes))))
        each = blocks(blocks(len(rows), slabs), cap) * cap if len(axes) > 1 else cap
        rows = rows[np.argsort(points[rows, axes[0]].astype(np.float64), kind="stable")]
        for at in range(0, len(rows), each):
            yield from cut(rows[at : at + each], axes[1:] or axes)

    yield from cut(np.arange(len(points)), axes)


class Cuts:
    """The same cuts as numbers, learned on a sample: they send any row to one of the tiles."""

    def __init__(self, sample: np.ndarray, tiles: int) -> None:
        self.axes = widest_axes(sample)
        self.tiles = 0
        self.root = self._cut(sample.astype(np.float64), self.axes, tiles)

    def _cut(self, points: np.ndarray, axes: list[int], tiles: int):
        if tiles <= 1 or len(points) < 2:
            self.tiles += 1
            return self.tiles - 1
        slabs = min(tiles, math.ceil(tiles ** (1 / max(1, len(axes)))))
        points = points[np.argsort(points[:, axes[0]], kind="stable")]
        bounds = [points[len(points) * i // slabs, axes[0]] for i in range(1, slabs)]
        parts = np.searchsorted(bounds, points[:, axes[0]], side="right")
        inner = [self._cut(points[parts == i], axes[1:] or self.axes, tiles // slabs + (i < tiles % slabs)) for i in range(slabs)]
        return axes[0], np.array(bounds), inner

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
                return
            axis, bounds, inner = node
            parts = np.searchsorted(bounds, points[rows, axis].astype(np.float64), side="right")
            for i, child in enumerate(inner):
                walk(child, rows[parts == i])

        walk(self.root, np.arange(len(points)))
        return out


def box_bounds(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of ``query`` with any point of each box."""
    pos, neg = np.maximum(query, 0), np.minimum(query, 0)
    return low @ pos + high @ neg, high @ pos + low @ neg


class RTree:
    """Points packed label by label; every level keeps the boxes and label ranges of its nodes."""

    def __init__(self, points: np.ndarray, labels: np.ndarray) -> None:
        axes = widest_axes(points) if len(points) else []
        order = [rows[part] for rows in self._by_label(labels) for part in tiled(points[rows], axes, LEAF_ROWS)]
        self.rows = np.concatenate(order) if order else np.empty(0, np.int64)
        self.points, self.labels = points[self.rows], labels[self.rows]
        ends = np.cumsum([len(o) for o in order]).tolist()
        self.spans = list(zip([0, *ends], ends))
        low = np.array([self.points[a:b].min(axis=0) for a, b in self.spans], self.points.dtype)
        high = np.array([self.points[a:b].max(axis=0) for a, b in self.spans], self.points.dtype)
        first = np.array([self.labels[a] for a, _ in self.spans])
        self.levels = [(low, high, first, first.copy())]
        while len(low) > 1:
            groups = range(0, len(low), NODE_BOXES)
            low, high = (
                np.array([f(m[i : i + NODE_BOXES], 0) for i in groups], m.dtype) for f, m in ((np.min, low), (np.max, high)))
            _, _, least, most = self.levels[-1]
            least = np.array([least[i : i + NODE_BOXES].min() for i in groups])
            most = np.array([most[i : i + NODE_BOXES].max() for i in groups])
            self.levels.append((low, high, least, most))

    @staticmethod
    def _by_label(labels: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(labels, kind="stable")
        edges = np.flatnonzero(np.diff(labels[order])) + 1
        return [part for part in np.split(order, edges) if len(part)]

    def search(self, query: np.ndarray, label: int, same: bool, wanted: list[Best], seen: list[int] | None = None) -> None:
        """Offer to ``wanted`` all rows with the label (``same``) or another one that may matter."""
        if not self.spans:
            return
        tops = self._open(len(self.levels) - 1, range(len(self.levels[-1][0])), query, label, same, wanted)
        queue = list(tops)
        heapq.heapify(queue)
        while queue:
            best, level, node, least = heapq.heappop(queue)
            if not any(w.admits(least, -best) for w in wanted):
                continue
            if level:
                inside = range(node * NODE_BOXES, min((node + 1) * NODE_BOXES, len(self.levels[level - 1][0])))
                for item in self._open(level - 1, inside, query, label, same, wanted):
                    heapq.heappush(queue, item)
                continue
            a, b = self.spans[node]
            if seen is not None:
                seen.append(node)
            if (self.labels[a] == label) != same:
                continue
            scores = self.points[a:b] @ query
            for w in wanted:
                w.offer(scores, self.rows[a:b])

    def _open(self, level: int, nodes: range, query, label, same, wanted: list[Best]):
        low, high, least, most = (m[nodes.start : nodes.stop] for m in self.levels[level])
        fits = (least <= label) & (label <= most) if same else ~((least == label) & (most == label))
        below, above = box_bounds(query, low, high)
        for i in np.flatnonzero(fits):
            if any(w.admits(below[i], above[i]) for w in wanted):
                yield -above[i], level, nodes.start + int(i), below[i]


class Best:
    """The ``k`` first of the rows with scores from ``low`` to ``high``: higher scores, then smaller ids.

    ``ids`` has the ids that a point stands for, ascending; ``floor`` is a score that k rows are
    known to reach elsewhere.
    """

    def __init__(self, k: int, low: int, high: int, ids: list, floor: int | None = None) -> None:
        self.k, self.low, self.high, self.ids = k, low, high, ids
        self.floor = floor
        self.found: list[tuple[int, int, int]] = []  # (-score, id, point)

    def least(self) -> int:
        reached = -self.found[-1][0] if len(self.found) >= self.k else self.low
        return max(self.low, reached, self.low if self.floor is None else self.floor)

    def admits(self, below, above) -> bool:
        return above >= self.least() and below <= self.high

    def offer(self, scores: np.ndarray, rows: np.ndarray) -> None:
        hits = np.flatnonzero((scores >= self.least()) & (scores <= self.high))
        if len(hits) > 4 * self.k:  # of the rest none is among the first k, whatever the ties
            hits = hits[scores[hits] >= np.sort(scores[hits])[-self.k]]
        for i in hits[np.argsort(-scores[hits], kind="stable")]:
            score, row = int(scores[i]), int(rows[i])
            if score < self.least():
                break
            for each in self.ids[row][: self.k]:
                item = (-score, int(each), row)
                if len(self.found) < self.k or item < self.found[-1]:
                    insort(self.found, item)
                    del self.found[self.k :]


def usable(vector: Column, label: Column, row_id: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & label.isNotNull() & row_id.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def tile_boxes(tiled_rows: DataFrame) -> dict[int, pd.DataFrame]:
    """Vector length -> ``tile, low, high``: the minimum bounding box of every tile that has rows."""
    schema = "dim int, tile long, low array<long>, high array<long>"

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for (dim, tile), part in frame.groupby(["dim", "tile"]):
                m = np.stack(part["v"].to_numpy())
                out.append((dim, tile, m.min(axis=0), m.max(axis=0)))
            yield pd.DataFrame(out, columns=["dim", "tile", "low", "high"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = np.stack(frame["low"].to_numpy()).min(axis=0), np.stack(frame["high"].to_numpy()).max(axis=0)
        return pd.DataFrame([(frame["dim"].iloc[0], frame["tile"].iloc[0], low, high)], columns=["dim", "tile", "low", "high"])

    parts = tiled_rows.select("dim", "tile", "v").mapInPandas(partial, schema)
    boxes = parts.groupBy("dim", "tile").applyInPandas(merge, schema).toPandas()  # at most MAX_TILES per length
    return {int(dim): part.sort_values("tile").reset_index(drop=True) for dim, part in boxes.groupby("dim")}


ASK = "node long, label long, dim int, v array<long>, marks array<long>, lows array<long>, highs array<long>, floors array<long>"


def visits(asks: DataFrame, boxes: dict[int, pd.DataFrame], first: bool) -> DataFrame:
    """A copy of every query for its most promising tile (``first``) or for the others it still needs."""

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                known = boxes[int(dim)]
                tiles = known["tile"].to_numpy()
                low, high = exact_matrix(known["low"]), exact_matrix(known["high"])
                rows, where = [], []
                for row, (v, lows, highs, floors) in enumerate(zip(part["v"], part["lows"], part["highs"], part["floors"])):
                    query, both = together(exact_matrix([v]), np.concatenate([low, high]))
                    below, above = box_bounds(query[0], both[: len(tiles)], both[len(tiles) :])
                    best = int(np.argmax(above))
                    if first:
                        goes = [best]
                    else:
                        needs = np.zeros(len(tiles), bool)
                        for a, b, f in zip(lows, highs, floors):
                            needs |= np.array((above >= max(int(a), int(f))) & (below <= int(b)), bool)
                        needs[best] = False
                        goes = np.flatnonzero(needs)
                    rows += [row] * len(goes)
                    where += tiles[goes].tolist()
                yield part.iloc[rows].assign(tile=where)

    return asks.mapInPandas(choose, f"{ASK}, tile long")


def tile_search(tiled_rows: DataFrame, asks: DataFrame, k: int, same: bool, tile_rows: int) -> DataFrame:
    """``q, mark, score, id, point``: for every query and window at most ``k`` rows of each tile part."""
    where = ["dim", "tile"]
    ask_parts = asks.groupBy(*where).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("ask_parts"))
    row_parts = tiled_rows.groupBy(*where).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("row_parts"))
    sizes = ask_parts.join(row_parts, where)
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*where, "i", "j", "node", "label", "v"]
    points = tiled_rows.join(sizes, where).withColumn("i", part("row_parts")).withColumn("j", each("ask_parts"))
    queries = asks.join(sizes, where).withColumn("j", part("ask_parts")).withColumn("i", each("row_parts"))
    both = points.select(*columns, "ids").unionByName(
        queries.select(*columns, "marks", "lows", "highs", "floors"), allowMissingColumns=True)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        is_point = frame["ids"].notna().to_numpy()
        held, asking = frame[is_point], frame[~is_point]
        points, wanted = together(exact_matrix(held["v"]), exact_matrix(asking["v"]))
        tree = RTree(points, held["label"].to_numpy())
        ids, nodes = held["ids"].to_list(), held["node"].to_numpy()
        out = []
        for query, (q, label, marks, lows, highs, floors) in zip(
            wanted, zip(*(asking[c] for c in ("node", "label", "marks", "lows", "highs", "floors")))
        ):
            best = [Best(k, int(a), int(b), ids, int(f)) for a, b, f in zip(lows, highs, floors)]
            tree.search(query, label, same, [w for w in best if w.low <= w.high])
            for mark, w in zip(marks, best):
                out += [(q, mark, max(LEAST, min(MOST, -score)), each, nodes[row]) for score, each, row in w.found]
        return pd.DataFrame(out, columns=["q", "mark", "score", "id", "point"])

    return both.groupBy(*where, "i", "j").applyInPandas(search, "q long, mark long, score long, id long, point long")


def first_rows(
    tiled_rows: DataFrame, boxes: dict[int, pd.DataFrame], asks: DataFrame, k: int, same: bool, tile_rows: int
) -> DataFrame:
    """``q, mark, nth, score, id, point``: the ``k`` first rows of every query and window, of all tiles."""
    window = Window.partitionBy("q", "mark").orderBy(F.col("score").desc(), "id", "point")
    ranked = lambda df: df.withColumn("nth", F.row_number().over(window)).where(F.col("nth") <= k)
    near = stored(ranked(tile_search(tiled_rows, visits(asks, boxes, True), k, same, tile_rows)), "negatives-near")
    if all(len(b) == 1 for b in boxes.values()):
        return near
    reached = near.where(F.col("nth") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("mark", "score"))).alias("kth"))
    floors = F.transform("marks", lambda m: F.coalesce(F.element_at("kth", m), F.lit(LEAST).cast("long")))
    again = asks.join(reached.withColumnRenamed("q", "node"), "node", "left").withColumn("floors", floors).drop("kth")
    rest = tile_search(tiled_rows, visits(again.select(asks.columns), boxes, False), k, same, tile_rows)
    return stored(ranked(near.drop("nth").unionByName(rest)), "negatives-found")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Every component x becomes ``floor(scale * x)``, computed in double precision; a score is the
    inner product of two rows of equal length. Higher scores come first, ties go to the smaller id.
    For each row that ``anchors`` (a condition on columns of ``vectors``) picks and each of its
    ``positives`` first other rows of the same label, the ``negatives`` first rows of another label
    are returned whose score is from ``low_percent`` to ``high_percent`` of the positive's.

    Rows without id, label or vector, with an empty vector or with a null or non-finite component
    take no part. Labels are whole numbers. Repeated rows are rows of their own: a row that repeats
    an anchor can be its positive, and each repeated anchor has its own results. Scores beyond a
    long are given as the nearest long, components too. Other columns are not read. An empty table
    gives an empty result.

    Rows with equal label and vector are one point of the tree, which keeps as many of the smallest
    ids as can be wanted; equal anchors are one query.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.where(usable(F.col(vector_col), label, F.col(id_col))).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    rows = stored(rows.withColumn("key", F.sha2(F.to_json(F.struct("label", "v")), 256)), "negatives-rows")
    kept = max(positives + 1, negatives)
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    fewer = rows.withColumn("nth", nth).where(F.col("nth") <= kept)
    points = fewer.groupBy("key").agg(
        F.sort_array(F.collect_list("id")).alias("ids"), F.first("label").alias("label"), F.first("v").alias("v"))
    points = stored(points.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "negatives-points")
    cuts = {}
    for dim, n in points.groupBy("dim").count().collect():  # one entry per vector length
        sample = bounded_sample(points.where(F.col("dim") == dim), "key", SAMPLE_ROWS, ["v"])
        cuts[dim] = Cuts(np.stack(sample["v"].to_numpy()), min(MAX_TILES, blocks(n, tile_rows)))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                yield part.assign(tile=cuts[int(dim)].of(np.stack(part["v"].to_numpy())))

    tiles = points.select("node", "label", "v", "ids", "dim").mapInPandas(
        deal, "node long, label long, v array<long>, ids array<long>, dim int, tile long")
    tiles = stored(tiles, "negatives-tiles")
    boxes = tile_boxes(tiles)
    counts = rows.where("asks").groupBy("key").agg(F.count("*").alias("n"))
    asking = points.join(counts, "key").select("node", "label", "dim", "v")
    one = lambda value: F.array(F.lit(value).cast("long"))
    asks = asking.select("*", one(0).alias("marks"), one(LEAST).alias("lows"), one(MOST).alias("highs"), one(LEAST).alias("floors"))
    alike = first_rows(tiles, boxes, asks, positives + 1, True, tile_rows)
    found = stored(alike.groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("nth", "score", "id", "point"))).alias("alike")), "negatives-alike")
    # 100 * low = low_percent * score, in decimals so that no product overflows
    wide = lambda m, percent: m.cast("decimal(20,0)") * F.lit(percent).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    marks = F.array_distinct(F.filter(F.col("alike.score"), lambda m: m >= 0))
    asks = asking.join(found.withColumnRenamed("q", "node"), "node").withColumn("marks", marks).where("size(marks) > 0").select(
        *asking.columns, "marks",
        F.transform("marks", lambda m: F.ceil(wide(m, low_percent)).cast("long")).alias("lows"),
        F.transform("marks", lambda m: F.floor(wide(m, high_percent)).cast("long")).alias("highs"),
        F.transform("marks", lambda m: F.lit(LEAST).cast("long")).alias("floors"),
    )
    unlike = first_rows(tiles, boxes, stored(asks, "negatives-asks"), negatives, False, tile_rows)
    each = unlike.groupBy("q", "mark").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("list"))
    each = each.groupBy("q").agg(F.collect_list(F.struct("mark", "list")).alias("unlike"))
    named = points.select("node", "key").join(found.withColumnRenamed("q", "node"), "node").join(
        each.withColumnRenamed("q", "node"), "node")
    asked = rows.where("asks").select("id", "key")
    met = lookup(asked, stored(named, "negatives-classes"), ["key"], hot_keys(counts, ["key"], "n"))
    own = F.array_position(F.transform("alike", lambda p: (p["point"] == F.col("node")) & (p["id"] == F.col("id"))), F.lit(True))
    others = F.slice(F.filter("alike", lambda p, i: (i + 1) != F.col("own")), 1, positives)
    pairs = met.withColumn("own", own).select("id", "unlike", F.explode(others).alias("p"))
    lists = F.flatten(F.transform(F.filter("unlike", lambda u: u["mark"] == F.col("p")["score"]), lambda u: u["list"]))
    return pairs.select("id", "p", F.explode(lists).alias("n")).select(
        F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("n.nth").cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
