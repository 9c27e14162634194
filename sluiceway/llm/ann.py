"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned on a bounded sample (iterative quantization) turns unit vectors into binary
codes. Codes are split into 16-bit substrings, each with an index of its own. By the pigeonhole
principle a code within radius r of the query agrees with it in some substring up to the radius
of that substring, so probing the substring indexes retrieves every code within r; the retrieved
vectors are then ranked by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import blocks, stored
from sluiceway.llm.vectors import bounded_sample, classes_of, cosine, matrix, unit, with_key

BITS = 256
PART = 16
SAMPLE_ROWS = 4096
INDEX_ROWS = 8192
QUERY_ROWS = 1024
RETRIEVED = 256


class Codes:
    """Rotations learned by iterative quantization; each gives as many bits as vectors are long."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 20) -> None:
        rng = np.random.default_rng(7)
        dim = sample.shape[1]
        _, axes = np.linalg.eigh(sample.T @ sample)
        turned = sample @ axes
        learned = []
        for _ in range(-(-bits // dim)):
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(rounds):
                signs = np.where(turned @ r >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(turned.T @ signs)
                r = left @ right
            learned.append(axes @ r)
        rotation = np.concatenate(learned, axis=1)
        self.rotation = rotation[:, : max(PART, rotation.shape[1] // PART * PART)]
        self.bits = -(-self.rotation.shape[1] // PART) * PART

    def parts(self, points: np.ndarray) -> np.ndarray:
        """The 16-bit substrings of each point's code."""
        ones = points @ self.rotation >= 0
        ones = np.pad(ones, ((0, 0), (0, self.bits - ones.shape[1])))
        return np.packbits(ones, axis=1).view(np.uint16)


def masks(radius: int) -> np.ndarray:
    """All 16-bit words with at most ``radius`` bits."""
    found = [sum(1 << k for k in c) for n in range(radius + 1) for c in combinations(range(PART), n)]
    return np.array(found, np.uint16)


MASKS = [masks(r) for r in range(4)]
BALL = np.cumsum([1, 16, 120, 560, 1820, 4368, 8008, 11440, 12870, 11440, 8008, 4368, 1820, 560, 120, 16, 1])


class SubstringIndexes:
    """One sorted index per substring over the codes of a block."""

    def __init__(self, parts: np.ndarray) -> None:
        self.parts = parts
        self.tables = []
        for k in range(parts.shape[1]):
            order = np.argsort(parts[:, k], kind="stable")
            values, starts = np.unique(parts[order, k], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose code is within ``radius`` of the query's, and their distances: all of them."""
        n = len(self.tables)
        each, rest = divmod(radius, n)
        seen = np.zeros(len(self.parts), bool)
        for k, (values, starts, order) in enumerate(self.tables):
            reach = min(PART, each if k <= rest else each - 1)
            if reach < 0:
                continue
            if reach < len(MASKS) and BALL[reach] < len(values):
                probes = query[k] ^ MASKS[reach]
                at = np.searchsorted(values, probes)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probes)]
            else:  # fewer values are filled than there are probes
                at = np.flatnonzero(np.bitwise_count(values ^ query[k]) <= reach)
            if len(at) == len(values):
                seen[:] = True
                break
            size = starts[at + 1] - starts[at]
            run = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            seen[order[run]] = True
        rows = np.flatnonzero(seen)
        distance = np.bitwise_count(self.parts[rows] ^ query).sum(1, dtype=np.int32)
        return rows[distance <= radius], distance[distance <= radius]

    def retrieve(self, query: np.ndarray, radius: int, least: int) -> np.ndarray:
        """All rows within a radius that is widened until it holds ``least`` rows or everything."""
        bits = PART * len(self.tables)
        while True:
            rows, _ = self.within(query, radius)
            if len(rows) >= min(least, len(self.parts)) or radius >= bits:
                return rows
            radius = min(bits, radius + max(1, bits // 32))


def first_radius(codes: Codes, sample: np.ndarray, share: float) -> int:
    """The distance within which a typical sample point finds this share of the others."""
    parts = codes.parts(sample[:1024])
    some = parts[:64]
    distance = np.bitwise_count(some[:, None] ^ parts[None]).sum(2, dtype=np.int32)
    return int(np.median(np.quantile(distance, min(1.0, share), axis=1)))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    retrieved: int = RETRIEVED,
    index_rows: int = INDEX_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, id, score``: for each row of ``queries`` its ``k`` nearest in ``vectors``.

    ``queries`` are rows of ``vectors``; a query's own row is no candidate. Nearness is the cosine
    of the vectors as given, in double precision; the nearest come first, ties to the smaller id.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, and
    vectors of different lengths never meet. With fewer than ``k`` candidates all are returned.
    Repeated rows are candidates of their own and, as queries, get their results each. Null ids
    rank last among ties. Other columns are not read.

    The model is fitted on at most ``SAMPLE_ROWS`` rows; every row is indexed. The index consists
    of blocks of about ``index_rows`` codes; each block of queries visits each block of the index
    and takes from it every code within a radius that holds at least ``retrieved`` codes of the
    block. Equal vectors are indexed and searched once, however many rows have them.
    """
    pick = lambda df: df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    rows = with_key(pick(vectors), "_v").where("key is not null")
    asked = stored(
        with_key(pick(queries), "_v").where("key is not null").select("_id", "key")
        .withColumn("row", F.monotonically_increasing_id()), "ann-queries")
    classes = classes_of(rows, "_id", "_v", purpose="ann-classes").withColumn("dim", F.size("_v"))
    order = Window.partitionBy("key").orderBy(F.col("_id").asc_nulls_last())
    # The first k + 1 rows of a class are all that a result can hold.
    firsts = rows.select("key", "_id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    ids = firsts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "_id"))).alias("s"))
    index = classes.select("key", "dim", "_v", "node").join(ids.select("key", F.col("s._id").alias("ids")), "key")
    wanted = asked.select("key").distinct().join(classes.select("key", "dim", "_v"), "key")
    models, radii = {}, {}
    n_index = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}  # one entry per length
    for dim, n in n_index.items():
        sample = unit(matrix(bounded_sample(classes.where(F.col("dim") == dim), "key", SAMPLE_ROWS, ["_v"])["_v"]))
        models[dim] = Codes(sample)
        radii[dim] = first_radius(models[dim], sample, retrieved / min(n, index_rows))
    i_blocks = blocks(max(n_index.values(), default=1), index_rows)
    q_blocks = blocks(wanted.count(), query_rows)
    part = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = rows.schema["_id"].dataType.simpleString()
    none = F.lit(None).cast(f"array<{kind}>")
    both = index.select("dim", part(i_blocks).alias("i"), each(q_blocks).alias("j"), "key", "_v", "ids").union(
        wanted.select("dim", each(i_blocks).alias("i"), part(q_blocks).alias("j"), "key", "_v", none)
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        is_query = frame["ids"].isna().to_numpy()
        out: dict[str, list] = {"key": [], "_id": [], "score": []}
        if is_query.any() and not is_query.all():
            codes, radius = models[int(frame["dim"].iloc[0])], radii[int(frame["dim"].iloc[0])]
            raw = matrix(frame["_v"])
            parts = codes.parts(unit(raw))
            held = np.flatnonzero(~is_query)
            members = frame["ids"].to_numpy()
            least = np.array([np.inf if members[h][0] is None else members[h][0] for h in held])
            indexes = SubstringIndexes(parts[held])
            for q in np.flatnonzero(is_query):
                found = indexes.retrieve(parts[q], radius, max(retrieved, k + 1))
                score = cosine(np.broadcast_to(raw[q], (len(found), raw.shape[1])), raw[held[found]])
                for f in np.lexsort((least[found], -score))[: k + 1]:
                    for i in members[held[found[f]]]:
                        out["key"].append(frame["key"].iloc[q])
                        out["_id"].append(i)
                        out["score"].append(score[f])
        return pd.DataFrame({c: pd.Series(v, dtype="float64" if c == "score" else object) for c, v in out.items()})

    hits = both.groupBy("dim", "i", "j").applyInPandas(search, f"key string, _id {kind}, score double")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    top = hits.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    # One occurrence of the query's own id goes: its own row.
    pairs = asked.select("key", "row", F.col("_id").alias("query_id")).join(top, "key")
    own = F.col("query_id").eqNullSafe(F.col("_id"))
    occurrence = F.sum(own.cast("int")).over(Window.partitionBy("row").orderBy("at"))
    rest = pairs.withColumn("own", own & (occurrence == 1)).where("not own")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("at"))
    return rest.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score"
    )
