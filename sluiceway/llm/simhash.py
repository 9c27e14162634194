"""SimHash near-duplicates with vantage-point trees over Hamming distance.

Equal fingerprints are first made one. A vantage-point tree over a bounded sample cuts the space
into shards; every fingerprint is a member of one shard and, as a query, visits the later shards
that the triangle inequality does not rule out. Each shard builds its own tree over its members,
prunes the same way, and returns one link per linked fingerprint, never all pairs of a group.
Where ``jaccard`` is given these links only find candidates, and the shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import blocks, fresh, give_back, stored
from sluiceway.llm.components import components

SHARD_ROWS = 30_000
MAX_SHARDS = 4096  # bounds the tree on the driver; beyond it shards grow
SAMPLE_PER_SHARD = 32
LEAF = 1024
SEED = 42
PART_ROWS = 2_000  # of a candidate group that are compared with one another at a time
PART_BYTES = 8 << 20


def shingle_hashes(text: bytes, words: int, seeds: tuple[int, ...]) -> np.ndarray:
    """XXH64 of every run of ``words`` words, one column per seed; fewer words: one run of all."""
    parts = text.lower().split()
    if not parts:
        return np.empty((0, len(seeds)), ">u8")
    flat = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1 :]
    cut = list(zip(starts[:n].tolist(), stops[:n].tolist()))
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    return np.array([[digest(view[a:b], s) for a, b in cut] for s in seeds], ">u8").T.reshape(n, len(seeds))


def fingerprint(text: bytes, words: int, seeds: tuple[int, ...]) -> tuple[bytes, int]:
    """The fingerprint (64 bits per seed) and the number of shingles."""
    return majority(shingle_hashes(text, words, seeds), seeds)


def majority(hashes: np.ndarray, seeds: tuple[int, ...]) -> tuple[bytes, int]:
    """The bits that over half of the hashes have, and the number of hashes."""
    n = len(hashes)
    if not n:
        return bytes(8 * len(seeds)), 0
    ones = np.zeros(64 * len(seeds), np.int64)
    for i in range(0, n, 4096):  # bounds memory for very long texts
        raw = np.ascontiguousarray(hashes[i : i + 4096]).view(np.uint8)
        ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes(), n


def set_print(text: bytes, words: int, seeds: tuple[int, ...], small: int) -> tuple[bytes, int, str, list[str]]:
    """Fingerprint of the set of shingles, its size, a digest that only equal sets share, and for a
    set of ``small`` + 1 shingles the digests of its subsets without one of them."""
    hashes = shingle_hashes(text, words, seeds)
    if len(hashes):
        hashes = hashes[np.unique(hashes[:, 0], return_index=True)[1]]
    own, digest = hashes[:, 0], xxhash.xxh128_hexdigest
    less = [digest(np.delete(own, i).tobytes()) for i in range(len(own))] if len(own) == small + 1 else []
    return *majority(hashes, seeds), digest(own.tobytes()), less


def small_sets(jaccard: float) -> int:
    """Sets up to this size reach ``jaccard`` with equal sets only, or this size with one more shingle."""
    return math.ceil(jaccard / (1 - jaccard) - 1e-9) if 0.5 < jaccard < 1 else -1


def set_nodes(docs: DataFrame, *, id_col: str, text_col: str, words: int, seeds: tuple[int, ...], small: int = 0) -> DataFrame:
    """``id, fingerprint, node, size, digest, less``: as ``fingerprints``, but each distinct shingle
    counts once.

    ``node`` is fingerprint, size and digest of the set of shingles, with colons between; ``less``
    has the digests that ``set_print`` gives for sets a little larger than small ones.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_print(t or b"", words, seeds, small) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.hex() for f, *_ in found], pa.string()),
                 pa.array([f"{f.hex()}:{n}:{d}" for f, n, d, _ in found], pa.string()),
                 pa.array([n for _, n, _, _ in found], pa.int64()), pa.array([d for _, _, d, _ in found], pa.string()),
                 pa.array([less for *_, less in found], pa.list_(pa.string()))],
                names=["id", "fingerprint", "node", "size", "digest", "less"],
            )
        give_back()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {kind}, fingerprint string, node string, size long, digest string, less array<string>"
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seeds: tuple[int, ...] = (SEED,)
) -> DataFrame:
    """``id, fingerprint, shingles``: hexadecimal SimHash of the whole text, 64 bits per seed.

    A-Z are lower-cased; words are separated by ASCII white space; repeated shingles count each
    time. A bit is set if it is set in over half of the hashes. Null counts as empty, and texts
    without words have fingerprint zero.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", words, seeds) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.hex() for f, _ in found], pa.string()),
                 pa.array([n for _, n in found], pa.int64())],
                names=["id", "fingerprint", "shingles"],
            )
        give_back()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, fingerprint string, shingles long").withColumnRenamed("id", id_col)


def unpack(hexes: list[str]) -> np.ndarray:
    """One row of 64-bit words per hexadecimal fingerprint."""
    if not hexes:
        return np.empty((0, 1), np.uint64)
    raw = np.frombuffer(bytes.fromhex("".join(hexes)), ">u8").astype(np.uint64)
    return raw.reshape(len(hexes), -1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


class VantageTree:
    """Splits of a sample: inside a ball, outside it; leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, shards: int) -> None:
        self.shards = 0
        self.root = self._split(sample, shards, np.random.default_rng(SEED))

    def _split(self, points: np.ndarray, shards: int, rng) -> tuple | int:
        if shards > 1 and len(points) > 2:
            vantage = points[rng.integers(len(points))]
            distance = hamming(points, vantage[None])[:, 0]
            radius = int(np.median(distance))
            inside = distance <= radius
            if inside.any() and not inside.all():
                half = shards // 2
                return (vantage, radius, self._split(points[inside], shards - half, rng),
                        self._split(points[~inside], half, rng))
        self.shards += 1
        return self.shards - 1

    def visits(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, shard, at home) for every shard that may hold a point within ``radius``."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                found.append((rows, node, home))
                continue
            vantage, ball, inner, outer = node
            distance = hamming(points[rows], vantage[None])[:, 0]
            near, far = distance <= ball + radius, distance > ball - radius
            todo.append((inner, rows[near], home[near] & (distance[near] <= ball)))
            todo.append((outer, rows[far], home[far] & (distance[far] > ball)))
        rows = np.concatenate([r for r, _, _ in found])
        shard = np.concatenate([np.full(len(r), s) for r, s, _ in found])
        return rows, shard, np.concatenate([h for _, _, h in found])


def join_ball(queries: np.ndarray, members: np.ndarray, points: np.ndarray, radius: int, sink) -> None:
    """Give ``sink`` all (query, member) index pairs within ``radius``, a block at a time."""
    todo = [(queries, members)]
    while todo:
        q, m = todo.pop()
        if len(m) > LEAF and len(q):
            vantage = points[m[len(m) // 2]][None]
            dm, dq = hamming(points[m], vantage)[:, 0], hamming(points[q], vantage)[:, 0]
            ball = int(np.median(dm))
            inside, near, far = dm <= ball, dq <= ball + radius, dq > ball - radius
            kept = near.sum() * inside.sum() + far.sum() * (~inside).sum()
            if kept < 0.95 * len(q) * len(m):  # else the bounds rule nothing out
                todo += [(q[near], m[inside]), (q[far], m[~inside])]
                continue
        for i in range(0, len(q), 256):
            for j in range(0, len(m), 8192):
                a, b = np.nonzero(hamming(points[q[i : i + 256]], points[m[j : j + 8192]]) <= radius)
                if len(a):
                    sink(q[i + a], m[j + b])


class Forest:
    """Union-find over array indexes, many links at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.parent[a], self.parent[b]
            open_ = a != b
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up


def dealt_parts(nodes: DataFrame, radius: int, size_ratio: float | None, shard_rows: int) -> DataFrame:
    """``band, shard, i, j, node, member``: what a task compares, members with all others.

    A shard's members come in home parts, and all that visit it, its members too, in other parts;
    a task gets one of each, so that it holds a bounded number however many visit.
    """
    step = np.log(1 / size_ratio) if size_ratio else None
    if step is None:
        n = nodes.count()
    else:  # bands of similar size are joined apart, so the fullest one decides
        size = F.greatest(F.split("node", ":")[1].cast("long"), F.lit(1))
        bands = nodes.groupBy(F.floor(F.log(size) / F.lit(float(step)))).count()
        n = bands.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    shards = min(MAX_SHARDS, blocks(n, shard_rows))
    wanted = shards * SAMPLE_PER_SHARD
    picked = nodes.orderBy(F.xxhash64("node")).limit(wanted if shards > 1 else 0)  # bounded by MAX_SHARDS
    tree = VantageTree(unpack([r.node.split(":")[0] for r in picked.collect()]), shards)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            split = frame["node"].str.split(":")
            rows, shard, home = tree.visits(unpack(split.str[0].tolist()), radius)
            order = np.zeros(len(frame), np.int64)
            order[rows[home]] = shard[home]
            node = frame["node"].to_numpy()
            if step is None:
                later = shard >= order[rows]
                yield pd.DataFrame({"band": 0, "shard": shard[later], "node": node[rows[later]], "member": home[later]})
                continue
            size = split.str[1].astype("int64").to_numpy()
            band = np.floor(np.log(np.maximum(size, 1)) / step + 1e-9).astype(np.int64)
            band[size == 0] = -10  # texts without words are like one another only
            later = shard >= order[rows]
            yield pd.DataFrame({"band": band[rows[later]], "shard": shard[later], "node": node[rows[later]], "member": home[later]})
            yield pd.DataFrame({"band": band[rows] + 1, "shard": shard, "node": node[rows], "member": False})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in deal(frames):
            yield frame.groupby(["band", "shard"], as_index=False).agg(members=("member", "sum"), n=("member", "size"))

    sizes = nodes.mapInPandas(count, "band long, shard long, members long, n long").groupBy("band", "shard").agg(
        F.ceil(F.sum("members") / shard_rows).cast("int").alias("homes"),
        F.ceil(F.sum("n") / (2 * shard_rows)).cast("int").alias("others"),
    )
    dealt = nodes.mapInPandas(deal, "band long, shard long, node string, member boolean")
    placed = dealt.join(sizes.where("homes > 0"), ["band", "shard"]).withColumn("at", F.xxhash64("node"))
    copies = """flatten(array(
        if(member, transform(sequence(0, others - 1), x -> struct(cast(pmod(at, homes) as int) as i, x as j, true as member)), array()),
        transform(sequence(0, homes - 1), x -> struct(x as i, cast(pmod(at, others) as int) as j, false as member))))"""
    return placed.selectExpr("band", "shard", "node", f"explode({copies}) as c").select("band", "shard", "c.*", "node")


def near_links(
    nodes: DataFrame, radius: int, *, size_ratio: float | None = None, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``a, b``: links that join exactly the fingerprints within ``radius`` of one another.

    ``nodes`` has distinct ``node`` strings: hexadecimal words, and after a colon the size where
    ``size_ratio`` is given; then linked nodes' sizes also differ by no more than that ratio.
    Chains of links stand for all pairs: two nodes are connected here if and only if they are
    connected by pairs within ``radius``.
    """
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        member = frame["member"].to_numpy()
        empty = pd.DataFrame({"a": pd.Series(dtype=str), "b": pd.Series(dtype=str)})
        if not member.any() or len(frame) < 2:
            return empty
        node = frame["node"].to_numpy()
        split = frame["node"].str.split(":")
        points = unpack(split.str[0].tolist())
        forest = Forest(len(node))
        if size_ratio is None:
            link = forest.link
        else:
            size = split.str[1].astype("int64").to_numpy()

            def link(a: np.ndarray, b: np.ndarray) -> None:
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                fit = low >= size_ratio * high
                forest.link(a[fit], b[fit])

        join_ball(np.flatnonzero(~member), np.flatnonzero(member), points, radius, link)
        moved = forest.parent != np.arange(len(node))
        return pd.DataFrame({"a": node[moved], "b": node[forest.parent[moved]]})

    parts = dealt_parts(nodes, radius, size_ratio, shard_rows)
    return parts.groupBy("band", "shard", "i", "j").applyInPandas(join, "a string, b string")


def similar_links(points: np.ndarray, sets: list[np.ndarray], part: np.ndarray, radius: int, jaccard: float) -> np.ndarray:
    """For each set the least one that it is connected to by pairs with ``jaccard`` or more.

    Only pairs within ``radius`` are compared, and where there are two parts only pairs across
    them; a pair that is connected already needs no comparison.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(len(flat) + 1, bool)
    root = np.arange(n)
    across = part.min() != part.max()
    for i in range(n):
        own = size[i]
        later = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        low, high = np.minimum(size[later], own), np.maximum(size[later], own)
        later = later[(low >= jaccard * high) & ((part[later] != part[i]) | (not across))]
        if not len(later):
            continue
        later = later[hamming(points[later], points[i : i + 1])[:, 0] <= radius]
        held = flat[begin[i] : begin[i] + own]
        mark[held] = True
        for a in range(0, len(later), 256):
            some = later[a : a + 256]
            some = some[root[some] != root[i]]
            if not len(some):
                continue
            n_some = size[some]
            starts = np.cumsum(n_some) - n_some
            at = np.arange(n_some.sum()) + np.repeat(begin[some] - starts, n_some)
            both = np.add.reduceat(mark[flat[at]], starts, dtype=np.int64) if own else n_some * 0
            like = both / np.maximum(1, own + n_some - both) >= jaccard
            joined = np.unique(np.append(root[some[like]], root[i]))
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
        mark[held] = False
    return root


def similar_pairs(
    docs: DataFrame, members: DataFrame, *, words: int, seeds: tuple[int, ...], radius: int, jaccard: float,
    part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``a, b``: links that connect exactly the nodes of each candidate group whose shingle sets
    are connected by pairs with a Jaccard similarity of ``jaccard`` or more.

    ``docs`` has ``_id, _text``, ``members`` has ``node, least, root``. A large group is cut into
    parts and each two parts are compared in a task of their own; small groups share tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = [np.unique(shingle_hashes(t or b"", words, seeds[:1])[:, 0]).astype("<u8").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["root", "node", "shingles"])
        give_back()

    one = docs.join(members, F.col("_id").eqNullSafe(F.col("least")))
    sets = one.select("root", "node", F.col("_text").cast("binary").alias("t")).mapInArrow(run, "root string, node string, shingles binary")
    # rows that repeat id and text give the same set several times
    sets = stored(sets.groupBy("root", "node").agg(F.min("shingles").alias("shingles")), "shingle-sets")
    held = F.octet_length("shingles")
    groups = sets.groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / part_rows, F.sum(held) / part_bytes, F.lit(1))).cast("int").alias("parts")
    )
    total = sets.agg(F.coalesce(F.sum(held), F.lit(0)), F.count("*")).first()
    tasks = max(blocks(total[0], part_bytes), blocks(total[1], part_rows))
    placed = sets.join(groups, "root").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.when(F.col("parts") == 1, F.concat(F.lit("."), F.pmod(F.xxhash64("root"), F.lit(tasks)))).otherwise(
        F.concat_ws(".", "root", F.least("part", "other"), F.greatest("part", "other"))
    )

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in frame.groupby("root"):
            if len(group) > 1:
                node = group["node"].to_numpy()
                points = unpack([n.split(":")[0] for n in node])
                sets = [np.frombuffer(s, "<u8") for s in group["shingles"]]
                root = similar_links(points, sets, group["part"].to_numpy(), radius, jaccard)
                moved = root != np.arange(len(node))
                found.append(pd.DataFrame({"a": node[moved], "b": node[root[moved]]}))
        give_back()
        return pd.concat(found) if found else pd.DataFrame({"a": pd.Series(dtype=str), "b": pd.Series(dtype=str)})

    asked = placed.select(task.alias("task"), "root", "node", "part", "shingles")
    return asked.groupBy("task").applyInPandas(join, "a string, b string")


def simhash_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
    seeds: tuple[int, ...] = (SEED,),
    size_ratio: float | None = None,
    jaccard: float | None = None,
) -> DataFrame:
    """``id, fingerprint, component_id``, one row per row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked (with ``size_ratio``
    only if their shingle counts are within that ratio); ``component_id`` is the least id that a
    document reaches through links, itself included. Texts without words (null, empty, blank) have
    fingerprint zero and are linked like any other. Repeated rows give a row each; a null id is
    reached but is never the least unless all ids of a component are null. Other columns are not
    read. Equal fingerprints are one node, so a group of copies of any size costs one row.

    With ``jaccard``, documents are linked if their sets of shingles have at least that Jaccard
    similarity (sets of 64-bit hashes; repeats don't count). Fingerprints of the sets, within
    ``radius``, only find the candidates, and equal sets are one node. Small sets (at 0.8: of four
    shingles or fewer) need no fingerprints: they reach it with an equal set only, or as a subset
    of a set with one shingle more, which is an equal join of digests.
    """
    if jaccard is not None:
        keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        small = small_sets(jaccard)
        prints = stored(set_nodes(keyed, id_col="_id", text_col="_text", words=words, seeds=seeds, small=small), "fingerprints")
        same = [F.first(c).alias(c) for c in ("size", "digest", "less")]
        nodes = stored(prints.groupBy("node").agg(F.min("_id").alias("least"), *same), "fingerprint-nodes")
        large = nodes.where(F.col("size") > small)
        groups = components(near_links(large.select("node"), radius, size_ratio=jaccard), "candidate-links")
        links = similar_pairs(
            keyed, large.select("node", "least").join(groups, "node"), words=words, seeds=seeds, radius=radius, jaccard=jaccard
        )
        inside = nodes.where(F.col("size") == small).select(F.col("node").alias("a"), "digest")
        around = nodes.where(F.col("size") == small + 1).select(F.explode("less").alias("digest"), F.col("node").alias("b"))
        links = links.union(inside.join(around, "digest").select("a", "b"))
        return _components_of(prints, nodes.select("node", "least"), links, id_col)
    node = F.col("fingerprint") if size_ratio is None else F.concat_ws(":", "fingerprint", "shingles")
    prints = stored(
        fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seeds=seeds).select(
            F.col(id_col).alias("_id"), "fingerprint", node.alias("node")
        ),
        "fingerprints",
    )
    nodes = stored(prints.groupBy("node").agg(F.min("_id").alias("least")), "fingerprint-nodes")
    return _components_of(prints, nodes, near_links(nodes.select("node"), radius, size_ratio=size_ratio), id_col)


def _components_of(prints: DataFrame, nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """The least id of each document's component."""
    roots = components(links, "fingerprint-links")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "fingerprint-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = named.join(least, "root").select("node", "component_id")
    return prints.join(by_node, "node").select(F.col("_id").alias(id_col), "fingerprint", "component_id")


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when each group keeps one document.

    Of a group of near-duplicates (see ``simhash_components``, which takes ``options``) the one
    with the least id stays, null ids last; of rows that repeat both id and text one stays. Ids are
    whole numbers. Null and empty texts are one group.
    """
    key = F.struct(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("k"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"),
    )
    found = simhash_components(
        docs.select(key.alias("_key"), F.col(text_col).alias("_text")), id_col="_key", text_col="_text", **options
    )
    k, h, at = fresh("k"), fresh("h"), fresh("at")
    first = stored(found.select(F.col("component_id.k").alias(k), F.col("component_id.h").alias(h)).distinct(), "firsts")
    keyed = docs.withColumns({k: key["k"], h: key["h"]})
    one = Window.partitionBy(k, h).orderBy(F.lit(1))
    stay = keyed.join(first, [k, h], "left_semi").withColumn(at, F.row_number().over(one)).where(F.col(at) == 1)
    return stay.select(*docs.columns)
