"""Merkle manifest of a table: content-addressed records, proofs by descent from the root.

Every tree (a source) has its leaves in order; three nodes in a row are the children of the next
level's node, and the trees' roots are the leaves of one more tree on top. The manifest keeps one
record for every node: its digest and its children's digests. Records of up to six levels below a
node form a pack, which is kept under that node's digest, so that equal subtrees are kept once.

A proof is asked for by a leaf's place. Requests gather by the pack that they end in, these packs
by the packs above, up to the root. From there they descend: a record is looked up by its digest,
the next base-3 digit of the place selects a child, and the other children are collected. Each
pack gives one segment of a path; segments, the last one first, lead from the leaf to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import stored
from sluiceway.operators.ordinal import running_ordinal

FANOUT = 3
STRIDE = 6  # levels of a pack
PACK = FANOUT**STRIDE
TOP = ""  # code of the tree over the trees' roots
PACKS = "code string, pack long, size long, digest string, names array<string>, children array<array<string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 over the encoded values, one after the other."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def fold_proof(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf digest and what lies beside its path lead to."""
    step = lambda at, side: F.sha2(F.concat(side["l"], at, side["r"]), 256)
    sides = F.zip_with(lefts, rights, lambda left, right: F.struct(left.alias("l"), right.alias("r")))
    return F.aggregate(sides, leaf, step)


def levels_of(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // FANOUT), level + 1
    return level


def pack_levels(size: int, stage: int) -> int:
    """Levels that the packs of a stage span in a tree with ``size`` leaves."""
    return max(0, min(STRIDE, levels_of(size) - STRIDE * stage))


def stages_of(size: int) -> int:
    """Stages of packs in a tree with ``size`` leaves; a lone leaf is a pack without levels."""
    return max(1, -(-levels_of(size) // STRIDE))


def pack_records(digests: list[str], levels: int) -> tuple[str, list[str], list[list[str]]]:
    """Topmost digest, and the digest and children of every node in ``levels`` levels over ``digests``."""
    names: list[str] = []
    children: list[list[str]] = []
    for _ in range(levels):
        runs = [digests[i : i + FANOUT] for i in range(0, len(digests), FANOUT)]
        digests = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
        names += digests
        children += runs
    return digests[0], names, children


def segment(records: dict[str, list[str]], top: str, place: int, levels: int) -> tuple[str, list[str], list[str]]:
    """Descend from ``top`` by the digits of ``place``: the digest reached, and what was left and
    right of the selected child at each level, the lowest level first."""
    at, lefts, rights = top, [], []
    for level in reversed(range(levels)):
        digit = place // FANOUT**level % FANOUT
        run = records[at]
        lefts.append("".join(run[:digit]))
        rights.append("".join(run[digit + 1 :]))
        at = run[digit]
    return at, lefts[::-1], rights[::-1]


def _pack() -> Column:
    return F.expr(f"place div {PACK}")


def _last_stage() -> Column:
    """The stage at which a tree ends in one pack."""
    return reduce(add, [(F.col("size") > PACK**i).cast("int") for i in range(1, 7)])


def _lift(stage: int) -> Callable[[pa.Table], pa.Table]:
    def lift(group: pa.Table) -> pa.Table:
        rows = group.sort_by("place")
        code, pack, size = (rows.column(c)[0].as_py() for c in ("code", "pack", "size"))
        top, names, children = pack_records(rows.column("digest").to_pylist(), pack_levels(size, stage))
        return pa.table({
            "code": [code], "pack": pa.array([pack], pa.int64()), "size": pa.array([size], pa.int64()), "digest": [top],
            "names": pa.array([names], pa.list_(pa.string())),
            "children": pa.array([children], pa.list_(pa.list_(pa.string()))),
        })

    return lift


def climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Packs over the leaves ``code, place, digest, size``, one table per stage, foot first.

    ``size`` is the tree's number of leaves, ``largest`` that of the largest tree. A group is one
    pack of at most 729 nodes, whatever the size of the tree.
    """
    tables = []
    for stage in range(stages_of(largest)):
        foot = nodes.withColumn("pack", _pack()).select("code", "pack", "place", "digest", "size")
        packs = stored(foot.groupBy("code", "pack").applyInArrow(_lift(stage), PACKS), "merkle-packs")
        tables.append(packs)
        nodes = packs.where(F.col("size") > PACK ** (stage + 1)).select("code", F.col("pack").alias("place"), "digest", "size")
    return tables


def tops(tables: list[DataFrame]) -> DataFrame:
    """``code, size, digest``: the topmost node of every tree."""
    last = [t.where(_last_stage() == stage).select("code", "size", "digest") for stage, t in enumerate(tables)]
    return reduce(DataFrame.union, last)


def _go(stage: int, columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    paths = pa.list_(pa.string())
    kinds = {"digest": pa.string(), "lefts": paths, "rights": paths, "subroot": pa.string()}

    def go(asks: pa.Table, front: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in kinds}
        rows = []
        if len(asks) and len(front):
            (top,) = front.to_pylist()
            records = dict(zip(top["names"], top["children"]))
            levels = pack_levels(top["size"], stage)
            for row, place in enumerate(asks.column("place").to_pylist()):
                at, lefts, rights = segment(records, top["digest"], place % PACK, levels)
                rows.append(row)
                found["digest"].append(at)
                found["lefts"].append(lefts + top["lefts"])
                found["rights"].append(rights + top["rights"])
                found["subroot"].append(top["subroot"])
        out = asks.select(columns).take(pa.array(rows, pa.int64()))
        for name, kind in kinds.items():
            out = out.append_column(name, pa.array(found[name], kind))
        return out

    return go


def descend(requests: DataFrame, starts: DataFrame, packs: DataFrame, largest: int, columns: list[str]) -> DataFrame:
    """From the tops of trees down to the requested places.

    ``requests``: ``code, place, size`` and ``columns``, each place of a tree once; ``starts``: one
    row per tree with ``code, size``, the ``digest`` of its top, what lies beside the path above it
    (``lefts, rights``) and its ``subroot``; ``packs``: ``digest, names, children``. Gives
    ``columns`` and ``digest, lefts, rights, subroot`` of every place.
    """
    asked = [requests]
    for stage in range(1, stages_of(largest)):
        up = asked[-1].where(F.col("size") > PACK**stage)
        asked.append(up.select("code", _pack().alias("place"), "size").distinct())
    at = ["code", "pack", "size", "digest", "lefts", "rights", "subroot"]
    starts = starts.withColumn("pack", F.lit(0).cast("long"))
    front = starts.where(_last_stage() == len(asked) - 1).select(at)
    for stage in reversed(range(len(asked))):
        wanted = ["code", "place", "size"] if stage else columns
        ask = asked[stage].withColumn("pack", _pack())
        schema = T.StructType([ask.schema[c] for c in wanted])
        for c in ("digest", "lefts", "rights", "subroot"):
            schema = schema.add(starts.schema[c])
        held = front.join(packs, "digest")
        reached = ask.groupBy("code", "pack").cogroup(held.groupBy("code", "pack")).applyInArrow(_go(stage, wanted), schema)
        if stage:
            reached = stored(reached.withColumnRenamed("place", "pack"), "merkle-reached").select(at)
            front = reached.union(starts.where(_last_stage() == stage - 1).select(at))
    return reached


@dataclass
class Manifest:
    """``leaves``: ``code, place, leaf, size`` and the columns that came along; ``trees``: ``tree,
    code, size, place, subroot``; ``packs``: ``digest, names, children``, each digest once."""

    leaves: DataFrame
    trees: DataFrame
    packs: DataFrame
    root: str | None
    largest: int
    tree_count: int


def build_manifest(rows: DataFrame, *, tree_col: str, order_col: str, columns: list[str], along: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``rows``: a tree for each value of ``tree_col``, its leaves by ``order_col``.

    A leaf is the digest of ``columns`` (see ``leaf_digest``). Trees are ordered by their value,
    null first, strings bytewise. Rows with equal ``order_col`` are ordered by their digest, and
    rows that agree in both are interchangeable; repeated rows are leaves of their own. Null keys
    come first. ``along`` names more columns for ``leaves``. An empty table has no root.

    A tree may hold any share of the rows: places come from one range pass, and the tree is built
    in packs of 729 leaves.
    """
    along = along or {}
    read = rows.select(
        F.col(tree_col).alias("tree"), F.col(order_col).alias("at"), encoded(F.col(tree_col)).alias("code"),
        leaf_digest(*map(F.col, columns)).alias("leaf"), F.monotonically_increasing_id().alias("row"),
        *[c.alias(f"along_{name}") for name, c in along.items()],
    )
    read = stored(read, "merkle-leaves")
    counted = read.groupBy("tree", "code").agg(F.count("*").alias("size"))
    trees = stored(running_ordinal(counted, [], ["tree"], "place"), "merkle-trees")
    tree_count, largest = trees.agg(F.count("*"), F.max("size")).first()
    placed = running_ordinal(read, ["tree"], ["at", "leaf", "row"], "place").drop("tree", "at", "row")
    placed = placed.withColumn("place", F.col("place") - 1)
    leaves = placed.join(trees.select("code", "size"), "code")
    tables = climb(leaves.select("code", "place", F.col("leaf").alias("digest"), "size"), largest or 0)
    subroots = tops(tables).select("code", F.col("digest").alias("subroot"))
    trees = stored(trees.join(subroots, "code").withColumn("place", F.col("place") - 1), "merkle-subroots")
    over = trees.select(F.lit(TOP).alias("code"), "place", F.col("subroot").alias("digest"), F.lit(tree_count).alias("size"))
    upper = climb(over, tree_count)
    root = tops(upper).first()
    each = reduce(DataFrame.union, [t.select("digest", "names", "children") for t in tables + upper])
    packs = each.groupBy("digest").agg(F.first("names").alias("names"), F.first("children").alias("children"))
    return Manifest(leaves, trees, stored(packs, "merkle-store"), root and root.digest, largest or 0, tree_count)


def prove(manifest: Manifest, requests: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, ``leaf, subroot, root, lefts, rights`` for the requested leaves.

    ``requests`` has ``code, place, size`` as in ``manifest.leaves``, each leaf once. ``lefts`` and
    ``rights`` have one entry per level from the leaf to the root: the digests of the node's
    siblings before and after it, joined. ``leaf`` is read from the manifest, not from the request.
    """
    empty = F.array().cast("array<string>")
    trees = manifest.trees
    top = [F.lit(manifest.root).alias("digest"), empty.alias("lefts"), empty.alias("rights"), F.lit(None).cast("string").alias("subroot")]
    root = trees.sparkSession.range(1 if manifest.root else 0).select(
        F.lit(TOP).alias("code"), F.lit(manifest.tree_count).alias("size"), *top)
    over = trees.select(F.lit(TOP).alias("code"), "place", F.lit(manifest.tree_count).alias("size"), F.col("code").alias("tree_code"), F.col("size").alias("tree_size"))
    starts = descend(over, root, manifest.packs, manifest.tree_count, ["tree_code", "tree_size"])
    starts = stored(starts.select(
        F.col("tree_code").alias("code"), F.col("tree_size").alias("size"), "digest", "lefts", "rights", F.col("digest").alias("subroot"),
    ), "merkle-starts")
    found = descend(requests, starts, manifest.packs, manifest.largest, columns)
    return found.select(*columns, F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), "lefts", "rights")


def verified_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, lefts, rights, presented, folded_root, verified`` per document.

    Builds the manifest of ``docs`` (a tree per ``source``, leaves by ``doc_id``), proves every
    document, and folds the leaf of a tampered copy over its proof: where 2 divides the unsigned
    CRC-32 of the decimal id, line feeds are deleted from the text. Null texts stay, and a document
    without an id isn't tampered with. Extra columns are not read.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = leaf_digest(*map(F.col, fields[:-1]), F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    presented = F.when(tampered, cut).otherwise(leaf_digest(*map(F.col, fields)))
    manifest = build_manifest(
        docs, tree_col="source", order_col="doc_id", columns=fields, along={"id": F.col("doc_id"), "presented": presented})
    proved = prove(manifest, manifest.leaves, ["along_id", "along_presented"])
    folded = fold_proof(F.col("along_presented"), F.col("lefts"), F.col("rights"))
    return proved.select(
        F.col("along_id").alias("doc_id"), "leaf", "subroot", "root", "lefts", "rights",
        F.col("along_presented").alias("presented"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
