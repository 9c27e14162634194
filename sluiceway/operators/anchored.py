"""First-event-anchored windows per channel.

Rows of a channel are taken in arrival order. Without an open window the row becomes the anchor.
The first row at least ``width_ms`` after the anchor closes the window and is itself dropped from
it; the row after that anchors anew. Earlier rows than the anchor stay in the window. Windows are
numbered 1, 2, ... per channel. The last window of a channel may never be closed.

The definition is sequential, but a channel may hold half of all data, so it is not walked in one
task. Blocks of rows with a bounded size are turned into small maps (see ``window_maps``), the
maps are chained to give each block the state before it, and then all blocks are numbered in
parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.numbers import floored
from sluiceway.functions.time import bucket_start
from sluiceway.operators.window_maps import UNSET, AnchorMap, block_map, replay
from sluiceway.session import written

ARRIVAL_BLOCK_ROWS = 1 << 18
TIME_BLOCK_MS = 1 << 21
FAN_IN = 64
STEPS_IN_GROUP = 1 << 23
_STEPS_PER_BATCH = 100_000
_ROWS_PER_BATCH = 10_000

_MAP_SCHEMA = (
    "_ch int, _part long, unset_exit long, unset_opened long, "
    "upto array<long>, exits array<long>, opened array<long>, below long"
)
_MAP_ARROW = pa.schema(
    [("_ch", pa.int32()), ("_part", pa.int64()), ("unset_exit", pa.int64())]
    + [("unset_opened", pa.int64())]
    + [(name, pa.list_(pa.int64())) for name in ("upto", "exits", "opened")]
    + [("below", pa.int64())]
)
_ENTRY_SCHEMA = "_ch int, _part long, anchor long, opened long"


def _maps_of(pdf: pd.DataFrame) -> list[AnchorMap]:
    pdf = pdf.sort_values("_part")
    return [
        AnchorMap(
            int(r.unset_exit),
            int(r.unset_opened),
            np.asarray(r.upto, dtype=np.int64),
            np.asarray(r.exits, dtype=np.int64),
            np.asarray(r.opened, dtype=np.int64),
            int(r.below),
        )
        for r in pdf.itertuples()
    ]


def _map_fields(ch: int, part: int, m: AnchorMap) -> dict:
    return {
        "_ch": ch,
        "_part": part,
        "unset_exit": m.unset_exit,
        "unset_opened": m.unset_opened,
        "upto": m.upto,
        "exits": m.exits,
        "opened": m.opened,
        "below": m.below,
    }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """Cut a partition sorted by ``_ch, _part`` into its blocks, holding one block at a time."""
    current, pieces = None, []
    for batch in batches:
        ch, part = batch.column("_ch").to_numpy(), batch.column("_part").to_numpy()
        edges = np.flatnonzero((ch[1:] != ch[:-1]) | (part[1:] != part[:-1])) + 1
        for start, stop in zip([0, *edges], [*edges, len(ch)]):
            if stop == start:
                continue
            key = (int(ch[start]), int(part[start]))
            if key != current and pieces:
                yield current, pa.Table.from_batches(pieces)
                pieces = []
            current = key
            pieces.append(batch.slice(start, stop - start))
    if pieces:
        yield current, pa.Table.from_batches(pieces)


def _chain(maps: DataFrame) -> DataFrame:
    """One map for each run of consecutive parts."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        maps = _maps_of(pdf)
        total = maps[0]
        for later in maps[1:]:
            total = total.then(later)
        return pd.DataFrame([_map_fields(key[0], key[1], total)])

    return maps.groupBy("_ch", "_run").applyInPandas(fold, _MAP_SCHEMA)


def _in_runs(maps: DataFrame, fan_in: int | None) -> DataFrame:
    """Bring runs of ``fan_in`` parts (or all parts of a channel) together, once for all uses."""
    run = F.lit(0).cast("long") if fan_in is None else floored(F.col("_part"), fan_in)
    return maps.withColumn("_run", run).repartition("_ch", "_run")


def _entries(maps: DataFrame, before: DataFrame | None) -> DataFrame:
    """State before each part, given the state before each run (nothing open if absent)."""
    if before is None:
        maps = maps.withColumn("anchor", F.lit(UNSET)).withColumn("before", F.lit(0).cast("long"))
    else:
        before = before.select(
            "_ch", F.col("_part").alias("_run"), "anchor", F.col("opened").alias("before")
        )
        maps = (
            maps.join(before, ["_ch", "_run"], "left")
            .withColumn("anchor", F.coalesce("anchor", F.lit(UNSET)))
            .withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
        )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        anchor, opened = int(pdf["anchor"].iloc[0]), int(pdf["before"].iloc[0])
        states = []
        for m in _maps_of(pdf):
            states.append((anchor, opened))
            exits, more = m(np.array([anchor]))
            anchor, opened = int(exits[0]), opened + int(more[0])
        out = pdf[["_ch", "_part"]].copy()
        out["anchor"], out["opened"] = zip(*states)
        return out

    return maps.groupBy("_ch", "_run").applyInPandas(walk, _ENTRY_SCHEMA)


def _numbered(
    rows: DataFrame, width_ms: int, carry: DataFrame | None, arrival_is_time: bool
) -> DataFrame:
    """Add ``win``, ``is_closer`` and ``is_anchor`` to rows ``_ch, _part, _seq, _ms, ...``.

    With ``arrival_is_time`` only anchors and closers are given back.

    ``(_ch, _part)`` blocks must have a bounded size and follow ``_seq``. The exchange below feeds
    both passes. A map is told the latest event time before its block, carried anchors included:
    no later anchor can enter, so a map, and any chain of maps, has at most one step per
    millisecond of ``width_ms`` and of the lateness of rows. Runs have as many maps as hold
    ``STEPS_IN_GROUP`` steps, ``FAN_IN`` at most, and there are as many levels of runs as it
    takes, so no group sees the rows themselves or more than a bounded number of steps.
    """
    rows = rows.repartition("_ch", "_part")
    earlier = Window.partitionBy("_ch").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    peaks = rows.groupBy("_ch", "_part").agg(F.max("_ms").alias("_peak"))
    peaks = peaks.select("_ch", "_part", F.max("_peak").over(earlier).alias("_peak"))
    if carry is not None:
        anchors = carry.select(F.col("ch").cast("int").alias("_ch"), F.col("anchor").alias("_anchor"))
        peaks = peaks.join(anchors, "_ch", "left").select("_ch", "_part", F.greatest("_peak", "_anchor").alias("_peak"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, steps = [], 0
        for (ch, part), block in _blocks(batches):
            ms = block.column("_ms").to_numpy()
            peak = block.column("_peak")[0].as_py()
            m = block_map(ms, width_ms, UNSET + 1 if peak is None else peak + 1)
            done.append(_map_fields(ch, part, m))
            steps += len(m.upto) + 1
            if steps > _STEPS_PER_BATCH:
                yield pa.RecordBatch.from_pylist(done, _MAP_ARROW)
                done, steps = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, _MAP_ARROW)

    known = rows.select("_ch", "_part", "_seq", "_ms").join(peaks, ["_ch", "_part"], "left")
    maps = known.sortWithinPartitions("_ch", "_part", "_seq").mapInArrow(summarise, _MAP_SCHEMA)
    maps = written(maps, "window-maps")
    span = F.max("_part") - F.min("_part") + 1
    steps, parts = maps.agg(F.max(F.size("upto")), span).first()
    fan_in = max(2, min(FAN_IN, STEPS_IN_GROUP // max(1, steps or 1)))
    levels, parts = [_in_runs(maps, fan_in)], (parts or 1) // fan_in + 2
    while parts > max(4, fan_in):
        levels.append(_in_runs(_chain(levels[-1]), fan_in))
        parts = parts // fan_in + 2
    levels.append(_in_runs(_chain(levels[-1]), None))  # at most that many runs are left
    if carry is not None:
        carry = carry.select(
            F.col("ch").cast("int").alias("_ch"),
            F.lit(0).cast("long").alias("_part"),
            F.coalesce("anchor", F.lit(UNSET)).alias("anchor"),
            F.col("win").alias("opened"),
        )
    at_part = carry
    for maps in reversed(levels):
        at_part = _entries(maps, at_part)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for _, block in _blocks(batches):
            anchor, opened = block.column("anchor")[0].as_py(), block.column("opened")[0].as_py()
            win, closes, opens = replay(block.column("_ms").to_numpy(), width_ms, anchor, opened)
            block = block.drop_columns(["anchor", "opened"])
            block = block.append_column("win", pa.array(win))
            block = block.append_column("is_closer", pa.array(closes))
            block = block.append_column("is_anchor", pa.array(opens))
            # In time order only the edges are wanted; leave the rest out before it travels back.
            block = block.filter(pa.array(opens | closes)) if arrival_is_time else block
            done.append(block)
            size += len(block)
            if size > _ROWS_PER_BATCH:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done, size = [], 0
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    schema = rows.select(
        "*",
        F.lit(0).cast("long").alias("win"),
        F.lit(True).alias("is_closer"),
        F.lit(True).alias("is_anchor"),
    ).schema
    # Every block has an entry; a left join keeps the shared exchange free of null filters.
    placed = rows.join(at_part, ["_ch", "_part"], "left").select(
        *[rows[c] for c in rows.columns], "anchor", "opened"
    )
    return placed.sortWithinPartitions("_ch", "_part", "_seq").mapInArrow(number, schema)


def window_edges(
    df: DataFrame, channel: str, ms: str, tie: str, width_ms: int, carry: DataFrame | None = None
) -> DataFrame:
    """Anchors and closers of all windows when rows arrive in the order ``(ms, tie)``.

    Gives ``_ch, _ms, _tie, win, is_closer``, two rows per closed window. ``tie`` must be unique
    within a channel and millisecond.

    The result is written once to the shared folder, since placing rows and joining both read it.
    Only the first two rows of a millisecond can be an anchor or a closer, so rows are aggregated
    to milliseconds first, before any shuffle. A block is a span of time, hence at most two rows
    per millisecond of that span however dense the data is.
    """
    span = max(TIME_BLOCK_MS, width_ms)
    ticks = df.groupBy(F.col(channel).cast("int").alias("_ch"), F.col(ms).alias("_ms")).agg(
        F.min(tie).alias("_tie"), F.count(F.lit(1)).alias("_n")
    )
    rows = ticks.select(
        "_ch",
        floored(F.col("_ms"), span).alias("_part"),
        F.explode(F.when(F.col("_n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("_k"),
        "_ms",
        "_tie",
    ).select("_ch", "_part", (F.col("_ms") * 2 + F.col("_k")).alias("_seq"), "_ms", "_tie")
    numbered = _numbered(rows, width_ms, carry, arrival_is_time=True)
    return written(numbered.select("_ch", "_ms", "_tie", "win", "is_closer"), "window-edges")


def _edges_by_bucket(edges: DataFrame, carry: DataFrame | None, width_ms: int) -> DataFrame:
    """One row per channel and ``width_ms`` bucket.

    Anchors of a channel are at least ``width_ms`` apart and so are closers, so a bucket holds at
    most one of each, and a row's window was anchored in its own bucket or the one before.
    """
    bucket = bucket_start(F.col("_ms"), width_ms)
    no = F.lit(None).cast("long")
    tie = dict(edges.dtypes)["_tie"]
    no_tie = F.lit(None).cast(tie)
    if carry is not None:
        carried = carry.where("anchor is not null").select(
            F.col("ch").cast("int").alias("_ch"),
            F.col("anchor").alias("_ms"),
            no_tie.alias("_tie"),
            "win",
            F.lit(False).alias("is_closer"),
        )
        edges = edges.unionByName(carried)

    is_closer, own, ms = F.col("is_closer"), F.col("win"), F.col("_ms")

    def fact(at, anchor, win, prev, closer, closer_tie, closer_win):
        return F.struct(
            at.alias("_bucket"),
            anchor.alias("_anchor"),
            win.alias("_win"),
            prev.alias("_prev"),
            closer.alias("_closer"),
            closer_tie.alias("_closer_tie"),
            closer_win.alias("_closer_win"),
        )

    of_closer = F.array(fact(bucket, no, no, no, ms, F.col("_tie"), own))
    of_anchor = F.array(
        fact(bucket, ms, own, no, no, no_tie, no),
        fact(bucket + width_ms, no, no, own, no, no_tie, no),
    )
    parts = edges.select("_ch", F.inline(F.when(is_closer, of_closer).otherwise(of_anchor)))
    names = ["_anchor", "_win", "_prev", "_closer", "_closer_tie", "_closer_win"]
    return parts.groupBy("_ch", "_bucket").agg(*[F.max(c).alias(c) for c in names])


def anchored_window(
    df: DataFrame, channel: str, ms: str, tie: str, width_ms: int, carry: DataFrame | None = None
) -> DataFrame:
    """Add ``win`` and ``is_closer`` to every row; rows arrive in the order ``(ms, tie)``.

    ``carry`` (``ch, anchor, win``, one row per channel) continues from an earlier run: the open
    window's anchor or null, and the number of windows opened so far.
    """
    edges = window_edges(df, channel, ms, tie, width_ms, carry)
    return place_rows(df, edges, channel, ms, tie, width_ms, carry)


def place_rows(
    df: DataFrame,
    edges: DataFrame,
    channel: str,
    ms: str,
    tie: str,
    width_ms: int,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Window and closer flag of each row, given the edges of the windows.

    The bucket table has one row per key and a known size: Spark broadcasts it when it is small,
    and otherwise shuffles and lets adaptive execution split a crowded bucket's rows. Of rows that
    share time and tie with a closer one closes, the least by all columns that have an order; only
    these rows are brought together.
    """
    buckets = _edges_by_bucket(edges, carry, width_ms)
    keyed = df.withColumn("_ch", F.col(channel).cast("int")).withColumn(
        "_bucket", bucket_start(F.col(ms), width_ms)
    )
    placed = keyed.join(buckets, ["_ch", "_bucket"], "left")
    alike = (F.col("_closer") == F.col(ms)) & F.col("_closer_tie").eqNullSafe(F.col(tie))
    alike = F.coalesce(alike, F.lit(False))
    same = Window.partitionBy("_ch", "_closer_win").orderBy(*[c for c, t in df.dtypes if "map<" not in t])
    closers = placed.where(alike).withColumn("_closes", F.row_number().over(same) == 1)
    placed = placed.where(~alike).withColumn("_closes", F.lit(False)).unionByName(closers)
    closes = F.col("_closes")
    win = (
        F.when(closes, F.col("_closer_win"))
        .when(F.col("_anchor") <= F.col(ms), F.col("_win"))
        .otherwise(F.col("_prev"))
    )
    if carry is not None:
        carried = carry.select(F.col("ch").cast("int").alias("_ch"), F.col("win").alias("_carried"))
        placed = placed.join(carried, "_ch", "left")  # one row per channel
        win = F.coalesce(win, F.col("_carried"))
    return placed.select(*df.columns, win.alias("win"), closes.alias("is_closer"))


def anchored_window_by_arrival(
    df: DataFrame, channel: str, ms: str, seq: str, width_ms: int, carry: DataFrame | None = None
) -> DataFrame:
    """Add ``win`` and ``is_closer``; rows arrive in the order of the unique whole number ``seq``.

    Event times may be in any order. A block is a span of ``seq``, so it has at most
    ``ARRIVAL_BLOCK_ROWS`` rows. Select the needed columns first: all of them pass through Arrow.
    """
    rows = df.select(
        F.col(channel).cast("int").alias("_ch"),
        floored(F.col(seq), ARRIVAL_BLOCK_ROWS).alias("_part"),
        F.col(seq).cast("long").alias("_seq"),
        F.col(ms).alias("_ms"),
        *[F.col(c) for c in df.columns],
    )
    numbered = _numbered(rows, width_ms, carry, arrival_is_time=False)
    return numbered.select(*df.columns, "win", "is_closer")


def closed_windows(edges: DataFrame) -> DataFrame:
    """Number of the last closed window per channel (windows close in order)."""
    return edges.where("is_closer").groupBy("_ch").agg(F.max("win").alias("_closed"))


def state_after(edges: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """``ch, anchor, win`` after all rows; feed it to the next run as ``carry``."""
    opened = edges.where(~F.col("is_closer")).select(
        F.col("_ch").alias("ch"), F.col("_ms").alias("anchor"), "win"
    )
    if carry is not None:
        opened = opened.unionByName(carry.select(F.col("ch").cast("int").alias("ch"), "anchor", "win"))
    last = opened.groupBy("ch").agg(F.max_by("anchor", "win").alias("anchor"), F.max("win").alias("win"))
    done = closed_windows(edges).withColumnRenamed("_ch", "ch")
    still_open = F.when(F.coalesce(F.col("_closed") >= F.col("win"), F.lit(False)), None)
    return last.join(done, "ch", "left").select(
        "ch", still_open.otherwise(F.col("anchor")).alias("anchor"), "win"
    )
