"""Running row number per key, also for keys (or a whole table) too large for one task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.operators.lookup import HOT_ROWS, same_keys
from sluiceway.session import written


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ; null equals null and NaN equals NaN, as they do for Spark's keys."""
    if pa.types.is_nested(a.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], dtype=bool)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        both = pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True))
        missing = pc.xor(pc.is_null(a), pc.is_null(b))
        differ = pc.or_(pc.and_not(differ, both), missing)
    return differ.to_numpy(zero_copy_only=False)


def _sums_in_runs(keys: list[str], weight: str, name: str, edge: str):
    """Running sums of ``weight`` (null: 1) in runs of equal ``keys``, for one sorted range.

    ``edge`` is 1 for the first row of the range, 2 for the last, 3 for an only one, otherwise 0.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, held = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            mine = [batch.column(k) for k in keys]
            begins = np.zeros(n, dtype=bool)
            for i, column in enumerate(mine):
                ahead = column.slice(0, 1) if last is None else last[i]
                begins |= _differ(column, pa.concat_arrays([ahead, column.slice(0, n - 1)]))
            amount = pc.fill_null(batch.column(weight), 1).to_numpy(zero_copy_only=False)
            sums = np.cumsum(amount)
            # What each run's sums start from; the first entry is the run that began before this batch.
            base = np.concatenate([[-total], (sums - amount)[begins]])
            sums = sums - base[np.cumsum(begins)]
            last, total = [column.slice(n - 1, 1) for column in mine], int(sums[-1])
            edges = np.zeros(n, dtype=np.int32)
            edges[0] = held is None
            if held is not None:
                yield numbered(*held)
            held = batch, sums, edges
        if held is not None:
            held[2][-1] += 2
            yield numbered(*held)

    def numbered(batch: pa.RecordBatch, sums: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(edges)], [*batch.schema.names, name, edge])

    return add


def running_ordinal(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "ordinal",
    hot_rows: int = HOT_ROWS,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add ``name`` = 1, 2, 3, ... per key in the order of the columns ``order``.

    ``order`` must be unique within a key. No ``keys`` means one sequence over all rows. Rows with
    a null key are numbered like those of any other key. ``start`` (``keys, cnt``, one row per key)
    continues from numbers reached before: its rows go ahead of their key's and count ``cnt``.

    A window function sorts each key in one task, which fails for a key with a third of all rows.
    Here rows go to ranges of ``(keys, order)``, wherever a key begins or ends, are numbered from
    the first row that their key has in the range, and written once. Only the key that a range
    begins with may have rows in earlier ranges; their number comes from a table with one row per
    range, so that rows are shuffled once. There are as many ranges as shuffle partitions, and more
    if a range would pass ``hot_rows`` rows where that is set lower than usual. All columns pass
    through Arrow.
    """
    span, weight, local, edge, n, before = (f"{c}_{uuid.uuid4().hex[:8]}" for c in ("span", "weight", "local", "edge", "n", "before"))
    ranges = [] if hot_rows >= HOT_ROWS else [max(1, -(-df.count() // hot_rows))]
    rows = df.withColumn(weight, F.lit(None).cast("long"))
    if start is not None:
        ahead = start.select(*keys, F.col("cnt").cast("long").alias(weight))
        rows = rows.unionByName(ahead, allowMissingColumns=True)
    places = [*keys, *([] if start is None else [F.col(weight).isNull()]), *order]
    rows = rows.repartitionByRange(*ranges, *places).sortWithinPartitions(*places)
    rows = rows.withColumn(span, F.spark_partition_id())
    schema = rows.withColumns({local: F.lit(0).cast("long"), edge: F.lit(0)}).schema
    rows = written(rows.mapInArrow(_sums_in_runs(keys, weight, local, edge), schema), "ordinal-rows")
    ends = written(rows.where(F.col(edge) > 0).select(*keys, span, local, edge), "ordinal-ends")
    firsts = ends.where(F.col(edge) != 2).select(*keys, span, F.lit(0).cast("long").alias(local), F.lit(0).alias(n))
    lasts = ends.where(F.col(edge) >= 2).select(*keys, span, local, F.lit(1).alias(n))
    earlier = Window.partitionBy(*keys).orderBy(span, n).rowsBetween(Window.unboundedPreceding, -1)
    brought = firsts.unionByName(lasts).withColumn(before, F.sum(local).over(earlier)).where((F.col(n) == 0) & (F.col(before) > 0))
    numbered = same_keys(rows, written(brought.select(*keys, span, before), "ordinal-starts"), [*keys, span], "left")
    if start is not None:
        numbered = numbered.where(F.col(weight).isNull())
    total = F.col(local) + F.coalesce(before, F.lit(0).cast("long"))
    return numbered.select(*df.columns, total.alias(name))
