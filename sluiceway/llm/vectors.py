"""What the vector operators share: valid rows, classes of equal vectors, bounded samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import stored


def usable(vector: str) -> Column:
    """True for vectors without null or non-finite components that are not zero or empty."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def with_key(df: DataFrame, vector: str, *more: str) -> DataFrame:
    """Adds ``key``, equal for rows with equal vectors and ``more`` columns; null if not usable."""
    same = F.sha2(F.to_json(F.struct(*more, F.col(vector).alias("v"))), 256)
    return df.withColumn("key", F.when(usable(vector), same))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.empty((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that very large or small values stay finite."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, of the vectors as they are given."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def bounded_sample(df: DataFrame, key: str, rows: int, columns: list[str]) -> pd.DataFrame:
    """At most ``rows`` rows, picked by the hash of ``key``, the same on every run."""
    return df.orderBy(F.xxhash64(F.lit("sample"), key)).limit(rows).select(*columns).toPandas()


def classes_of(rows: DataFrame, id_col: str, vector: str, *more: str, purpose: str) -> DataFrame:
    """One row per class of equal vectors: ``node, key, least, n`` and its vector, written once."""
    grouped = rows.where("key is not null").groupBy("key").agg(
        F.min(id_col).alias("least"), F.count("*").alias("n"),
        *[F.first(c).alias(c) for c in (*more, vector)],
    )
    return stored(grouped.withColumn("node", F.monotonically_increasing_id()), purpose)
