"""32-bit hash codes that agree with the JVM's ``hashCode`` of strings and longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def _signed32(x: Column) -> Column:
    low = x.bitwiseAND(F.lit(_MASK))
    return F.when(low >= 2**31, low - F.lit(2**32)).otherwise(low)


def long_hash(value: Column) -> Column:
    """Upper and lower half of a long, combined by exclusive or."""
    value = value.cast("long")
    return _signed32(value.bitwiseXOR(F.shiftrightunsigned(value, 32)))


def string_hash(value: Column) -> Column:
    """Polynomial hash, base 31, over UTF-16 units: the JVM's own, called directly."""
    code = F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), value).cast("long")
    return F.when(value.isNotNull(), code)


def key_hash(value: Column, data_type: str) -> Column:
    """Hash code of a key of the given Spark type name."""
    if data_type == "string":
        return string_hash(value)
    if data_type == "bigint":
        return long_hash(value)
    if data_type in ("int", "smallint", "tinyint"):
        return value.cast("long")
    raise TypeError(f"no hash code rule for keys of type {data_type}")
