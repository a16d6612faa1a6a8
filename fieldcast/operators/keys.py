"""Joins on keys that may be null.

A struct of the key columns is never null itself and equals another whose fields are alike,
nulls included. Grouping, windows and joins on it keep rows without a key, and share one
partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT = "_at"


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on the keys, where null meets null; the key columns are those of the left side."""
    rest = [c for c in right.columns if c not in keys]
    other = right.select(F.struct(*keys).alias(AT), *rest)
    return left.withColumn(AT, F.struct(*keys)).join(other, AT, how).drop(AT)
