"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splittable_join(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join of rows with one row a key, in which Spark can split the rows of a hot key over tasks.

    Adaptive execution splits a large partition of a join only where both sides come straight from a shuffle. An
    aggregate on the join keys needs no shuffle of its own, so the join would read it in place and stay whole. One
    more key, the same on both sides, asks for that shuffle of the small side.
    """
    same = F.pmod(F.xxhash64(*keys), F.lit(1))
    return rows.withColumn("_same", same).join(small.withColumn("_same", same), [*keys, "_same"], how).drop("_same")
