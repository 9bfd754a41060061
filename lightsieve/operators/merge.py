"""Stages that analyse the same photos, run apart and merged into one row a photo; errors are values.

A stage is a function from the photos to a table with their key. It may leave photos out, and give some an ``error``
instead of a result. A stage that can't be planned at all gives every photo its error, so one stage never stops the
others. The tables of all stages meet in full outer joins, in pairs, so that no table is shuffled more often than the
logarithm of the number of stages.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def error_where(condition: Column, message: str) -> Column:
    """The message where the condition holds, no error elsewhere."""
    return F.when(condition, F.lit(message))


def run_stages(rows: DataFrame, stages: dict[str, Stage], key: str = "path") -> dict[str, DataFrame]:
    """The table of each stage: (key, results, error). Spark computes nothing yet."""
    return {name: _run(rows, stage, key) for name, stage in stages.items()}


def _run(rows: DataFrame, stage: Stage, key: str) -> DataFrame:
    try:
        found = stage(rows)
        found.schema  # resolves the columns
    except (PySparkException, ValueError, KeyError, TypeError) as failure:
        return rows.select(key, F.lit(f"{type(failure).__name__}: {str(failure).splitlines()[0] if str(failure) else ''}").alias("error"))
    return found if "error" in found.columns else found.withColumn("error", F.lit(None).cast("string"))


def _struct(name: str, found: DataFrame, key: str) -> DataFrame:
    """(key, name): what a stage gives for a key as one struct; of several rows the least without an error, if there is one."""
    values = [F.col(f"`{c}`") for c in found.columns if c != key]
    least = F.min(F.struct(F.col("error").isNotNull().alias("failed"), F.struct(*values).alias("result")))
    return found.groupBy(key).agg(least["result"].alias(name))


def full_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two tables of one row a key; null keys meet, too."""
    other = right.withColumnRenamed(key, "_other")
    joined = left.join(other, left[key].eqNullSafe(other["_other"]), "full")
    both = F.coalesce(F.col(key), F.col("_other"))
    return joined.select(both.alias(key), *[c for c in left.columns if c != key], *[c for c in right.columns if c != key])


def merge_stages(tables: dict[str, DataFrame], key: str = "path") -> DataFrame:
    """(key, one struct a stage, n_results, errors): one row for each key that any stage has.

    The struct is null where the stage has no row of the key. n_results counts the stages without error, errors maps
    the others that have a row to their messages. Results must be of types that have an order.
    """
    parts: Sequence[DataFrame] = [_struct(name, found, key) for name, found in tables.items()]
    while len(parts) > 1:
        parts = [full_merge(*parts[i : i + 2], key) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    names = list(tables)
    failed = [F.struct(F.lit(n).alias("key"), F.col(f"{n}.error").alias("value")) for n in names]
    fine = sum((F.when(F.col(n).isNotNull() & F.col(f"{n}.error").isNull(), 1).otherwise(0) for n in names), F.lit(0))
    return parts[0].select(key, *names, fine.alias("n_results"), F.map_from_entries(F.filter(F.array(*failed), lambda e: e["value"].isNotNull())).alias("errors"))
