"""Checks of a delivery: duplicates that leaked, orphans, missing categories, statistics, and the fix."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightsieve.operators.skew import splittable_join


def duplicate_leaks(delivered: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """(group, n_delivered, first): groups with more than one delivered member."""
    return delivered.join(groups.select(key, group), key).groupBy(group).agg(F.count("*").alias("n_delivered"), F.min(key).alias("first")).filter("n_delivered > 1")


def orphans(delivered: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """Delivered rows in no category and no group."""
    union = known[0].select(key)
    for more in known[1:]:
        union = union.unionByName(more.select(key))
    return delivered.join(union.distinct(), key, "left_anti")


def _values(df: DataFrame, name: str, values: Iterable[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def missing_categories(rows: DataFrame, column: str, expected: Iterable[str]) -> DataFrame:
    return _values(rows, column, expected).join(rows.select(column).distinct(), column, "left_anti")


def statistics(rows: DataFrame, column: str, expected: Iterable[str]) -> DataFrame:
    """(column, n): counts of the expected categories, 0 where there is none."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return _values(rows, column, expected).join(counted, column, "left").fillna(0, ["n"])


def status(*violations: DataFrame) -> tuple[int, str]:
    total = sum(v.count() for v in violations)
    return total, "PASS" if total == 0 else "FAIL"


def to_remove(delivered: DataFrame, groups: DataFrame, scores: DataFrame, key: str, group: str, score: str) -> DataFrame:
    """Delivered members of a group other than its best: highest score (0 if unknown), the first key on ties."""
    scored = delivered.join(groups.select(key, group), key).join(scores.select(key, score), key, "left").fillna(0, [score])
    best = scored.groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("lower"), key))[key].alias("_best"))
    return splittable_join(scored, best, [group]).filter(F.col(key) != F.col("_best")).select(group, key, score)


def _plain(path) -> Column:
    """The path without the mark of a best photo."""
    return F.regexp_replace(path, r"(^|/)BEST_([^/]*)$", "$1$2")


def inspect(delivered: DataFrame, groups: DataFrame, categories: DataFrame, expected: Iterable[str]) -> DataFrame:
    """(check, item, n): all violations of a delivery as one table.

    delivered: (path); groups: (path, group_id); categories: (path, category). Checks: duplicates (several delivered
    members of a group), orphans (in no category and no group), missing categories. A file named BEST_<name> is the
    photo <name> in all of them.
    """
    plain = delivered.select(_plain("path").alias("path"), F.col("path").alias("item"))
    leaks = duplicate_leaks(plain, groups.select(_plain("path").alias("path"), "group_id").distinct(), "path", "group_id").select(F.lit("duplicates").alias("check"), F.col("group_id").cast("string").alias("item"), F.col("n_delivered").alias("n"))
    known = [x.select(_plain("path").alias("path")) for x in (categories, groups)]
    lost = orphans(plain, "path", *known).select(F.lit("orphans").alias("check"), "item", F.lit(1).cast("long").alias("n"))
    missing = missing_categories(categories, "category", expected).select(F.lit("missing categories").alias("check"), F.col("category").alias("item"), F.lit(0).cast("long").alias("n"))
    return leaks.unionByName(lost).unionByName(missing)


def fix(delivered: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return delivered.join(removed.select(key), key, "left_anti")
