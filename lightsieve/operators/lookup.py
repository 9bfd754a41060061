"""Lookups, exclusions and incremental runs as joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rows: DataFrame, lookup: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Left join with the first lookup row of each key, by ``order``; null where there is none."""
    first = lookup.groupBy(key).agg(F.min_by(value, order).alias(value))
    return rows.join(first, key, "left")


def excluding(rows: DataFrame, key: str, *excluded: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Rows whose key is in no excluded table, or is allowed all the same."""
    gone = excluded[0].select(key)
    for more in excluded[1:]:
        gone = gone.unionByName(more.select(key))
    if allowed is not None:
        gone = gone.join(allowed.select(key), key, "left_anti")
    return rows.join(gone.distinct(), key, "left_anti")


def unprocessed(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """What an incremental run has left to do."""
    return rows.join(manifest.select(key), key, "left_anti")


def two_sources(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first source, then those of the second whose key the first has not; each row once."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(first.columns)).distinct()


def scan_excluding(files: DataFrame, key: str, excluded: DataFrame, allowed: DataFrame, formats: Iterable[str]) -> DataFrame:
    """Files of the given formats without those of an exclude list, unless they are allowed all the same."""
    return excluding(files.filter(F.col("ext").isin(*formats)), key, excluded, allowed=allowed)


def bare_path(path: str) -> Column:
    """A path without the scheme of local files, by which scans and lists of paths may differ."""
    return F.regexp_replace(path, "^file:/+", "/")
