"""Deliveries as tables in parts, and their repair in place.

A delivery is partitioned by a number that its groups are dealt to, so surplus duplicates of a group lie in one part.
A repair reads and writes only the parts that hold something to remove: Spark replaces these partitions when the job
commits (dynamic overwrite), all other files stay as they are, and a repair that finds nothing writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.operators import audit
from lightsieve.session import discard, materialize, settings

PART = "part"
PARTS = 64


def write_delivery(rows: DataFrame, path: str, group: str, parts: int = PARTS) -> None:
    """Writes rows by the part of their group; rows without a group are dealt by all their columns."""
    by = F.coalesce(F.xxhash64(F.col(group)), F.lit(0)) if group in rows.columns else F.xxhash64(*rows.columns)
    spread = F.when(F.col(group).isNull(), F.xxhash64(*rows.columns)).otherwise(by) if group in rows.columns else by
    dealt = rows.withColumn(PART, F.pmod(spread, F.lit(parts)).cast("int"))
    dealt.hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(path)


def read_delivery(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remove_in_place(spark: SparkSession, path: str, removed: DataFrame, key: str) -> tuple[int, list[int]]:
    """(rows removed, parts written): takes the rows whose key is among removed out of a delivery, and writes no other part.

    What stays of the affected parts is written to the shared folder first, since a part can't be read while it is
    replaced; if that fails the delivery is as it was. A part of which nothing stays is deleted. Running it again with
    the same keys removes nothing and writes nothing.
    """
    delivered = read_delivery(spark, path)
    gone = removed.select(key).distinct()
    counts = delivered.join(gone, key, "left_semi").groupBy(PART).agg(F.count("*").alias("n")).collect()  # a row a part
    affected = sorted(r[PART] for r in counts)
    if not affected:
        return 0, []
    stays = materialize(delivered.filter(F.col(PART).isin(affected)).join(gone, key, "left_anti"), "stays")
    left = {r[PART] for r in stays.select(PART).distinct().collect()}
    with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        stays.hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(path)
    for part in set(affected) - left:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={part}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    discard(stays)
    spark.catalog.refreshByPath(path)
    return sum(r["n"] for r in counts), affected


def fix_in_place(spark: SparkSession, path: str, groups: DataFrame, scores: DataFrame, key: str, group: str, score: str, dry_run: bool = False) -> tuple[int, list[int]]:
    """Leaves of each group its best delivered member: highest score, 0 if unknown, the first key on ties."""
    surplus = audit.to_remove(read_delivery(spark, path).select(key), groups, scores, key, group, score)
    return (surplus.count(), []) if dry_run else remove_in_place(spark, path, surplus, key)
