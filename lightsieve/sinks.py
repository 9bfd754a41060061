"""Sinks: partitioned tables in place of category folders, and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_categories(rows: DataFrame, path: str, column: str = "category", mode: str = "overwrite") -> None:
    """One partition a category (or group, or tier); readers prune by it."""
    rows.write.mode(mode).partitionBy(column).parquet(path)


def write_groups(members: DataFrame, path: str, group: str = "group_id", best: str = "best") -> None:
    """Partitioned by group; is_best marks the member that the group's best column names."""
    members.withColumn("is_best", F.col("path") == F.col(best)).write.mode("overwrite").partitionBy(group).parquet(path)


def report(rows: DataFrame, configuration: str = "{}") -> DataFrame:
    """(category, report): one JSON envelope for each category, without listing its rows in one place."""
    stats = rows.groupBy("category").agg(F.count("*").alias("total_processed"))
    envelope = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("process_date"), F.lit(configuration).alias("configuration"), F.struct("total_processed").alias("stats"))
    return stats.select("category", F.to_json(envelope).alias("report"))


def write_report(rows: DataFrame, path: str, configuration: str = "{}") -> None:
    """Reports beside their rows, as reports.read_reports() reads them: JSON lines of one processed image each, and one envelope a category."""
    envelope = rows.select("category", F.array(F.struct(F.col("path").alias("original_path"), "path", "category", *(["score"] if "score" in rows.columns else []))).alias("processed_images"))
    envelope.write.mode("overwrite").partitionBy("category").json(f"{path}/rows")
    report(rows, configuration).write.mode("overwrite").json(f"{path}/reports")


def summary(rows: DataFrame, stage: str) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "category", "n")
