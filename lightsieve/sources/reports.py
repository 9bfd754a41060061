"""JSON reports as tables: who was excluded by which earlier stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.config import RAW_FORMATS

ENVELOPE = "process_date string, configuration string, processed_images array<struct<original_path:string,path:string,category:string,score:double>>, stats struct<total_processed:long>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, score) of all reports under a path; original_path counts before path."""
    rows = spark.read.schema(ENVELOPE).json(path).select(F.explode("processed_images").alias("p"))
    return rows.select(F.coalesce("p.original_path", "p.path").alias("path"), "p.category", "p.score")


def names(rows: DataFrame) -> DataFrame:
    """(category, name) that later stages look photos up by: base names, and for raw files the .png they were converted to."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    stem, ext = F.regexp_replace(base, r"\.[^.]*$", ""), F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    both = F.when(ext.isin(*RAW_FORMATS), F.array(base, F.concat(stem, F.lit(".png")))).otherwise(F.array(base))
    return rows.select("category", F.explode(both).alias("name")).distinct()


def delivered_groups(files: DataFrame) -> DataFrame:
    """(path, group_id, name, is_best) of files in folders group_<n>; the name comes without its BEST_ mark."""
    group, base = F.regexp_extract("path", r"(?:^|/)(group_\d+)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    return files.filter(group != "").select("path", group.alias("group_id"), F.regexp_replace(base, "^BEST_", "").alias("name"), base.startswith("BEST_").alias("is_best"))


def manifest(*parts: DataFrame) -> DataFrame:
    """What has been processed, by any report or folder scan: (path, category), each once."""
    union = parts[0].select("path", "category")
    for part in parts[1:]:
        union = union.unionByName(part.select("path", "category"))
    return union.distinct()


def last_group_number(groups: DataFrame, name: str = "group") -> DataFrame:
    """(last): the largest n among names group_<n>, 0 if there is none."""
    n = F.regexp_extract(name, r"group_(\d+)$", 1)
    return groups.agg(F.coalesce(F.max(F.when(n != "", n.cast("int"))), F.lit(0)).alias("last"))
