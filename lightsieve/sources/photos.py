"""Photo tables: from a directory tree, from decoded images, and from the events table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.config import RAW_FORMATS, STANDARD_FORMATS


def path_parts(path: Column) -> dict[str, Column]:
    """basename, stem, ext (lower case, empty without a dot) and dir of a path."""
    basename = F.regexp_extract(path, r"([^/]*)$", 1)
    return {
        "basename": basename,
        "stem": F.regexp_replace(basename, r"\.[^.]*$", ""),
        "ext": F.lower(F.regexp_extract(basename, r"\.([^.]*)$", 1)),
        "dir": F.regexp_replace(path, r"/?[^/]*$", ""),
    }


def supported(*formats: Iterable[str]) -> list[str]:
    """Union of format lists: lower case, no dots, each once."""
    return list(dict.fromkeys(f.lower().lstrip(".") for group in formats for f in group))


def scan(spark: SparkSession, root: str, formats: Iterable[str] = (*STANDARD_FORMATS, *RAW_FORMATS), recursive: bool = True) -> DataFrame:
    """Files of the given formats, whatever the case of their extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "modificationTime", "length")
    return files.withColumns(path_parts(F.col("path"))).filter(F.col("ext").isin(supported(formats)))


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images as (path, height, width, channels, data); files that do not decode are left out."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)
    return found.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def undecodable(files: DataFrame, decoded: DataFrame) -> DataFrame:
    """Scanned files that are no row of the decoded images: the error category."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.withColumn("_p", bare(F.col("path"))).join(decoded.select(bare(F.col("path")).alias("_p")), "_p", "left_anti").drop("_p")


def route(files: DataFrame) -> DataFrame:
    """status raw, standard or other by extension."""
    return files.withColumn("status", F.when(F.col("ext").isin(*RAW_FORMATS), "raw").when(F.col("ext").isin(*STANDARD_FORMATS), "standard").otherwise("other"))


def has_raw(files: DataFrame) -> bool:
    return not files.filter(F.col("ext").isin(*RAW_FORMATS)).isEmpty()


def photos_from_events(events: DataFrame) -> DataFrame:
    """(ord, album, ts, score, ok, faces, moments): one album a day, in file order ``ord``."""
    user, kind = F.col("user_id"), F.col("event_id") % 3
    none = F.array().cast("array<bigint>")
    faces = F.when(kind == 0, none).when(kind == 1, F.array(user)).otherwise(F.array(user, (user * 7) % 150))
    return events.select(
        F.col("event_id").alias("ord"),
        F.date_format("ts", "yyyy-MM-dd").alias("album"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("score"),
        (F.col("event_type") != "error").alias("ok"),
        faces.alias("faces"),
        F.array("event_type").alias("moments"),
    )
