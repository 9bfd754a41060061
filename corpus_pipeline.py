"""A corpus pipeline of five of the operators, from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; the last returns the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.llm import decontam, exact, mixing, quality, simhash
from lightsieve.session import discard, materialize, table


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text, doc): each row whole in ``doc``, whatever its columns are called, with a key of its own.

    Decisions are of rows, since ids may repeat or be null. Rows of files are keyed by their file and place in it,
    which every reader of the files finds alike; other rows are written once with a number.
    """
    parts = (F.col("doc_id"), F.col("text"), F.struct("*").alias("doc"))
    try:
        origin = docs.metadataColumn("_metadata")
        keyed = docs.select(F.concat(F.hex(F.xxhash64(origin["file_path"])), F.lit(":"), origin["row_index"]).alias("key"), *parts)
        keyed.schema  # resolves the columns
        return keyed
    except AnalysisException:
        return materialize(docs.select(F.monotonically_increasing_id().cast("string").alias("key"), *parts), "keyed")


def _of(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of keyed whose key is among keys, as they came."""
    return keyed.join(keys, "key", "left_semi").select("doc.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier rejects go; those of null or repeated id are scored one by one.

    Where the labels are too few to tell documents apart none goes.
    """
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), row_col="_row", one_kind="keep")
    return scored.filter("keep").select("_row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: of the largest doc_id, null being the least, that of the largest row key."""
    keyed = _keyed(docs)
    found = exact.deduplicate(keyed.select(F.struct("doc_id", "key").alias("at"), "text"), "at")
    return _of(keyed, found.filter("kept").select("at.key"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the smallest doc_id, null being the last, that of the smallest row key."""
    keyed = _keyed(docs)
    found = simhash.near_duplicates(keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("at"), "text"), "at")
    return _of(keyed, found.filter(F.col("at").eqNullSafe(F.col("component_id"))).select("at.key"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold too much of a benchmark item go, whatever other rows of their id hold."""
    keyed = _keyed(docs)
    found = decontam.decontaminate(keyed.select("key", "text"), table(spark, sf_dir, "benchmark"), "key")
    return _of(keyed, found.filter("not contaminated").select("key"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document with the number of copies that it gets."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mixing_stage),
]

#: The classifier and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # the table itself is left alone
    return STAGES[-1][1](spark, docs, sf_dir)
