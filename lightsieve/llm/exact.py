"""Exact deduplication as a streaming job with disk-backed keyed state.

The stream carries one small record a document: digest, stable identifier and content locator (the file that
holds the row). The state, kept in RocksDB without expiry, retains for each digest the largest identifier with
its locator and the number of records. The texts of digest hits are then compared in full, by the least and the
greatest of each digest, which are taken in every task before the shuffle; texts that share a digest and differ are
grouped by their full content instead. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.operators.skew import splittable_join
from lightsieve.session import materialize, shared_path

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # state is spread over as many stores as there are partitions; none of them reserves disk ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    bytes_per_trigger: int = 8 << 30,
) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256, keep_locator), one row for each input row.

    Null counts as the empty text. Of equal texts the largest id stays; null ids stay only where a group has no
    other id, and then all of them are kept. Rows that repeat both id and text count in group_size, and each is
    marked as the kept document is. keep_locator names the file that holds the kept row. Texts are digested and
    compared whole, however long. An empty table gives no rows. Other columns are ignored, whatever their names.

    ``digest`` may be weak: hits are checked on full bytes. ``bytes_per_trigger`` sets the size of a micro-batch.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.input_file_name().alias("locator")).withColumn("digest", digest(F.col("text")))
    feed = materialize(rows.select("id", "digest", "locator", sha256_hex(F.col("text")).alias("sha")), "feed")
    state = materialize(_retained(spark, feed, bytes_per_trigger), "state-rows")
    differing = _differing(rows, state)

    columns = ("id", "keep_id", "group_size", "sha", "keep_locator")
    assigned = splittable_join(feed.drop("locator"), state, ["digest"])
    if differing.isEmpty():
        result = assigned.select(*columns)
    else:
        again = rows.join(differing, "digest", "left_semi")
        groups = again.groupBy("text").agg(F.max("id").alias("keep_id"), F.max(F.struct("id", "locator"))["locator"].alias("keep_locator"), F.count("*").alias("group_size"))
        result = assigned.join(differing, "digest", "left_anti").select(*columns)
        result = result.unionByName(splittable_join(again.drop("locator"), groups, ["text"]).withColumn("sha", sha256_hex(F.col("text"))).select(*columns))
    return result.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "keep_locator",
    )


def _retained(spark: SparkSession, feed: DataFrame, bytes_per_trigger: int) -> DataFrame:
    """(digest, keep_id, keep_locator, group_size): the state after all records of the feed."""
    feed_path = feed.inputFiles()[0].rsplit("/", 1)[0]
    out = shared_path(spark, "retained")
    stream = spark.readStream.schema(feed.schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(feed_path)
    state = stream.groupBy("digest").agg(F.max("id").alias("keep_id"), F.max(F.struct("id", "locator")).alias("at"), F.count("*").alias("group_size"))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.select("digest", "keep_id", F.col("at.locator").alias("keep_locator"), "group_size").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _settings(spark, STATE_SETTINGS):
        query = state.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "state")).foreachBatch(store).trigger(availableNow=True).start()
        query.awaitTermination()
    store(spark.createDataFrame([], state.schema), -1)
    schema = "digest string, keep_id " + feed.schema["id"].dataType.simpleString() + ", keep_locator string, group_size long, batch int"
    updates = spark.read.schema(schema).parquet(out)
    last = F.max_by(F.struct("keep_id", "keep_locator", "group_size"), "batch").alias("last")
    return updates.groupBy("digest").agg(last).select("digest", "last.*")


def _differing(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests that stand for several texts. Of the texts of a hit only the least and the greatest go on from a task."""
    hits = splittable_join(rows.select("digest", "text"), state.filter("group_size > 1").select("digest"), ["digest"], "left_semi")
    return materialize(hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most").select("digest"), "differing")


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
