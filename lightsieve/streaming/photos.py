"""The photo stream: incremental runs, windows over event time, and deduplication, with checkpoints for resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.session import shared_path

LATE = "10 minutes"


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 25) -> DataFrame:
    """A Parquet table as a stream, some files a micro-batch; event time becomes a zoned timestamp."""
    schema = spark.read.parquet(path).schema
    # as a pattern, since the source takes a plain path for a directory and the table may be one file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def run_available(stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Processes what there is, in micro-batches, into a Parquet table; with the same checkpoint a later run goes on."""
    spark = stream.sparkSession
    out = shared_path(spark, label) if checkpoint is None else f"{checkpoint}-out"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint or shared_path(spark, f"{label}-state")).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_latest(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Processes what there is in update mode; of each key the row of the last micro-batch that changed it.

    The aggregate must have no watermark: then no row is too late, in whatever order the files come, and its state
    keeps every key.
    """
    spark = stream.sparkSession
    out = shared_path(spark, label)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, f"{label}-state")).foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    store(spark.createDataFrame([], stream.schema), -1)
    values = [c for c in stream.columns if c not in keys]
    updates = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls work once for each micro-batch; a failed batch is tried again by the next run, none is skipped."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(photos: DataFrame, width: str = "1 hour", ts: str = "ts", value: str = "value", late: str | None = LATE) -> DataFrame:
    """(window_start, n, total), from batch or stream alike; without ``late`` a stream drops no row and keeps all windows."""
    timed = photos.withWatermark(ts, late) if photos.isStreaming and late else photos
    return timed.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), "n", "total")


def session_gaps(photos: DataFrame, key: str, gap: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(key, session_start, n): runs of photos of a key with less than a gap between neighbours."""
    timed = photos.withWatermark(ts, LATE) if photos.isStreaming else photos
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), "n")


def once(photos: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The first row of each key; a stream keeps keys for as long as late rows may come."""
    return photos.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key]) if photos.isStreaming else photos.dropDuplicates([key])
