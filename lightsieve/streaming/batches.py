"""Micro-batches that fail: tried again a few times, then their bad rows are set aside and the others go on.

A batch is written under its own number, so a batch that is tried again replaces what it left and its rows land
exactly once. How often a batch has failed is kept beside the checkpoint, so a restarted run knows. Nothing is skipped:
every row ends in the result or, with the reason, in the quarantine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Guarded:
    """A step over the rows of a stream, and what is known of rows that it can't do.

    ``error`` is null for a row that the step can do and a message for the others; it must not fail itself (try_
    functions). ``folder`` gets out, quarantine, failures and checkpoint.
    """

    step: Callable[[DataFrame], DataFrame]
    error: Column
    folder: str
    attempts: int = 2

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    def failures(self, spark: SparkSession) -> DataFrame:
        """(batch, reason): a row for each time that a batch failed."""
        schema = "batch long, reason string"
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/failures")
        return spark.read.schema(schema).parquet(f"{self.folder}/failures")

    def _process(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        failed = self.failures(spark).filter(F.col("batch") == number).count()
        if failed >= self.attempts:
            bad = batch.withColumn("reason", self.error).filter("reason is not null")
            bad.withColumn("attempts", F.lit(failed)).write.mode("overwrite").parquet(f"{self.folder}/quarantine/batch={number}")
            batch = batch.filter(self.error.isNull())
        try:
            self.step(batch).write.mode("overwrite").parquet(f"{self.folder}/out/batch={number}")
        except Exception as failure:
            reason = str(failure).splitlines()[0][:500] if str(failure) else type(failure).__name__
            spark.createDataFrame([(number, reason)], "batch long, reason string").write.mode("append").parquet(f"{self.folder}/failures")
            raise

    def run_once(self, stream: DataFrame) -> bool:
        """Processes what there is; false when a batch failed, which the next run tries again."""
        query = stream.writeStream.foreachBatch(self._process).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            return False
        return True

    def run(self, stream: DataFrame) -> int:
        """Runs until nothing is left; returns how many runs it took. A batch that fails without its bad rows, too, is an error."""
        spark, runs = stream.sparkSession, 1
        while not self.run_once(stream):
            runs += 1
            if not self.failures(spark).groupBy("batch").count().filter(F.col("count") > self.attempts).isEmpty():
                raise RuntimeError(f"a batch fails even without the rows that its guard knows: {self.folder}/failures")
        return runs

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}")
        except PySparkException:  # no batch has got so far
            return spark.createDataFrame([], f"{schema}, batch long")

    def out(self, spark: SparkSession, schema: str) -> DataFrame:
        """What the step gave, with the number of the batch."""
        return self._read(spark, "out", schema)

    def quarantine(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows that were set aside, as they came, with reason, attempts and the number of the batch."""
        return self._read(spark, "quarantine", f"{schema}, reason string, attempts int")
