"""Statistics that a run collects while it does its work, instead of reading its result again.

The counts of all stages are metrics that Spark observes on the rows as they pass. A batch run has them when its
action ends, a stream for each micro-batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "/"


@dataclass
class StageStatistics:
    """stages: the category of a row in each stage, with the categories that are counted; others are counted together.

    A row whose category is null is not counted in that stage. Metrics are named ``<stage>/<category>``.
    """

    stages: dict[str, tuple[Column, tuple[str, ...]]]
    name: str = "stages"
    others: str = "other"
    observation: Observation | None = field(default=None, init=False)

    def metrics(self) -> list[Column]:
        found = [F.count(F.lit(1)).alias("rows")]
        for stage, (category, expected) in self.stages.items():
            found += [F.count_if(category == value).alias(f"{stage}{SEPARATOR}{value}") for value in expected]
            found.append(F.count_if(~category.isin(*expected)).alias(f"{stage}{SEPARATOR}{self.others}"))
        return found

    def watch(self, rows: DataFrame) -> DataFrame:
        """The same rows; whatever action runs over them first fills in the counts."""
        if rows.isStreaming:
            return rows.observe(self.name, *self.metrics())
        self.observation = Observation()
        return rows.observe(self.observation, *self.metrics())

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, category, n) of the batch run, without categories that no row has. Waits for the action."""
        return self._table(spark, self.observation.get)

    def of_stream(self, query) -> DataFrame:
        """(stage, category, n) over the micro-batches that the query still reports."""
        total: dict[str, int] = {}
        for progress in query.recentProgress:
            row = progress.observedMetrics.get(self.name)
            for metric, n in row.asDict().items() if row is not None else ():
                total[metric] = total.get(metric, 0) + n
        return self._table(query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active(), total)

    def _table(self, spark: SparkSession, found: dict[str, int]) -> DataFrame:
        rows = [(*metric.split(SEPARATOR, 1), n) for metric, n in found.items() if SEPARATOR in metric and n]
        return spark.createDataFrame(rows, "stage string, category string, n long")
