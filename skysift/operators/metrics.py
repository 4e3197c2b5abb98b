"""Counts of a run, taken while it runs: what comes into a stage, what leaves it, and whatever conditions a stage names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, stage string, metric string, value long"


class Run:
    """The stages of one run. Counting costs no job of its own: it is part of the job that reads the stage, and table() waits for that."""

    def __init__(self, name: str):
        self.name, self.stages = name, []

    def watch(self, df: DataFrame, stage: str, **conditions: Column) -> DataFrame:
        """df, whose rows are counted as `rows`, and those of each condition by its name."""
        seen = Observation(f"{self.name}/{stage}")
        self.stages.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()))

    def table(self, spark: SparkSession) -> DataFrame:
        """(run, stage, metric, value) of all stages, each of which has to be read before."""
        rows = [(self.name, stage, metric, value) for stage, seen in self.stages for metric, value in seen.get.items()]
        return spark.createDataFrame(rows, SCHEMA).coalesce(1)

    def write(self, spark: SparkSession, path: str) -> None:
        """Appends the run's table to the one at path."""
        self.table(spark).write.mode("append").parquet(path)
