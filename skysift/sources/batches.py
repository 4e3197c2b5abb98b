"""Tables that grow by batches: each batch is a folder of its own, and counts from the moment its write has succeeded.

A write that dies leaves a folder without the mark of success; readers pass over it, so a half batch is never taken for a whole one, and
writing again is safe.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DONE = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(spark: SparkSession, path: str) -> bool:
    """Whether path holds a table whose write has succeeded."""
    files, at = _at(spark, f"{path}/{DONE}")
    return files.exists(at)


def files_below(spark: SparkSession, path: str) -> list[str]:
    """All files in path and below, those without bytes included, which Spark's readers pass over."""
    files, at = _at(spark, path)
    found, out = files.listFiles(at, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of all batches that count, in the order of their names."""
    files, at = _at(spark, path)
    if not files.exists(at):
        return []
    found = [x.getPath().toString() for x in files.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith("batch-")]
    return sorted(x for x in found if written(spark, x))


def add_batch(df: DataFrame, path: str) -> str:
    """Writes df as one more batch of path; its folder."""
    folder = f"{path}/batch-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches that count; without any an empty table."""
    found = batches(spark, path)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def create(df: DataFrame, path: str) -> bool:
    """Writes df as a table unless one is there already; says whether it wrote. What a write that died has left is replaced."""
    if written(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True
