"""Session, and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if driver and executors are one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="skysift-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch_dir(spark: SparkSession) -> str:
    """A folder in the shared one for what this application writes between steps; it is deleted when the driver ends."""
    at = f"{shared_dir(spark)}/skysift/{spark.sparkContext.applicationId}"
    if at not in _SCRATCH:
        _SCRATCH.add(at)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), at)
    return at


_SCRATCH: set[str] = set()


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the driver ends, and its JVM may have ended before
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the scratch folder and read back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files behind stored() tables that nothing reads any more."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            _delete(df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), os.path.dirname(f))
