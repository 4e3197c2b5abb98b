"""Questions that arrive as files, answered as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(folder)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: list[str] | None = None) -> StreamingQuery:
    """Appends the answers of each batch to path as JSON lines. A batch that is run again after a failure replaces its own folder. With `once`, columns that name a question, each question is answered once, in
    whatever batch or run it comes again: what was answered is part of the stream's state at checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").json(f"{path}/batch={number}")

    asked = questions.dropDuplicates(once) if once else questions
    return asked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
