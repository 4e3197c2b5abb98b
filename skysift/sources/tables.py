"""Readers and writers: questions, answers, metadata, vector stores, images and settings."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.sources.batches import create

QUESTION = T.StructType([T.StructField(n, T.StringType()) for n in ("Question_id", "Task", "Subtask", "Category", "Text", "Image")] + [T.StructField("Answer choices", T.ArrayType(T.StringType())), T.StructField("Ground truth", T.StringType()), T.StructField("gt_toi", T.ArrayType(T.DoubleType())), T.StructField("output", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_or_many(c: Column) -> Column:
    """A string, or a JSON array of strings, as an array."""
    return F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions or answers from .jsonl (one object a line) or .json (an array); other suffixes are refused."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError(f"{path}: neither .json nor .jsonl")
    return named(spark.read.schema(QUESTION).json(path, multiLine=path.endswith(".json")))


def named(questions: DataFrame) -> DataFrame:
    """Rows of QUESTION under the names that the operators use; one true answer or several are an array."""
    names = {"Question_id": "question_id", "Task": "task", "Subtask": "subtask", "Category": "category", "Text": "text", "Image": "image", "Answer choices": "answer_choices"}
    return questions.withColumnsRenamed(names).withColumn("ground_truth", one_or_many(F.col("Ground truth"))).drop("Ground truth")


def write_answers(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, paths: list[str], schema: str = "file_name string, text string") -> DataFrame:
    """CSV files with a header, one after the other."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(paths)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, length) of jpg and png files in all folders below."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.where(F.lower("path").rlike("(jpg|png)$")).select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "length")


def png_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height) from the headers of PNG files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return found.select("path", number(17).alias("width"), number(21).alias("height"))


def open_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, pixels) of all images that Java can read in the folders below: three bytes a pixel, red, green, blue, row by row. Grey images are spread to three
    channels and transparency is dropped; files that are no images are left out."""
    found = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder)

    def rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                channels = np.frombuffer(data, np.uint8).reshape(-1, n)
                out.append(np.repeat(channels, 3, 1).tobytes() if n == 1 else np.ascontiguousarray(channels[:, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["path", "width", "height", "pixels"])

    rows = found.select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.data", "image.nChannels")
    return rows.mapInArrow(rgb, "path string, width int, height int, pixels binary")


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, 3) of bytes."""
    h, w, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def list_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(folder): those below that hold images."""
    return list_images(spark, folder).select("folder").distinct()


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(img_name, feat) shards of a folder, names without their folders."""
    return spark.read.parquet(path).withColumn("img_name", F.element_at(F.split("img_name", "/"), -1))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(img_name, label, feat) shards of a folder."""
    return spark.read.parquet(path)


def write_store(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def create_labels(df: DataFrame, path: str) -> bool:
    """Writes the label vectors unless a whole table is there already; says whether it wrote."""
    return create(df, path)


def missing(requested: DataFrame, cached: DataFrame, on: list[str]) -> DataFrame:
    """What isn't cached yet."""
    return requested.join(cached.select(*on).distinct(), on, "left_anti")


def joined_metadata(shards: DataFrame, metadata: DataFrame) -> DataFrame:
    """shards (img_name, ...) with text of metadata (pos, img_name, text), the last row of a name counting; a name without text is an error."""
    last = metadata.groupBy("img_name").agg(F.max_by("text", "pos").alias("text"))
    found = shards.join(last, "img_name", "left")
    return found.withColumn("text", F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no text for "), F.col("img_name")))).otherwise(F.col("text")))


def load_settings(path: str, **given: object) -> dict:
    """Settings of a YAML file; values given here win."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return (yaml.safe_load(f) or {}) | {k: v for k, v in given.items() if v is not None}
