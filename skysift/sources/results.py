"""A folder of result files, one file a run, as one table: a file counts whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.functions import text as X
from skysift.operators import evaluation as E
from skysift.operators.metrics import Run
from skysift.sources import tables as S
from skysift.sources.batches import files_below

BAD = "__unreadable"
NAME = r"([^/=]+\.jsonl)(?:/[^/]*)?$"  # a file, or a folder of part files that a writer has made in its place
REPORTED = ("position", "color", "count")


def name_of(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, NAME, 1))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(file, task, subtask, category, choices, truth, output, unreadable) of all lines of all .jsonl files in folder and below. unreadable is a line that is no JSON object, or lacks what an answer needs; a file
    without lines has one row that is null but for file."""
    schema = T.StructType([*S.QUESTION.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.schema(schema).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", BAD).json(folder)
    rows = lines.withColumn("file", name_of(F.col("_metadata.file_path"))).where("file != ''")
    truth = S.one_or_many(F.col("Ground truth"))
    needed = ["Task", "Subtask", "Category", "Answer choices", "Ground truth", "output"]
    lacking = F.concat_ws(", ", *(F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n in needed))
    unreadable = F.coalesce(BAD, F.when(lacking != "", F.concat(F.lit("without "), lacking)))
    rows = rows.select("file", F.col("Task").alias("task"), F.col("Subtask").alias("subtask"), F.col("Category").alias("category"), F.col("Answer choices").alias("choices"), truth.alias("truth"), "output", unreadable.alias("unreadable"))
    paths = spark.createDataFrame([(x,) for x in files_below(spark, folder)], "path string")  # one a run
    there = paths.select(name_of(F.col("path")).alias("file")).where("file != ''").distinct()
    return there.join(rows, "file", "left")


def sweep(results: DataFrame, items: int, task: str = "Perception", subtask: str = "Remote Sensing", run: Run | None = None) -> DataFrame:
    """(file, patch_method, encoder_name, path_T, lrsd_T, crsd_T, reduce_fn, position, color, count, accuracy, n, reason) of each file of read_results(): accuracies of the task's items in all and by category, and why the file
    doesn't count: lines that can't be read, a name that says no parameters, a category without items, or another number of items than `items`. Files that
    count have no reason. With a run its stages `lines` and `files` are counted."""
    results = run.watch(results, "lines", unreadable=F.col("unreadable").isNotNull()) if run else results
    whole = F.col("unreadable").isNull() & F.col("task").isNotNull()
    own = whole & (F.col("task") == task) & (F.col("subtask") == subtask)
    judged = E.judged(results)
    right = lambda which: F.try_divide(F.sum(F.when(which, F.col("is_true"))), F.count(F.when(which, 1)))
    by = judged.groupBy("file").agg(
        F.count("unreadable").alias("__bad"), F.count(F.when(whole, 1)).alias("__lines"), F.count(F.when(own, 1)).alias("n"), right(own).alias("accuracy"),
        *(right(own & (F.col("category") == c)).alias(c) for c in REPORTED),
    )
    parts = X.result_parts(F.col("file"))
    unnamed = F.concat(*(v.isNull().cast("string") for v in parts.values())).contains("true") | F.concat_ws("", *(F.when(parts[n].try_cast("double").isNull(), "x") for n in ("path_T", "lrsd_T", "crsd_T"))).contains("x")
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in REPORTED))
    reason = (
        F.when(F.col("__bad") > 0, F.concat(F.col("__bad").cast("string"), F.lit(" unreadable lines")))
        .when(F.col("__lines") == 0, "empty")
        .when(unnamed, "no parameters in its name")
        .when(missing != "", F.concat(F.lit("no items of "), missing))
        .when(F.col("n") != items, F.concat(F.col("n").cast("string"), F.lit(f" items, not {items}")))
    )
    numbers = {n: v.try_cast("double") if n.endswith("_T") else v for n, v in parts.items()}
    made = by.select("file", *(v.alias(n) for n, v in numbers.items()), *REPORTED, "accuracy", "n", reason.alias("reason"))
    return run.watch(made, "files", dropped=F.col("reason").isNotNull()) if run else made
