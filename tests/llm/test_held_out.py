"""Accuracy on rows that nothing was learned from."""

import os

import pytest
from pyspark.sql import functions as F

from skysift.llm import language, quality

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def kept_by_grade(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rated = quality.graded(labels.where(held))
    got = quality.classify(docs, labels.where(~held)).join(rated, "doc_id")
    return {r.grade: r.kept for r in got.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are needed")
@pytest.mark.parametrize("grades", [(2,), pytest.param((0, 1), marks=pytest.mark.xfail(reason="open: learned from 330 rows, 1 of 6 toxic and 4 of 10 low ones are kept here"))])
def test_quality_on_held_out_labels(spark, grades):
    kept = kept_by_grade(spark, SF)
    for g in grades:
        assert kept[g] >= 0.95 if g == 2 else kept[g] <= 0.1, kept


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the driver's tables are needed")
def test_quality_on_more_held_out_labels(spark):
    kept = kept_by_grade(spark, LARGER)  # 97 toxic, 109 low and 619 good rows
    assert kept[0] <= 0.02 and kept[1] <= 0.02 and kept[2] >= 0.98, kept


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are needed")
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).where("held_out AND lang_pred != 'und'").join(docs.select("doc_id", "lang").where("lang IS NOT NULL"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first().right >= 0.95
