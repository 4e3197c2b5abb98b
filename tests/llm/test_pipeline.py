"""Every stage, and all of them in a row, on repeated, null, empty and clashing input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skysift.llm import decontamination, exact_dedup, near_duplicates, packing, quality

SCHEMA = "doc_id long, text string, __t string, __d2 int, __row string, kept boolean, n_words string"
ITEM = "the quick brown fox jumps over the lazy dog and then sleeps in the sun"
BODY = " ".join(f"word{k} other{k % 7}" for k in range(80))


def row(k, text):
    return (k, text, "t", 2, "r", None, "w")


ROWS = [row(1, "see: " + ITEM), row(1, "clean one"), row(None, "and " + ITEM), row(None, "clean none"), row(2, "clean two"), row(2, "clean two"), row(3, None), row(4, ""), row(5, "CLEAN two"), row(6, BODY), row(7, BODY + " tail"), row(7, BODY + " end"), row(8, "?!")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def left(df):
    assert df.schema.simpleString() == spark_schema
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


spark_schema = "struct<doc_id:bigint,text:string,__t:string,__d2:int,__row:string,kept:boolean,n_words:string>"


def test_decontamination_keeps_clean_rows_that_share_an_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expect = sorted(((r[0], r[1]) for r in ROWS if ITEM not in (r[1] or "")), key=repr)
    assert left(decontamination.clean(spark, docs, folder)) == expect


def test_exact_dedup_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [(2, "clean two"), (2, "clean two"), (3, None)]
    expect = [(r[0], r[1]) for r in ROWS]
    for x in gone:
        expect.remove(x)
    assert left(exact_dedup.clean(spark, docs, folder)) == sorted(expect, key=repr)


def test_near_duplicates_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = left(near_duplicates.clean(spark, docs, folder))
    assert len([x for x in got if (x[1] or "").startswith(BODY)]) == 1
    assert len([x for x in got if x[0] in (3, 4, 8)]) == 3 and (None, "clean none") in got
    assert len([x for x in got if (x[1] or "").lower() == "clean two"]) == 1


def test_quality_stage_without_labels_keeps_all(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert left(quality.clean(spark, docs, folder)) == sorted(((r[0], r[1]) for r in ROWS), key=repr)


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run_is_the_composition_of_its_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (quality.clean, exact_dedup.clean, near_duplicates.clean, decontamination.clean):
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_duplicates", "decontamination", "packing"]
    expect = sorted(map(repr, packing.pack(docs).drop("sequence_id", "offset").collect()))
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, got.drop("sequence_id", "offset").collect())) == expect
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
