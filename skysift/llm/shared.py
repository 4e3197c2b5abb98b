"""Tables, the shared folder and size checks that the operators have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.session import drop_stored, stored  # noqa: F401  what the operators write between steps

#: Rows of at most a few dozen bytes that may be broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is proven to have at most so many rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts of ASCII alone take the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def row_tag(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def by_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right's other columns on doc_id (null equals null) and the row tag __t."""
    right = right.withColumnsRenamed({"doc_id": "__d2", "__t": "__t2"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("__d2")) & (F.col("__t") == F.col("__t2")), how).drop("__d2", "__t2")


def without(docs: DataFrame, tag: Column, judged: DataFrame, once: bool = True) -> DataFrame:
    """The rows of docs that are kept by judged (doc_id, __t, kept), with all their columns whatever their names. tag says __t of a row;
    of kept rows that repeat doc_id and tag one stays if once."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), tag.alias("__t"))
    left = by_row(rows, judged.where(~F.col("kept")).select("doc_id", "__t").distinct(), "left_anti")
    if once and not judged.where("kept").groupBy("doc_id", "__t").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "__t"])
    return left.select("__row.*")
