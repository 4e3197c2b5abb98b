"""Exact dedup by deterministic block naming, in DataFrame functions only.

A text's bytes are cut into blocks of BLOCK bytes. Distinct blocks are sorted into integer names; then adjacent pairs of
names are named the same way, level by level, until each document has one name. Texts of as many bytes pass through as
many levels, so (bytes, name) is equal exactly when the texts are: names stand for contents, not for hashes of them.

Names are ranks within a bucket of the block's digest, so no task sorts all blocks. Where two different blocks share a
128-bit digest, the tie is broken by content, and the documents' blocks are then joined by content too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.llm.shared import ascii_lower, by_row, row_tag, stored, table, without

BLOCK = 1024
#: Names of a bucket follow one another from bucket << 32.
BUCKETS = 1 << 20


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def ranked(distinct: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """distinct with `name`: its row's rank among the rows of its bucket, the same in every run and for every partitioning."""
    bucket = F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(BUCKETS))
    by = Window.partitionBy("__b").orderBy(*order)
    return distinct.withColumn("__b", bucket).withColumn("name", F.shiftleft("__b", 32) + F.row_number().over(by)).drop("__b")


def block_names(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, __t, pos, block) with names in place of contents."""
    digest = [F.xxhash64("block").alias("__h1"), F.xxhash64(F.lit(1), "block").alias("__h2")]
    distinct = blocks.select("block", *digest).distinct()
    twins = stored(distinct.groupBy("__h1", "__h2").agg(F.count("*").alias("n")), "blocks")
    rows = blocks.select("doc_id", "__t", "pos", *digest)
    names = ranked(twins.where("n = 1").select("__h1", "__h2"), ["__h1", "__h2"], ["__h1", "__h2"])
    named = rows.join(names, ["__h1", "__h2"]).select("doc_id", "__t", "pos", "name")
    clashing = twins.where("n > 1").select("__h1", "__h2")
    if not clashing.isEmpty():
        again = distinct.join(clashing, ["__h1", "__h2"])
        apart = ranked(again, ["__h1", "__h2"], ["__h1", "__h2", "block"]).withColumn("name", -F.col("name")).select("block", "name")
        named = named.unionByName(blocks.join(apart, "block").select("doc_id", "__t", "pos", "name"))
    return named


def gathered(named: DataFrame) -> DataFrame:
    """One row per document: its names in order. Rows that repeat doc_id and text give each name once."""
    lists = named.groupBy("doc_id", "__t").agg(F.array_sort(F.collect_set(F.struct("pos", "name"))).alias("x"))
    return lists.select("doc_id", "__t", F.transform("x", lambda y: y["name"]).alias("names"))


def identities(docs: DataFrame) -> DataFrame:
    """(doc_id, __t, n_bytes, name), one row for each doc_id and text. docs: doc_id, __t and norm, the normalised text."""
    sized = docs.select("doc_id", "__t", F.octet_length("norm").cast("long").alias("n_bytes"))
    raw = F.col("norm").cast("binary")
    count = F.greatest(F.ceil(F.octet_length("norm") / BLOCK), F.lit(1)).cast("int")
    blocks = docs.select("doc_id", "__t", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"), raw.alias("raw")).select("doc_id", "__t", "pos", F.substring("raw", F.col("pos") * BLOCK + 1, F.lit(BLOCK)).alias("block"))
    state = stored(gathered(block_names(blocks)), "level0")
    done = state.where(F.size("names") == 1)
    live = state.where(F.size("names") > 1)
    level = 0
    while not live.isEmpty():  # as many levels as the longest document has doublings
        level += 1
        pairs = live.select(
            "doc_id",
            "__t",
            F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1), lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(0)).alias("b")))).alias("pos", "p"),
        ).select("doc_id", "__t", "pos", "p.a", "p.b")
        names = ranked(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        state = stored(gathered(pairs.join(names, ["a", "b"])), f"level{level}")
        done = done.unionByName(state.where(F.size("names") == 1))
        live = state.where(F.size("names") > 1)
    return by_row(sized.distinct(), done.select("doc_id", "__t", F.element_at("names", 1).alias("name")))


def dedup(docs: DataFrame, tagged: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id stays
    (null is the smallest). Rows that repeat a doc_id are told apart by their text; of rows that repeat both, all are
    returned and counted. Other columns of docs are ignored; an empty table gives no rows. tagged adds __t, the row tag.
    """
    base = docs.select("doc_id", row_tag(normalised(F.col("text"))).alias("__t"), normalised(F.col("text")).alias("norm"))
    ids = identities(base)
    rows = stored(by_row(base.select("doc_id", "__t", F.sha2("norm", 256).alias("text_sha256")), ids), "identities")
    # sizes first, then joined back: a group of copies may hold a third of all rows
    groups = rows.groupBy("n_bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    named = rows.join(stored(groups, "groups"), ["n_bytes", "name"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return named.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", *["__t"] * tagged)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each set of equal texts, with all its columns; null counts as empty. Rows that repeat doc_id and text
    leave one row. An empty table stays empty."""
    judged = stored(dedup(docs, tagged=True).select("doc_id", "__t", "kept"), "judged")
    return without(docs, row_tag(normalised(F.col("text"))), judged)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
