"""A stored index of label vectors that is opened, appended to in batches and searched exactly.

  pivots/    vectors that all batches are ordered by, chosen from the first batch
  batches/   one folder a batch: blocks of vectors of one pivot, ordered by their distance from it, each with its centre and radius

No vector of a block is nearer to a phrase than the phrase to the block's centre, less its radius (triangle inequality). A search first
reads the blocks whose centres are nearest, which bounds the distance of a phrase's k-th neighbour; then only the blocks that the bound
can't rule out are read. Groups of phrases meet groups of blocks, each of some megabytes, so no vector is copied for each pair of a phrase and a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.functions import vectors as V
from skysift.operators import retrieval as R
from skysift.session import stored
from skysift.sources import batches as B

#: Pivots of an index, vectors of a block, and nearest blocks that are read to bound a search.
PIVOTS, BLOCK, PROBES = 256, 1024, 2
#: Bytes of vectors of a group of blocks or of phrases; two groups at a time are in a worker's memory.
GROUP_BYTES = 8 << 20


def rows_of(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("vec").isNotNull() & F.col("label_id").isNotNull()).select("label_id", V.doubles(F.col("vec")).alias("vec"))


def create(labels: DataFrame, path: str) -> bool:
    """Makes an index of labels (label_id, vec) unless one is there that is whole; says whether it did. label_id is any plain type and is written as it is."""
    spark = labels.sparkSession
    if B.written(spark, f"{path}/pivots") and B.batches(spark, f"{path}/batches"):
        return False
    rows = rows_of(labels)
    chosen = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(PIVOTS).coalesce(1)
    B.create(chosen, f"{path}/pivots")
    append(labels, path)
    return True


def append(labels: DataFrame, path: str) -> None:
    """Adds a batch of labels (label_id, vec). Labels aren't compared with those that are there."""
    spark = labels.sparkSession
    rows = rows_of(labels)
    kind = rows.schema["label_id"].dataType.simpleString()
    some = [r.vec for r in spark.read.parquet(f"{path}/pivots").orderBy("label_id").collect()]
    pivots = np.array(some, np.float64) if some else np.zeros((1, 0))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for part in (b.slice(s, BLOCK) for s in range(0, b.num_rows, BLOCK)):
                v = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, -1)
                far = (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)
                spot = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spot.astype(np.int32)), pa.array(far[np.arange(len(v)), spot])], names=["label_id", "vec", "spot", "far"])

    near = rows.mapInArrow(ordered, f"label_id {kind}, vec array<double>, spot int, far double")
    blocks = R.packed(near, {"label_id": kind}, BLOCK, False, "p_", ["spot"], ["far"], True)
    made = blocks.select("p_label_id", "p_vec", F.size("p_label_id").cast("long").alias("size"), "centre", "radius")
    B.add_batch(made.withColumn("block", F.expr("uuid()")), f"{path}/batches")


@dataclass(frozen=True)
class Index:
    """blocks: block, size, centre, radius, p_label_id, p_vec."""

    blocks: DataFrame


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at path, with all batches that count; an error where none is whole."""
    found = B.batches(spark, f"{path}/batches") if B.written(spark, f"{path}/pivots") else []
    if not found:
        raise FileNotFoundError(f"{path} holds no whole index")
    return Index(spark.read.parquet(*found))


@dataclass
class Found:
    """near: as of retrieval.nearest(); read, all: pairs of a phrase and a block that were read, and that there are."""

    near: DataFrame
    read: int
    all: int


def nearest(phrases: DataFrame, index: Index, k: int = 3, threshold: float | None = None) -> Found:
    """The k nearest labels of each phrase (question_id, pos, vec) by squared distance, equal ones by label_id, then those with dist <= threshold: what retrieval.nearest() finds by reading everything."""
    asked = stored(phrases.where(F.col("vec").isNotNull()).select("question_id", "pos", V.doubles(F.col("vec")).alias("vec")).withColumn("__q", F.monotonically_increasing_id()), "asked")
    heads = index.blocks.select("block", "size", "centre", "radius")
    there = heads.agg(F.count("*").alias("n"), groups(F.size("centre") * F.col("size")).alias("vectors"), groups(F.size("centre")).alias("heads")).first()
    many = asked.agg(F.count("*").alias("n"), groups(F.size("vec")).alias("groups")).first()
    cores = asked.sparkSession.sparkContext.defaultParallelism
    packs = R.packed(heads.select("block", "radius", F.col("centre").alias("vec")), {"block": "string", "radius": "double"}, R.PATCH_BLOCK, False, "p_", bounds=True)
    tops = stored(packs.withColumn("g", dealt(F.monotonically_increasing_id(), F.lit(there.heads))), "heads")
    texts = asked.select("__q", "vec", F.lit(float("inf")).alias("bound"))

    near = met(*everywhere(tops.withColumnRenamed("p_block", "p_label_id"), texts.withColumn("h", dealt("__q", F.lit(max(many.groups, cores))))), PROBES)
    probes = stored(near.select("__q", F.col("label_id").alias("block"), "rank"), "probes")
    parts = stored(probes.join(asked.select("__q", "vec"), "__q").groupBy("block").agg(groups(F.size("vec")).alias("parts")), "parts")
    left = index.blocks.join(parts, "block").withColumn("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumnRenamed("block", "g")
    right = probes.join(parts, "block").join(texts, "__q").withColumn("h", dealt("__q", F.col("parts"))).withColumnRenamed("block", "g")
    bound = met(left, right, k).groupBy("__q").agg(F.count("*").alias("n"), F.max("dist").alias("dist")).select("__q", F.when(F.col("n") >= k, F.sqrt("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    if threshold is not None:
        bound = bound.withColumn("bound", F.least("bound", F.lit(max(threshold, 0.0) ** 0.5)))

    best = probes.where(F.col("rank") == 1).join(parts, "block").select("__q", F.xxhash64("block", dealt("__q", F.col("parts"))).alias("near"))
    placed = asked.select("__q", "vec").join(bound, "__q", "left").join(best, "__q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    texts = stored(placed.withColumn("h", dealt("near", F.lit(many.groups))).drop("near"), "bounded")  # phrases near one block share a group, unless they are too many
    wanted = stored(within(*everywhere(tops, texts)).withColumn("g", dealt("block", F.lit(max(there.vectors, cores)))), "wanted")
    found = met(index.blocks.join(wanted, "block"), texts.join(F.broadcast(wanted.select("g", "h").distinct()), "h"), k)
    ranked = found.join(asked.select("__q", "question_id", "pos"), "__q").select("question_id", "pos", "label_id", "dist", "rank")
    return Found(ranked if threshold is None else ranked.where(F.col("dist") <= threshold), wanted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n, many.n * there.n)


def groups(numbers: Column) -> Column:
    """Of how many groups rows with so many numbers make, an aggregate."""
    return F.greatest(F.ceil(F.coalesce(F.sum(numbers), F.lit(0)) * 8 / GROUP_BYTES), F.lit(1)).cast("int")


def dealt(of: Column | str, n: Column) -> Column:
    return F.pmod(F.xxhash64(of), n).cast("int")


def everywhere(blocks: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with g and h: every group g of blocks meets every group h of texts."""
    return blocks.crossJoin(F.broadcast(texts.select("h").distinct())), texts.crossJoin(F.broadcast(blocks.select("g").distinct()))


def cells(blocks: DataFrame, texts: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of the blocks and the texts of each g and h."""
    one, two = (df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy("g", "h") for df in (blocks, texts))  # new names: both may have g and h from one table
    return one.cogroup(two).applyInArrow(f, schema)


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)


def reached(t: np.ndarray, bound: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which blocks may hold a vector within the bound of which text. What isn't finite rules nothing out."""
    far = np.sqrt(np.maximum((t * t).sum(1)[:, None] + (centre * centre).sum(1) - 2 * t @ centre.T, 0))
    return ~(far - radius > bound[:, None] + 1e-6 * (1 + far))


def within(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(block, h, n): blocks of heads (g, h, p_block, p_radius, p_vec) that may hold a vector within the bound of n of the texts (g, h, vec, bound) of group h. Only counts are rows."""

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        names, counts = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            t, bound = matrix(right["vec"]), right["bound"].to_numpy()
            for row in range(left.num_rows):
                name, radius, centre = (left[c][row].values for c in ("p_block", "p_radius", "p_vec"))
                c, r = centre.to_numpy().reshape(len(name), -1), radius.to_numpy()
                n = sum(reached(t[s : s + R.TEXT_BLOCK], bound[s : s + R.TEXT_BLOCK], c, r).sum(0) for s in range(0, len(t), R.TEXT_BLOCK))
                names.append(name.filter(pa.array(n > 0)))
                counts.append(n[n > 0])
        h = (left if left.num_rows else right)["h"][0].as_py()
        return pa.table({"block": pa.concat_arrays(names), "h": pa.array([h] * sum(map(len, counts)), pa.int32()), "n": np.concatenate(counts)})

    return cells(blocks.select("g", "h", "p_block", "p_radius", "p_vec"), texts.select("g", "h", "vec", "bound"), counted, "block string, h int, n long")


def met(blocks: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(__q, label_id, dist, rank): the k nearest labels of each text (g, h, __q, vec, bound) in the blocks (g, h, p_label_id, p_vec, centre, radius) of the same g and h that its bound can't rule out.
    A group of each meets in one task, so vectors are copied for groups, never for pairs of a text and a block; of a group's blocks a text has k rows."""
    kind = blocks.schema["p_label_id"].dataType.elementType.simpleString()

    def best(t: np.ndarray, p: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if near := R.nearest_of(t, p, ids, k):
            return near
        score = R.distances(t, p)
        score[np.isnan(score)] = -np.inf
        at = [R.first_of(x, ids, k) for x in score]
        of, flat = np.repeat(np.arange(len(t)), [len(x) for x in at]), np.concatenate(at)
        return of, flat, score[of, flat]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, names, dists = [np.zeros(0, np.int64)], [pa.array([], left["p_label_id"].type.value_type)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            t, bound, q = matrix(right["vec"]), right["bound"].to_numpy(), right["__q"].to_numpy()
            centre, radius = matrix(left["centre"]), left["radius"].to_numpy()
            for s in range(0, len(t), R.TEXT_BLOCK):
                some, parts = t[s : s + R.TEXT_BLOCK], []
                need = reached(some, bound[s : s + R.TEXT_BLOCK], centre, radius)
                for row in np.flatnonzero(need.any(0)).tolist():
                    label, rows = left["p_label_id"][row].values, np.flatnonzero(need[:, row])
                    of, flat, score = best(some[rows], left["p_vec"][row].values.to_numpy().reshape(len(label), -1), label.to_numpy(zero_copy_only=False))
                    parts.append((rows[of], label.take(pa.array(flat)), score))
                if parts:
                    of, label, score = np.concatenate([x[0] for x in parts]), pa.concat_arrays([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
                    order = np.lexsort((label.to_numpy(zero_copy_only=False), -score, of))
                    order = order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < k]
                    qs.append(q[s + of[order]])
                    names.append(label.take(pa.array(order)))
                    dists.append(-score[order])
        return pa.table({"__q": np.concatenate(qs), "label_id": pa.concat_arrays(names), "dist": np.concatenate(dists)})

    found = cells(blocks.select("g", "h", "p_label_id", "p_vec", "centre", "radius"), texts.select("g", "h", "__q", "vec", "bound"), search, f"__q long, label_id {kind}, dist double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("__q").orderBy("dist", "label_id"))).where(F.col("rank") <= k)
