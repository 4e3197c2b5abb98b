"""Content-addressed store of token ids.

Each document's ids are one stream. A rolling hash over the last WINDOW ids cuts it where the hash's low bits are zero,
so equal passages give equal chunks wherever they stand; a chunk is kept once, under the SHA-256 of its bytes.

  chunks/    digest, n, ids (unsigned little-endian, 2 bytes where all ids of the chunk are below 65536, else 4)
  recipes/   doc_id in ascending order, n_tokens, the digests of the chunks in order, root (Merkle root of the digests)
  manifest/  for each part of the recipes its Merkle root, and the root over all parts

Reading verifies all three: chunk bytes against digests, digests against document roots, roots against the manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.llm.shared import drop_stored, row_tag, stored, table
from skysift.llm.textcols import encoder, mix
from skysift.session import scratch_dir

WINDOW, MASK, LEAST, MOST, END_ID = 16, 0xFF, 64, 2048, 2
POLY = 0xEDB88320


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents whose ids end at ends[1:]."""
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    m, step = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while step < WINDOW:
            h[step:] += h[:-step].copy() * m
            m, step = m * m, step * 2
        at = np.flatnonzero(mix(h) & np.uint64(MASK) == 0) + 1
    doc = np.searchsorted(ends, at - 1, "right") - 1
    at = at[at - ends[doc] >= WINDOW]  # before, the window reaches into another document
    at = at[np.diff(at, prepend=-LEAST) >= LEAST]
    at = np.union1d(at, ends[1:])
    begin = np.concatenate([[0], at[:-1]])
    extra = (at - begin - 1) // MOST
    k = np.repeat(np.arange(len(at)), extra)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    return np.union1d(at, begin[k] + nth * MOST)


def merkle(leaves: list[bytes]) -> bytes:
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\x01" + leaves[i] + (leaves[i + 1] if i + 1 < len(leaves) else b"")).digest() for i in range(0, len(leaves), 2)]
    return leaves[0]


def chunked(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, __t, n_tokens, root, digests, sizes, chunks) of each row."""
    names = ["doc_id", "__t", "n_tokens", "root", "digests", "chunks"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for i, j, ids, ends in enc(b.column(2)):
                full = np.insert(ids, ends[1:], np.uint32(end_id))
                ends = ends + np.arange(j - i + 1)
                at = np.concatenate([[0], cuts(full, ends)])
                wide, narrow = full.astype("<u4"), full.astype("<u2")
                large = np.maximum.reduceat(full, at[:-1]) > 0xFFFF
                chunks = [(wide if w else narrow)[s:e].tobytes() for s, e, w in zip(at[:-1].tolist(), at[1:].tolist(), large.tolist(), strict=True)]
                # the width is part of what is hashed
                digests = [hashlib.sha256((b"4" if w else b"2") + c).digest() for c, w in zip(chunks, large.tolist(), strict=True)]
                off = np.searchsorted(at, ends).astype(np.int32)
                cells = pa.array([{"w": w, "ids": c} for c, w in zip(chunks, large.tolist(), strict=True)], pa.struct([("w", pa.bool_()), ("ids", pa.binary())]))
                roots = [merkle(digests[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                off = pa.array(off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(ends)), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(off, pa.array(digests, pa.binary())), pa.ListArray.from_arrays(off, cells)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(F.col("text")).alias("__t"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, __t long, n_tokens long, root binary, digests array<binary>, chunks array<struct<w:boolean,ids:binary>>")


def part_roots(recipes: DataFrame) -> DataFrame:
    """(part, part_root): the Merkle root of each part's documents in order; a part is one task's share of the recipes."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves = None, []
        for b in batches:
            for p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part and leaves:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([merkle(leaves)], pa.binary())], names=["part", "part_root"])
                    leaves = []
                part = p
                leaves.append(r)
        if leaves:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([merkle(leaves)], pa.binary())], names=["part", "part_root"])

    return recipes.repartition("part").sortWithinPartitions("part", "doc_id", "__t").select("part", "root").mapInArrow(roots, "part int, part_root binary")


def write_store(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID) -> None:
    """Writes the store. A null or empty text is the end id alone; rows that repeat a doc_id have each a recipe."""
    spark = docs.sparkSession
    staged = stored(chunked(docs, tokenizer, end_id), "staged")
    pairs = staged.select(F.explode(F.arrays_zip("digests", "chunks")).alias("x")).select(F.col("x.digests").alias("digest"), F.col("x.chunks.w").alias("wide"), F.col("x.chunks.ids").alias("ids"))
    pairs.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = staged.select("doc_id", "__t", "n_tokens", "root", "digests").repartitionByRange(parts, "doc_id", "__t").sortWithinPartitions("doc_id", "__t")
    recipes.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    drop_stored(staged)
    roots = part_roots(spark.read.parquet(f"{path}/recipes")).orderBy("part").collect()  # one row a partition
    top = merkle([bytes(r.part_root) for r in roots])
    spark.createDataFrame([(r.part, bytes(r.part_root), top) for r in roots], "part int, part_root binary, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the CRC-32 polynomial, bits reflected."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    out = np.zeros_like(b)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(k) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(POLY), np.uint64(0))
    return out


def shifts(sizes: np.ndarray) -> np.ndarray:
    """x to the power 8 * size, for each size in bytes."""
    out = np.full(len(sizes), 1 << 31, np.uint64)
    power, rest = np.array([1 << 23], np.uint64), sizes.astype(np.int64).copy()
    while rest.any():
        odd = (rest & 1).astype(bool)
        out[odd] = multiply(out[odd], np.broadcast_to(power, odd.sum()))
        power, rest = multiply(power, power), rest >> 1
    return out


def chunk_facts(chunks: DataFrame) -> DataFrame:
    """(digest, n, crc, ok) from the bytes that the files hold; crc is that of the ids as 4 bytes each."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc, ok = [], [], []
            for d, w, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                full = np.frombuffer(ids, "<u4" if w else "<u2")
                n.append(len(full))
                crc.append(zlib.crc32(full.astype("<u4")))
                ok.append(hashlib.sha256((b"4" if w else b"2") + ids).digest() == d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())], names=["digest", "n", "crc", "ok"])

    return chunks.select("digest", "wide", "ids").mapInArrow(facts, "digest binary, n long, crc long, ok boolean")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each recipe, rebuilt from the chunk files; fails if any part doesn't verify. Documents that were repeated have each a row; the store of an empty table gives none.

    Documents are not moved: the CRC of a document follows from those of its chunks and their lengths."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    roots = [bytes(r.part_root) for r in manifest.orderBy("part").collect()]
    again = [bytes(r.part_root) for r in part_roots(recipes).orderBy("part").collect()]
    if again != roots or any(bytes(r.root) != merkle(roots) for r in manifest.select("root").distinct().collect()):
        raise ValueError(f"the recipes in {path} don't match the manifest")
    refs = recipes.select("doc_id", "__t", "part", "root", F.posexplode("digests").alias("pos", "digest"))
    joined = refs.join(chunk_facts(spark.read.parquet(f"{path}/chunks")), "digest", "left")
    docs = joined.groupBy("doc_id", "__t", "part", "root").agg(F.array_sort(F.collect_set(F.struct("pos", "n", "crc", "ok", "digest"))).alias("c"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            off, cells = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            n, crc, ok, digest = (cells.field(k) for k in (1, 2, 3, 4))
            if not len(b):
                continue
            if n.null_count or not all(ok.to_pylist()):
                raise ValueError("a chunk is missing or differs from its digest")
            digest = digest.to_pylist()
            if any(merkle(digest[s:e]) != r for s, e, r in zip(off[:-1].tolist(), off[1:].tolist(), b.column(3).to_pylist(), strict=True)):
                raise ValueError("a recipe differs from its root")
            n, crc = n.to_numpy(), crc.to_numpy().astype(np.uint64)
            shift, total, size = shifts(n * 4), crc[off[:-1]], np.diff(off)
            for k in range(1, int(size.max())):
                live = np.flatnonzero(size > k)
                at = off[live] + k
                total[live] = multiply(shift[at], total[live]) ^ crc[at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.add.reduceat(n, off[:-1])), pa.array(total.astype(np.int64))], names=["doc_id", "__t", "part", "n_tokens", "ids_crc32"])

    rebuilt = docs.mapInArrow(rebuild, "doc_id long, __t long, part int, n_tokens long, ids_crc32 long")
    counts = recipes.groupBy("doc_id", "__t").count()
    if not counts.where("count > 1").isEmpty():  # whole rows that are repeated
        rebuilt = rebuilt.join(counts.withColumnsRenamed({"doc_id": "d2", "__t": "t2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("__t") == F.col("t2"))).withColumn("r", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("d2", "t2", "count")
    else:
        rebuilt = rebuilt.withColumn("r", F.lit(1))
    rebuilt = stored(rebuilt, "rebuilt")
    before = rebuilt.groupBy("part").agg(F.sum("n_tokens").alias("s")).withColumn("before", F.sum("s").over(Window.orderBy("part")) - F.col("s")).drop("s")  # one row a partition
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "__t", "r")) - F.col("n_tokens")
    return rebuilt.withColumn("run", running).join(F.broadcast(before), "part").select("doc_id", (F.col("run") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<long>): the documents themselves, rebuilt from the store."""
    chunks = spark.read.parquet(f"{path}/chunks")

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<u4" if w else "<u2").astype(np.int64) for w, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["digest", "ids"])

    refs = spark.read.parquet(f"{path}/recipes").select("doc_id", "__t", F.posexplode("digests").alias("pos", "digest"))
    rows = refs.join(chunks.select("digest", "wide", "ids").mapInArrow(wide, "digest binary, ids array<long>"), "digest")
    lists = rows.groupBy("doc_id", "__t").agg(F.array_sort(F.collect_set(F.struct("pos", "ids"))).alias("c"))
    return lists.select("doc_id", F.flatten(F.transform("c", lambda x: x["ids"])).alias("ids"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
