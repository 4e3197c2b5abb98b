"""Hard-negative mining over a product-quantised index with stored residual norms.

A vector of whole numbers is parted into pairs of components, each pair is coded by the nearest of at most CENTROIDS centroids, and the norm of
what the codes leave over is stored beside them. An anchor's inner product with a row is then a sum of looked-up products, one for
each pair, give or take the anchor's norm times the residual's (Cauchy-Schwarz). The bound is rigorous: what it leaves out can't be a result,
and what is left is scored exactly, in whole numbers. So no neighbour is lost, whatever the centroids are.

The centroids are fitted in the driver on at most SAMPLE rows, those of the least hashes; every row is indexed. Anchors meet all rows in the
cells of a grid: a cell holds a slice of the anchors (ANCHOR_BYTES) and a share of the index (CELL_BLOCKS), first the anchors, then the rows block
by block. It keeps the best rows of its anchors so far, and their worst exact score (or the worst lower bound of as many rows that are surely in
the window) is the threshold that upper bounds have to reach. Only a cell's best rows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.llm.shared import drop_stored, stored, table

SAMPLE, CENTROIDS, ROUNDS, PART = 4096, 256, 6, 2
#: Rows and anchors of a block; a cell of both takes some 10 MB an array.
ROW_BLOCK, ANCHOR_BLOCK = 4096, 256
#: About so many bytes of anchors' vectors, and blocks of rows, are in a cell of the grid.
ANCHOR_BYTES, CELL_BLOCKS = 16 << 20, 24
#: Scores are less, so that doubles hold them exactly and longs a hundred times them.
LIMIT = 1 << 53
#: Where more than one in so many pairs of a cell passes the filter, all of the cell is scored at once.
DENSE = 16


class Codebook:
    """Centroids of each pair of components: array (parts, centroids, PART)."""

    def __init__(self, sample: np.ndarray, dim: int):
        self.dim, self.parts = dim, -(-dim // PART)
        points = self.padded(sample.astype(np.float64).reshape(-1, dim)).reshape(-1, self.parts, PART)
        self.centroids = np.stack([self._fit(points[:, m]) for m in range(self.parts)]) if self.parts else np.zeros((0, 1, PART))

    def padded(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.parts * PART - self.dim)))

    @staticmethod
    def _fit(points: np.ndarray) -> np.ndarray:
        if not len(points):
            return np.zeros((1, PART))
        at = np.random.default_rng(0).permutation(len(points))[:CENTROIDS]
        centroids = points[at].copy()
        for _ in range(ROUNDS):
            own = nearest(points, centroids)
            n = np.bincount(own, minlength=len(centroids))
            for k in range(PART):
                total = np.bincount(own, points[:, k], len(centroids))
                centroids[:, k] = np.where(n > 0, total / np.maximum(n, 1), centroids[:, k])
        return centroids

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, parts) and residual norms, a little more than exact ones so that rounding can't make them too small."""
        points = self.padded(rows.astype(np.float64)).reshape(-1, self.parts, PART)
        codes, left = np.zeros((len(rows), self.parts), np.uint8), np.zeros(len(rows))
        for m in range(self.parts):
            codes[:, m] = own = nearest(points[:, m], self.centroids[m])
            left += ((points[:, m] - self.centroids[m][own]) ** 2).sum(1)
        return codes, np.sqrt(left) * (1 + 1e-9) + 1e-9 * np.sqrt((points**2).sum((1, 2))) + 1e-9

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(parts, centroids, anchors): the products of each anchor's pairs with the centroids."""
        points = self.padded(anchors.astype(np.float64)).reshape(-1, self.parts, PART)
        return np.einsum("apk,pck->pca", points, self.centroids)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)


def looked_up(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(rows, anchors): the sums of the products that the codes name."""
    out = np.zeros((len(codes), tables.shape[2]))
    for m in range(codes.shape[1]):
        out += tables[m][codes[:, m]]
    return out


def exact(rows: np.ndarray, anchors: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whole-number products of the pairs (r, a), all below LIMIT, so that doubles hold them exactly."""
    if len(r) * DENSE > len(rows) * len(anchors):
        return (rows @ anchors.T)[r, a].astype(np.int64)
    out = np.zeros(len(r), np.int64)
    for at in range(0, len(r), 1 << 14):
        s = slice(at, at + (1 << 14))
        out[s] = np.einsum("ij,ij->i", rows[r[s]], anchors[a[s]])
    return out


class Best:
    """The best `k` rows of each of `n` lists, by falling score and rising id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        """What a row must score at least to enter."""
        return np.where(self.score[:, -1] == np.iinfo(np.int64).min, -np.inf, self.score[:, -1].astype(np.float64))

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(of)
        if not len(touched):
            return
        lists = np.concatenate([np.repeat(touched, self.k), of])
        scores, names = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((names, ~scores, lists))
        lists, scores, names = lists[order], scores[order], names[order]
        begin = np.searchsorted(lists, lists)
        rank = np.arange(len(lists)) - begin
        keep = rank < self.k
        self.score[lists[keep], rank[keep]], self.id[lists[keep], rank[keep]] = scores[keep], names[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, k = np.nonzero(self.id != np.iinfo(np.int64).max)
        return at, self.score[at, k], self.id[at, k]


def at_least(low: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """For each column the k-th largest of low where sure; minus infinity where fewer are."""
    if len(low) < k:
        return np.full(low.shape[1], -np.inf)
    return np.partition(np.where(sure, low, -np.inf), len(low) - k, axis=0)[len(low) - k]


# ---------------------------------------------------------------- index


def facts(rows: DataFrame) -> tuple[int, int, int, bool]:
    """Rows, dimension, largest component by absolute value, and whether a vec_id is repeated."""
    most = F.max(F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x))), F.lit(0)))
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), most.alias("most")).first()
    again = not rows.groupBy("vec_id").count().where("count > 1").isEmpty()
    return r.n, max(r.dim or 0, 1), r.most or 0, again


def codebook(rows: DataFrame, dim: int) -> Codebook:
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column(0)
    return Codebook(np.array([np.pad(x, (0, dim - len(x))) for x in some.to_pylist()], np.float64).reshape(-1, dim), dim)


def dense(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as a matrix, with zeros where one is shorter than the others."""
    flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
    size = np.diff(off)
    out = np.zeros((len(lists), dim), "<f8")
    if (size == dim).all():
        out[:] = flat.reshape(len(lists), dim)
    else:
        row = np.repeat(np.arange(len(lists)), size)
        out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


BYTES = [f"b{k}" for k in range(5)]
BLOCK = "spot long, " + ", ".join(f"{n} binary" for n in BYTES)


def blocks_of(df: DataFrame, size: int, fields) -> DataFrame:
    """df's rows in blocks of at most `size`: five columns of bytes, as fields() gives them for a block, and spot, a number that spreads the blocks."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                made = [x.tobytes() for x in fields(part)]
                yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(made[0])], pa.int64()), *(pa.array([x], pa.binary()) for x in made)], names=["spot", *BYTES])

    return df.mapInArrow(block, BLOCK)


def index(rows: DataFrame, book: Codebook) -> DataFrame:
    """rows (vec_id, label, vec) in blocks: ids, labels, vectors, codes and residual norms."""

    def fields(part: pa.RecordBatch) -> list[np.ndarray]:
        vec = dense(part.column(2), book.dim)
        return [*(part.column(k).to_numpy().astype("<i8") for k in range(2)), vec, *book.encode(vec)]

    return blocks_of(rows.select("vec_id", "label", "vec"), ROW_BLOCK, fields)


def anchor_blocks(anchors: DataFrame, dim: int, places: int) -> DataFrame:
    """anchors (vec_id, label, vec, scores array<long>) in blocks: ids, labels, vectors, scores in so many places, and how many there are."""

    def fields(part: pa.RecordBatch) -> list[np.ndarray]:
        ids, labels = (part.column(k).to_numpy().astype("<i8") for k in range(2))
        return [ids, labels, dense(part.column(2), dim), dense(part.column(3), places).astype("<i8"), np.diff(np.asarray(part.column(3).offsets)).astype("<i8")]

    return blocks_of(anchors.select("vec_id", "label", "vec", "scores"), ANCHOR_BLOCK, fields)


# ---------------------------------------------------------------- search


class Asked:
    """A block of anchors, the windows that their lists' scores have to lie in, and the best rows so far."""

    def __init__(self, fields: list[bytes], book: Codebook, lists: int, k: int, window: tuple[int, int] | None):
        self.ids, self.labels = (np.frombuffer(x, "<i8") for x in fields[:2])
        self.vecs = np.frombuffer(fields[2], "<f8").reshape(-1, book.dim)
        self.norms = np.sqrt((self.vecs.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        self.book, self.lists, self.best, self.window = book, lists, Best(len(self.ids) * lists, k), window
        if window:
            score = np.frombuffer(fields[3], "<i8").reshape(-1, lists)
            there = np.arange(lists) < np.frombuffer(fields[4], "<i8")[:, None]
            self.low, self.high = np.where(there, -(-window[0] * score // 100), 1), np.where(there, window[1] * score // 100, 0)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        """A block of rows: those that bounds can't rule out are scored, the best ones kept."""
        middle, about = looked_up(self.book.tables(self.vecs), codes), norms[:, None] * self.norms
        upper, lower, same = middle + about, middle - about, labels[:, None] == self.labels
        if self.window is None:
            may = same & (ids[:, None] != self.ids)
            r, a = np.nonzero(may & (upper >= np.maximum(self.best.worst(), at_least(lower, may, self.best.k))))
            self.best.add(a, exact(vecs, self.vecs, r, a), ids[r])
            return
        may, worst = np.zeros(same.shape, bool), self.best.worst().reshape(-1, self.lists)
        for j in range(self.lists):
            low, high = self.low[:, j], self.high[:, j]
            sure = ~same & (lower >= low) & (upper <= high)
            may |= ~same & (low <= high) & (lower <= high) & (upper >= np.maximum(low, np.maximum(worst[:, j], at_least(lower, sure, self.best.k))))
        r, a = np.nonzero(may)
        score = exact(vecs, self.vecs, r, a)
        for j in range(self.lists):
            within = (score >= self.low[a, j]) & (score <= self.high[a, j]) & (score >= worst[a, j])
            self.best.add(a[within] * self.lists + j, score[within], ids[r[within]])

    def found(self) -> pa.RecordBatch:
        at, score, ids = self.best.rows()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at // self.lists]), pa.array((at % self.lists).astype(np.int32)), pa.array(ids), pa.array(score)], names=["anchor_id", "list", "id", "score"])


def searched(blocks: DataFrame, anchors: DataFrame, grid: tuple[int, int], book: Codebook, lists: int, k: int, window: tuple[int, int] | None) -> DataFrame:
    """(anchor_id, list, id, score) of the best k rows that each cell has for each list of an anchor. Without a window an anchor has one list, of other rows of its label;
    with one (in hundredths) a list for each of its scores, of rows of other labels within these shares of the score. grid: shares of the rows, slices of the anchors."""
    shares, cuts = grid

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            for row in range(b.num_rows):
                here, rows = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                if here != cell:
                    yield from (x.found() for x in held)
                    cell, held = here, []
                fields = [b.column(c)[row].as_py() for c in range(2, 7)]
                if not rows:
                    held.append(Asked(fields, book, lists, k, window))
                    continue
                ids, labels = (np.frombuffer(x, "<i8") for x in fields[:2])
                vecs, codes = np.frombuffer(fields[2], "<f8").reshape(-1, book.dim), np.frombuffer(fields[3], np.uint8).reshape(len(ids), -1)
                for x in held:
                    x.meet(ids, labels, vecs, codes, np.frombuffer(fields[4], "<f8"))
        yield from (x.found() for x in held)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = anchors.select("*", every(shares).alias("__share")).select((F.col("spot") % cuts * shares + F.col("__share")).alias("cell"), F.lit(False).alias("rows"), *BYTES)
    then = blocks.select("*", every(cuts).alias("__cut")).select((F.col("__cut") * shares + F.col("spot") % shares).alias("cell"), F.lit(True).alias("rows"), *BYTES)
    ordered = first.unionByName(then).repartition(shares * cuts, "cell").sortWithinPartitions("cell", "rows")
    return ordered.mapInArrow(search, "anchor_id long, list int, id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    """The best k of what all tasks have found for each list, with rank from 1."""
    order = Window.partitionBy("anchor_id", "list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its `positives` best other rows of its label, the `negatives` best rows of other labels
    whose score is between low and high hundredths of the positive's. Scores are inner products; equal ones go by vec_id.

    rows: vec_id, label, vec array<long>; anchor is a condition on vec_id. Rows with a null anywhere take no part. A vector that is shorter than others ends in
    zeros. Of rows that repeat a vec_id the one of the least label, then vector, counts. Components whose products can reach LIMIT are an error. An
    empty table, and one without anchors, gives no rows."""
    rows = rows.select("vec_id", "label", "vec").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    given = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vec"), "vectors")
    n, dim, most, again = facts(given)
    rows = given.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec") if again else given
    if dim * most * most >= LIMIT:
        raise ValueError(f"components of up to {most}: their products reach {LIMIT}")
    book = codebook(rows, dim)
    blocks = stored(index(rows, book), "index")
    asked = rows.where(anchor)
    many = -(-n // ROW_BLOCK)
    shares = max(1, -(-many // CELL_BLOCKS), min(many, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    grid = shares, max(1, -(-asked.count() * dim * 8 // ANCHOR_BYTES))
    near = searched(blocks, anchor_blocks(asked.withColumn("scores", F.array().cast("array<long>")), dim, positives), grid, book, 1, positives, None)
    best = stored(first(near, positives).select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("l")).select("anchor_id", F.transform("l", lambda x: x["positive_score"]).alias("scores"))
    windows = asked.join(scores, asked["vec_id"] == scores["anchor_id"]).select("vec_id", "label", "vec", "scores")
    found = first(searched(blocks, anchor_blocks(windows, dim, positives), grid, book, positives, negatives, (low, high)), negatives)
    result = stored(found.withColumn("place", F.col("list") + 1).join(best, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    drop_stored(given, blocks, best)
    return result


SQL = """
WITH f AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, q) = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all; every seventh vector's label is wrong by one."""
    v = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    x = F.col("embedding").cast("array<double>")
    v = v.where(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(v.select("vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("vec")), "vec_id % 100 = 0")
