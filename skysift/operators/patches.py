"""One image row to many patch rows: three tilings, and the tiles of the answer model. images: image, width, height."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.functions import geometry as G


COLUMNS = ("level", "row", "col", "x1", "y1", "x2", "y2")


def numbered(images: DataFrame, boxes: Callable[[int, int], np.ndarray]) -> DataFrame:
    """(image, patch_idx, level, row, col, x1, y1, x2, y2) of each image: boxes(width, height) has the columns of COLUMNS, in order; of equal boxes the first stays. An image's
    patches are made where its row is, without a shuffle; images without pixels have none."""

    def one(width: int | None, height: int | None) -> np.ndarray:
        if not width or not height:
            return np.zeros((0, len(COLUMNS)), np.int32)
        rows = boxes(width, height).astype(np.int32)
        sides = rows[:, 3:]
        if 0 <= sides.min() and sides.max() < 1 << 16:
            key = np.ascontiguousarray(sides.astype(np.uint16)).view(np.uint64).ravel()
        else:
            key = np.ascontiguousarray(sides).view("V16").ravel()
        _, first = np.unique(key, return_index=True)
        return rows[np.sort(first)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [one(w, h) for w, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                size = np.array([len(x) for x in made])
                rows, of = np.concatenate(made), np.repeat(np.arange(len(made)), size)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(place.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["image", "patch_idx", *COLUMNS])

    kind = images.schema["image"].dataType.simpleString()
    tasks = images.sparkSession.sparkContext.defaultParallelism
    if images.rdd.getNumPartitions() < tasks:  # rows are few and small, what they become is not
        images = images.repartition(tasks)
    return images.select("image", F.col("width").cast("long"), F.col("height").cast("long")).mapInArrow(make, f"image {kind}, patch_idx int, " + ", ".join(f"{c} int" for c in COLUMNS))


def up(v: int, n: int) -> int:
    """v rounded up to a multiple of n."""
    return -(-v // n) * n


def placed(level: int, xs: np.ndarray, ys: np.ndarray, kw: float, kh: float, width: int, height: int, w: int, h: int) -> np.ndarray:
    """The boxes of kw x kh that begin at xs and ys of the image resized to w x h, row by row, in original coordinates cut to whole numbers."""
    back = lambda v, size, rounded: np.floor((v * size).astype(np.float64) / rounded).astype(np.int64)
    col, row = np.tile(np.arange(len(xs)), len(ys)), np.repeat(np.arange(len(ys)), len(xs))
    x1, x2, y1, y2 = back(xs, width, w), back(xs + kw, width, w), back(ys, height, h), back(ys + kh, height, h)
    return np.stack([np.full(len(col), level), row, col, x1[col], y1[row], x2[col], y2[row]], axis=1)


def vit(images: DataFrame, size: int = 448) -> DataFrame:
    """Squares of `size` of the image rounded up to whole squares."""

    def boxes(width: int, height: int) -> np.ndarray:
        w, h = up(width, size), up(height, size)
        return placed(0, np.arange(0, w, size), np.arange(0, h, size), size, size, width, height, w, h)

    return numbered(images, boxes)


def grid(images: DataFrame, most: int = 10, enlarge: float = 1.0) -> DataFrame:
    """n x n cells for n from 1 to `most`; enlarged cells may leave the image."""

    def boxes(width: int, height: int) -> np.ndarray:
        out = []
        for n in range(1, most + 1):
            w, h = up(width, n), up(height, n)
            out.append(placed(n, np.arange(n) * (w // n), np.arange(n) * (h // n), w // n, h // n, width, height, w, h))
        rows = np.concatenate(out)
        if enlarge != 1:
            centre, half = (rows[:, 3:5] + rows[:, 5:7]) / 2, (rows[:, 5:7] - rows[:, 3:5]) * enlarge / 2
            rows[:, 3:5], rows[:, 5:7] = np.trunc(centre - half), np.trunc(centre + half)
        return rows

    return numbered(images, boxes)


def windows(length: int, kernel: int, stride: int) -> np.ndarray:
    """Begins of sliding windows; the last one touches the border."""
    return np.minimum(np.arange(-(-(length - kernel) // stride) + 1) * stride, length - kernel)


def cc(images: DataFrame, parts: int = 20) -> DataFrame:
    """Sliding windows of k / parts of each side, k from `parts` down to 1; of levels with as many windows the smallest k stays."""

    def boxes(width: int, height: int) -> np.ndarray:
        w, h = up(width, parts), up(height, parts)
        levels: dict[int, np.ndarray] = {}  # by number of windows
        for k in range(1, parts + 1):
            begins = [np.zeros(1, np.int64) if k == parts else windows(side, k * (side // parts), k * (side // parts - 1) + 1) for side in (w, h)]
            levels.setdefault(len(begins[0]) * len(begins[1]), placed(parts - k, *begins, k * (w // parts), k * (h // parts), width, height, w, h))
        return np.concatenate(list(levels.values())[::-1])

    return numbered(images, boxes)


def cc_padded(images: DataFrame, parts: int = 10) -> DataFrame:
    """cc of images that are padded to whole parts instead of resized (sources.images.padded()); boxes are in the padded image's coordinates."""
    whole = lambda c: (F.ceil(F.col(c) / parts) * parts).cast("long").alias(c)
    return cc(images.select("image", whole("width"), whole("height")), parts)


SCHEMES = {"vit": vit, "grid": grid, "cc": cc, "cc_padded": cc_padded}


def patchify(images: DataFrame, method: str) -> DataFrame:
    if method not in SCHEMES:
        raise ValueError(f"patch method {method!r}: one of {sorted(SCHEMES)} is needed")
    return SCHEMES[method](images)


def tiles(images: DataFrame, tile: int = 448, thumbnail: bool = True) -> DataFrame:
    """Tiles of the grid that suits the image, row by row; then the whole image as a thumbnail if there are several."""
    sized = images.withColumn("g", G.tile_grid(F.col("width"), F.col("height"), tile)).withColumn("n", F.col("g.i") * F.col("g.j"))
    last = F.col("n") - 1 + (F.when(F.col("n") > 1, 1).otherwise(0) if thumbnail else 0)
    rows = sized.withColumn("tile", F.explode(F.sequence(F.lit(0), last)))
    whole = F.col("tile") == F.col("n")
    x, y = F.col("tile") % F.col("g.i") * tile, F.floor(F.col("tile") / F.col("g.i")).cast("int") * tile
    pick = lambda a, b: F.when(whole, a).otherwise(b)
    return rows.select("image", F.col("g.i").alias("cols"), F.col("g.j").alias("rows"), "tile", whole.alias("is_thumbnail"), pick(F.lit(0), x).alias("x1"), pick(F.lit(0), y).alias("y1"), pick(F.lit(tile), x + tile).alias("x2"), pick(F.lit(tile), y + tile).alias("y2"))
