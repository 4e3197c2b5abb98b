"""Boxes as column expressions. Pixel boxes are (x1, y1, x2, y2); units are said in names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The nine regions of an image, row by row; earlier ones win ties.
REGIONS = ["Top-left", "Top-center", "Top-right", "Center-left", "Center", "Center-right", "Bottom-left", "Bottom-center", "Bottom-right"]
# Tile grids (columns, rows) of at most six tiles, by area; of equally good ones a later one needs a large image.
TILE_GRIDS = [(1, 1), (1, 2), (2, 1), (3, 1), (1, 3), (4, 1), (1, 4), (2, 2), (1, 5), (5, 1), (6, 1), (2, 3), (1, 6), (3, 2)]

Box = tuple[Column, Column, Column, Column]


def enlarged(box: Box, factor: float, width: Column, height: Column) -> Box:
    """Scaled about its centre, clamped to the image, cut to whole pixels; factor 1 leaves it alone."""
    x1, y1, x2, y2 = box
    if factor == 1:
        return box
    cx, cy, w, h = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) * factor, (y2 - y1) * factor
    return (
        F.greatest(F.lit(0.0), cx - w / 2).cast("int"),
        F.greatest(F.lit(0.0), cy - h / 2).cast("int"),
        F.least(width.cast("double"), cx + w / 2).cast("int"),
        F.least(height.cast("double"), cy + h / 2).cast("int"),
    )


def scaled(box: Box, scale: float, low: Column, high: Column) -> Box:
    """Scaled about its centre with non-negative sides, clamped to [low, high]; fractions stay."""
    x1, y1, x2, y2 = box
    cx, cy, w, h = (x1 + x2) / 2, (y1 + y2) / 2, F.abs(x2 - x1) * scale, F.abs(y2 - y1) * scale
    clamp = lambda v: F.least(F.greatest(v, low), high)
    return clamp(cx - w / 2), clamp(cy - h / 2), clamp(cx + w / 2), clamp(cy + h / 2)


def corners(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def oriented_corners(cx: Column, cy: Column, w: Column, h: Column, radians: Column) -> list[Column]:
    """The eight coordinates of an oriented box's corners."""
    c, s = F.cos(radians), F.sin(radians)
    out = []
    for i, j in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
        out += [cx + w / 2 * c * i - h / 2 * s * j, cy + w / 2 * s * i + h / 2 * c * j]
    return out


def enclosing(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Box:
    """Centre and sides of the upright box around an oriented one."""
    p = oriented_corners(cx, cy, w, h, F.radians(degrees))
    xs, ys = F.array(*p[::2]), F.array(*p[1::2])
    lo, hi, up, down = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return (lo + hi) / 2, (up + down) / 2, hi - lo, down - up


def overlap(a: Box, b: Box) -> Column:
    """Shared area of two boxes."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w.cast("double")) * F.greatest(F.lit(0.0), h.cast("double"))


def region(box: Box, width: Column, height: Column) -> Column:
    """Name of the region with the largest overlap, the first of several."""
    gw, gh = width / 3, height / 3
    areas = [overlap(box, (gw * (k % 3), gh * (k // 3), gw * (k % 3) + gw, gh * (k // 3) + gh)) for k in range(9)]
    most = F.greatest(*areas)
    out = F.lit(REGIONS[8])
    for k in range(7, -1, -1):
        out = F.when(areas[k] == most, REGIONS[k]).otherwise(out)
    return out


def permille(v: Column, size: Column) -> Column:
    """Pixels to thousandths of the image's side."""
    return (v / size * 1000).cast("int")


def pixels(v: Column, size: Column) -> Column:
    return (v / 1000 * size).cast("int")


def tile_grid(width: Column, height: Column, tile: int = 448) -> Column:
    """struct(i, j): the grid whose aspect ratio is nearest; of equally near ones a later one if the image has over half its area."""
    ratio, area = width / height, (width * height).cast("double")
    grids = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in TILE_GRIDS])
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(1).alias("i"), F.lit(1).alias("j"))

    def step(best: Column, g: Column) -> Column:
        d = F.abs(ratio - g["i"] / g["j"])
        better = (d < best["d"]) | ((d == best["d"]) & (area > F.lit(0.5 * tile * tile) * g["i"] * g["j"]))
        return F.struct(F.when(better, d).otherwise(best["d"]).alias("d"), F.when(better, g["i"]).otherwise(best["i"]).alias("i"), F.when(better, g["j"]).otherwise(best["j"]).alias("j"))

    return F.aggregate(grids, start, step, lambda b: F.struct(b["i"].alias("i"), b["j"].alias("j")))


def random_subpatch(images: DataFrame, seed: int = 2024) -> DataFrame:
    """images (width, height, ...) with sub_x1, sub_y1, sub_x2, sub_y2: a box that depends on the image's size and the seed alone. Its width and height are drawn first,
    each from 1 on, then its corner from what is left; images without pixels have none."""
    sides = ("sub_x1", "sub_y1", "sub_x2", "sub_y2")
    w, h = images.columns.index("width"), images.columns.index("height")

    def draw(size: tuple[int | None, int | None]) -> tuple[int | None, ...]:
        import random

        if not size[0] or not size[1]:
            return (None,) * 4
        r = random.Random(seed)
        side = [r.randint(1, n) for n in size]
        at = [r.randint(0, n - k) for n, k in zip(size, side, strict=True)]
        return (*at, *(a + k for a, k in zip(at, side, strict=True)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes = [draw(x) for x in zip(b.column(w).to_pylist(), b.column(h).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in boxes], pa.int64()) for k in range(4))], names=[*b.schema.names, *sides])

    schema = images.withColumns({n: F.lit(None).cast("long") for n in sides}).schema
    return images.mapInArrow(add, schema)


def sides_of_ranges(w_range: Column, h_range: Column) -> Box:
    """Corner, width and height of the box with these ranges (arrays of begin and end)."""
    return w_range[0], h_range[0], w_range[1] - w_range[0], h_range[1] - h_range[0]


def whole(boxes: Column) -> Column:
    """Boxes (array<array<number>>) in whole numbers."""
    return F.transform(boxes, lambda b: b.cast("array<int>"))


def cue_boxes(cx: Column, cy: Column, w: Column, h: Column, scale: float, low: Column, high: Column, width: Column, height: Column) -> tuple[Box, Box]:
    """A cue given by centre and sides, scaled and clamped to [low, high]; and the same in pixels of an image, high standing for its whole side."""
    box = scaled(corners(cx, cy, w, h), scale, low, high)
    return box, tuple((v / high * size).cast("int") for v, size in zip(box, (width, height) * 2, strict=True))
