"""Images out: patches as PNG files by a writer that commits, many crops of one decoded image, padding and resizing.

The writer is a data source: each task writes its files into a folder of its own; when all tasks are done the driver moves them into place,
and when one fails for good it removes them, so a reader never finds the files of half a job. Tasks that are run again or twice write
to folders of their own, of which only the committed ones count.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from skysift.sources.tables import png

SIDES = ("x1", "y1", "x2", "y2")


@dataclass
class Files(WriterCommitMessage):
    """What a task has written: its folder, and the files' names in it."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    """Writes the bytes of column `png` under the name in column `name`, below the folder of option `path`, a folder that the driver and all executors share."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://").rstrip("/"), overwrite
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        self.at = [schema.fieldNames().index(n) for n in ("name", "png")]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder, names = f"{self.job}/{uuid.uuid4().hex}", []
        os.makedirs(folder)
        for row in rows:
            name, data = (row[k] for k in self.at)
            if not name or data is None or name != os.path.basename(name) or name.startswith("_"):
                raise ValueError(f"{name!r} is no name of a file, or has no bytes")
            with open(f"{folder}/{name}", "xb") as f:  # a name that repeats in a task is an error
                f.write(data)
            names.append(name)
        return Files(folder, names)

    def commit(self, messages: list) -> None:
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"{len(names) - len(set(names))} names repeat")
        if not self.overwrite and (there := next((n for n in names if os.path.exists(f"{self.path}/{n}")), None)):
            self.abort(messages)
            raise FileExistsError(f"{self.path}/{there}")
        for m in messages:
            for n in m.names if m else ():
                os.replace(f"{m.folder}/{n}", f"{self.path}/{n}")
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class PngFiles(DataSource):
    """df.write.format("png_files").option("path", folder).save(): one file a row of (name, png)."""

    @classmethod
    def name(cls) -> str:
        return "png_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"], schema, overwrite)


def write_png(patches: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes the patches (name, png) as files into folder. Names that repeat, or that are there already unless overwrite, are an error, and then no file is written."""
    patches.sparkSession.dataSource.register(PngFiles)
    patches.select("name", "png").write.format("png_files").option("path", folder).mode("overwrite" if overwrite else "append").save()


def stem_of(path: str) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def crops(images: DataFrame, patches: DataFrame, most: int = 1000) -> DataFrame:
    """(image, patch_idx, x1, y1, x2, y2, name, png): each patch cut from its image. images: image, path, width, height, pixels; patches: image, patch_idx, x1, y1, x2, y2. An image's pixels are sent once for each `most` of its
    patches and decoded once for all of them. What lies outside the image is black; patches without extent, and those of images that aren't there, are left out."""
    boxes = patches.where("x1 < x2 AND y1 < y2").select("image", F.struct("patch_idx", *[F.col(c).cast("int").alias(c) for c in SIDES]).alias("box"))
    grouped = boxes.withColumn("__part", F.expr(f"pmod(hash(box), greatest(1, cast(ceil(count(*) over (partition by image) / {most}) as int)))")).groupBy("image", "__part").agg(F.collect_list("box").alias("boxes"))
    rows = grouped.join(images.select("image", stem_of("path").alias("__stem"), "width", "height", "pixels"), "image").select("image", "__stem", "width", "height", "pixels", "boxes")
    kinds = {n: patches.schema[n].dataType.simpleString() for n in ("image", "patch_idx")}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                stem, w, h, data, found = (b.column(c)[row].as_py() for c in range(1, 6))
                whole, out = np.frombuffer(data, np.uint8).reshape(h, w, 3), []
                for box in found:
                    x1, y1, x2, y2 = (box[c] for c in SIDES)
                    own = np.zeros((y2 - y1, x2 - x1, 3), np.uint8)
                    left, top, right, low = max(x1, 0), max(y1, 0), min(x2, w), min(y2, h)
                    if left < right and top < low:
                        own[top - y1 : low - y1, left - x1 : right - x1] = whole[top:low, left:right]
                    out.append(png(own))
                columns = [pa.array([b.column(0)[row].as_py()] * len(found), b.column(0).type)]
                columns += [pa.array([x["patch_idx"] for x in found], b.column(5).type.value_type.field("patch_idx").type)]
                columns += [pa.array([x[c] for x in found], pa.int32()) for c in SIDES]
                names = [f"{stem}_{x['x1']}-{x['y1']}-{x['x2']}-{x['y2']}.png" for x in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names), pa.array(out, pa.binary())], names=["image", "patch_idx", *SIDES, "name", "png"])

    return rows.mapInArrow(cut, f"image {kinds['image']}, patch_idx {kinds['patch_idx']}, x1 int, y1 int, x2 int, y2 int, name string, png binary")


def padded(images: DataFrame, parts: int = 10) -> DataFrame:
    """images (width, height, pixels, ...) with sides rounded up to multiples of `parts`, the picture in the middle of black; left and top say where it begins."""
    return mapped(images, lambda x: centred(x, -(-x.shape[1] // parts) * parts, -(-x.shape[0] // parts) * parts), {"left": lambda w, h: (-(-w // parts) * parts - w) // 2, "top": lambda w, h: (-(-h // parts) * parts - h) // 2})


def centred(x: np.ndarray, width: int, height: int) -> np.ndarray:
    out = np.zeros((height, width, 3), np.uint8)
    top, left = (height - x.shape[0]) // 2, (width - x.shape[1]) // 2
    out[top : top + x.shape[0], left : left + x.shape[1]] = x
    return out


def resized(images: DataFrame, width: int, height: int) -> DataFrame:
    """images (width, height, pixels, ...) at the given size, by bilinear interpolation of pixel centres."""
    return mapped(images, lambda x: bilinear(x, width, height), {})


def bilinear(x: np.ndarray, width: int, height: int) -> np.ndarray:
    def spots(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    (t, b, v), (l, r, u) = spots(height, x.shape[0]), spots(width, x.shape[1])  # noqa: E741
    rows = x[t].astype(np.float64) * (1 - v)[:, None, None] + x[b] * v[:, None, None]
    return np.rint(rows[:, l] * (1 - u)[:, None] + rows[:, r] * u[:, None]).astype(np.uint8)


def normalised(images: DataFrame, mean: tuple[float, ...], std: tuple[float, ...]) -> DataFrame:
    """images (width, height, pixels, ...) with tensor: array<float>, channel by channel and row by row, (value / 255 - mean) / std."""
    at = images.columns.index("pixels")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [((np.frombuffer(x, np.uint8).reshape(-1, 3) / 255 - mean) / std).T.ravel().astype(np.float32) if x is not None else None for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "tensor"])

    return images.mapInArrow(add, images.withColumn("tensor", F.lit(None).cast("array<float>")).schema)


def mapped(images: DataFrame, change, more: dict) -> DataFrame:
    """images with width, height and pixels as change() leaves them, and columns of whole numbers that follow from the size before."""
    w, h, p = (images.columns.index(n) for n in ("width", "height", "pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = list(zip(b.column(w).to_pylist(), b.column(h).to_pylist(), strict=True))
            made = [change(np.frombuffer(x, np.uint8).reshape(size[1], size[0], 3)) for x, size in zip(b.column(p).to_pylist(), sizes, strict=True)]
            columns = list(b.columns)
            columns[w], columns[h] = pa.array([x.shape[1] for x in made], b.column(w).type), pa.array([x.shape[0] for x in made], b.column(h).type)
            columns[p] = pa.array([x.tobytes() for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([f(*size) for size in sizes], pa.int32()) for f in more.values())], names=[*b.schema.names, *more])

    return images.mapInArrow(run, images.withColumns({n: F.lit(None).cast("int") for n in more}).schema)


def write_patches(spark: SparkSession, images: DataFrame, patches: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Cuts all patches, writes them as files into folder, and gives (image, patch_idx, x1, y1, x2, y2, name) of what was written."""
    write_png(crops(images, patches), folder, overwrite)
    named = patches.where("x1 < x2 AND y1 < y2").join(images.select("image", stem_of("path").alias("__stem")), "image")
    return named.withColumn("name", F.concat("__stem", F.lit("_"), F.concat_ws("-", *SIDES), F.lit(".png"))).select("image", "patch_idx", *SIDES, "name")
