"""Patches as files: what a job leaves when it ends, and when it doesn't; padding and resizing against plain arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import patches as P
from skysift.sources import images as I
from skysift.sources import tables as S

IMAGE = "image string, path string, width int, height int, pixels binary"


def image(w, h, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)


def test_patches_are_written_and_read_back(spark, tmp_path):
    a, b = image(37, 23), image(20, 41, 1)
    images = spark.createDataFrame([("a", "x/a.jpg", 37, 23, a.tobytes()), ("b", "x/b.tif", 20, 41, b.tobytes())], IMAGE)
    boxes = P.patchify(images.select("image", "width", "height"), "cc_padded").where("x1 < x2 AND y1 < y2")
    assert boxes.agg(F.max("x2"), F.max("y2")).first() == (40, 50)
    folder = tmp_path / "out"
    folder.mkdir()
    wide = I.padded(images)
    assert {(r.image, r.left, r.top, r.width, r.height) for r in wide.collect()} == {("a", 1, 3, 40, 30), ("b", 0, 4, 20, 50)}
    listed = I.write_patches(spark, wide, boxes, str(folder)).collect()
    assert sorted(p.name for p in folder.iterdir()) == sorted(r.name for r in listed) and len(listed) == boxes.count() > 20
    whole = {"a": np.zeros((30, 40, 3), np.uint8), "b": np.zeros((50, 20, 3), np.uint8)}
    whole["a"][3:26, 1:38], whole["b"][4:45, :] = a, b
    back = {r.path.rsplit("/", 1)[1]: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3) for r in S.open_images(spark, str(folder)).collect()}
    for r in listed:
        assert (back[r.name] == whole[r.image][r.y1 : r.y2, r.x1 : r.x2]).all()


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k}.png", b"x" * k) for k in range(6)], "name string, png binary").repartition(3)
    with pytest.raises(Exception, match="stop here"):
        I.write_png(rows.withColumn("png", F.when(F.col("name") == "f5.png", F.raise_error(F.lit("stop here"))).otherwise(F.col("png"))), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(Exception, match="repeat"):
        I.write_png(rows.unionByName(rows.where("name = 'f2.png'")), str(tmp_path))
    with pytest.raises(Exception, match="no name of a file"):
        I.write_png(spark.createDataFrame([("../f.png", b"x")], "name string, png binary"), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    I.write_png(rows, str(tmp_path))
    with pytest.raises(Exception, match="f0.png|File exists|Exists"):
        I.write_png(rows.where("name = 'f0.png'").withColumn("png", F.lit(b"new")), str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {f"f{k}.png": b"x" * k for k in range(6)}
    I.write_png(rows.where("name = 'f0.png'").withColumn("png", F.lit(b"new")), str(tmp_path), overwrite=True)
    assert (tmp_path / "f0.png").read_bytes() == b"new" and len(list(tmp_path.iterdir())) == 6


def test_crops_of_many_patches_in_parts(spark):
    x = image(30, 20)
    images = spark.createDataFrame([("a", "a.png", 30, 20, x.tobytes())], IMAGE)
    boxes = spark.createDataFrame([("a", k, k, 0, k + 5, 4) for k in range(25)] + [("a", 99, 3, 3, 3, 9), ("none", 1, 0, 0, 1, 1)], "image string, patch_idx int, x1 int, y1 int, x2 int, y2 int")
    rows = I.crops(images, boxes, most=4).collect()
    assert sorted(r.patch_idx for r in rows) == list(range(25))
    assert all(bytes(r.png) == S.png(np.ascontiguousarray(x[0:4, r.x1 : r.x2])) for r in rows)


def test_resized_and_normalised(spark):
    x = image(8, 6)
    images = spark.createDataFrame([("a", "a.png", 8, 6, x.tobytes())], IMAGE)
    same = I.resized(images, 8, 6).first()
    assert bytes(same.pixels) == x.tobytes()
    half = I.resized(images, 4, 3).first()
    blocks = x.reshape(3, 2, 4, 2, 3).astype(float).mean((1, 3))
    assert (half.width, half.height) == (4, 3) and np.abs(np.frombuffer(half.pixels, np.uint8).reshape(3, 4, 3) - blocks).max() <= 0.5
    tensor = I.normalised(images, (0.5, 0.4, 0.3), (0.2, 0.3, 0.4)).first().tensor
    want = ((x / 255 - (0.5, 0.4, 0.3)) / (0.2, 0.3, 0.4)).transpose(2, 0, 1).ravel()
    assert tensor == pytest.approx(want.tolist(), abs=1e-5)
