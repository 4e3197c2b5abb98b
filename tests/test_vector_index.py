"""The stored index against brute force, and what a write that died leaves."""

from pathlib import Path

import numpy as np
import pytest

from skysift.operators import retrieval as R
from skysift.sources import batches as B
from skysift.sources import tables as S
from skysift.sources import vector_index as I


def test_search_agrees_with_brute_force_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    monkeypatch.setattr(I, "PIVOTS", 12)
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 6)) * 5
    v = middle[rng.integers(0, 12, 600)] + rng.normal(size=(600, 6)) * 0.2
    v[7] = v[300]  # a tie
    labels = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(999, None)], "label_id long, vec array<double>").repartition(3)
    t = np.concatenate([v[[7, 50, 99]] + 0.01, rng.normal(size=(3, 6))])
    phrases = spark.createDataFrame([(k // 2, k % 2, x.tolist()) for k, x in enumerate(t)] + [(9, 0, None)], "question_id long, pos int, vec array<double>")
    path = str(tmp_path / "index")
    assert I.create(labels.where("label_id < 400"), path) and not I.create(labels, path)
    I.append(labels.where("label_id >= 400"), path)
    found = I.nearest(phrases, I.open_index(spark, path), 4)
    want = {(r.question_id, r.pos, r["rank"]): (r.label_id, r.dist) for r in R.nearest(phrases, labels, 4).collect()}
    got = {(r.question_id, r.pos, r["rank"]): (r.label_id, r.dist) for r in found.near.collect()}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert found.read < 0.5 * found.all
    close = I.nearest(phrases, I.open_index(spark, path), 4, 0.01).near
    assert {(r.question_id, r.pos, r["rank"]) for r in close.collect()} == {k for k, x in want.items() if x[1] <= 0.01}


def test_fewer_labels_than_neighbours_and_none(spark, tmp_path):
    labels = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "label_id long, vec array<double>")
    phrases = spark.createDataFrame([(1, 0, [0.0, 2.0])], "question_id long, pos int, vec array<double>")
    path = str(tmp_path / "index")
    I.create(labels, path)
    assert [(r.label_id, r.dist) for r in I.nearest(phrases, I.open_index(spark, path), 3).near.orderBy("rank").collect()] == [(1, 1.0), (2, 5.0)]
    assert I.nearest(phrases.limit(0), I.open_index(spark, path), 3).near.count() == 0


def found_by(df):
    return sorted((r.question_id, r.pos, r["rank"], r.label_id, round(r.dist, 9)) for r in df.collect())


def test_phrases_are_not_copied_for_each_block(spark, tmp_path, monkeypatch):
    """Where few blocks can be ruled out most phrases meet most blocks; what is written between steps still grows with the input, not with their pairs."""
    monkeypatch.setattr(I, "BLOCK", 8)
    rng = np.random.default_rng(5)
    v, t = rng.normal(size=(800, 64)), rng.normal(size=(200, 64))
    labels = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "label_id long, vec array<double>")
    phrases = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(t)], "question_id long, pos int, vec array<double>")
    path, shared = str(tmp_path / "index"), Path(spark.conf.get("spark.checkpoint.dir"))
    I.create(labels, path)
    before = {f for f in shared.rglob("*") if f.is_file()}
    found = I.nearest(phrases, I.open_index(spark, path), 3)
    got = found_by(found.near)
    written = sum(f.stat().st_size for f in shared.rglob("*") if f.is_file() and f not in before)
    assert got == found_by(R.nearest(phrases, labels, 3)) and found.read > 0.5 * found.all
    assert written < 4 * (v.nbytes + t.nbytes)


def test_small_groups_find_the_same(spark, tmp_path, monkeypatch):
    """Many groups of phrases and of blocks, a block that nearly all phrases probe, ties across blocks, ids that are strings."""
    monkeypatch.setattr(I, "BLOCK", 16)
    monkeypatch.setattr(I, "PIVOTS", 8)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(200, 5)), np.tile([[3.0, 0, 0, 0, 0]], (90, 1))])
    labels = spark.createDataFrame([(f"n{k:03d}", x.tolist()) for k, x in enumerate(v)], "label_id string, vec array<double>").repartition(5)
    t = np.concatenate([v[-60:] + 0.01, rng.normal(size=(40, 5))])
    phrases = spark.createDataFrame([(k // 3, k % 3, x.tolist()) for k, x in enumerate(t)], "question_id long, pos int, vec array<double>").repartition(3)
    path = str(tmp_path / "index")
    I.create(labels, path)
    monkeypatch.setattr(I, "GROUP_BYTES", 800)
    assert found_by(I.nearest(phrases, I.open_index(spark, path), 4).near) == found_by(R.nearest(phrases, labels, 4))


def test_a_vector_that_is_not_finite_hides_no_other(spark, tmp_path):
    labels = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(6)] + [(9, [float("nan"), 0.0])], "label_id long, vec array<double>").coalesce(1)
    phrases = spark.createDataFrame([(1, 0, [1.2, 0.0])], "question_id long, pos int, vec array<double>")
    path = str(tmp_path / "index")
    I.create(labels, path)
    assert [x[3] for x in found_by(I.nearest(phrases, I.open_index(spark, path), 3).near)] == [1, 2, 0]


def test_half_written_is_not_whole(spark, tmp_path):
    labels = spark.createDataFrame([(1, [0.0, 1.0])], "label_id long, vec array<double>")
    path = tmp_path / "index"
    with pytest.raises(FileNotFoundError):
        I.open_index(spark, str(path))
    I.create(labels, str(path))
    whole = next((path / "batches").iterdir())
    dead = path / "batches" / "batch-dead"
    dead.mkdir()
    (dead / "part-0.parquet").write_bytes(next(whole.glob("*.parquet")).read_bytes())
    assert B.batches(spark, f"{path}/batches") == [f"file:{whole}"] and I.open_index(spark, str(path)).blocks.count() == 1
    (whole / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        I.open_index(spark, str(path))
    assert I.create(labels, str(path)) and I.open_index(spark, str(path)).blocks.count() == 1
    table = tmp_path / "labels"
    table.mkdir()
    assert S.create_labels(labels, str(table)) and not S.create_labels(labels, str(table)) and spark.read.parquet(str(table)).count() == 1
