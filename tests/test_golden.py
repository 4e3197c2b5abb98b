"""Hand-made cases."""

import pytest
from pyspark.sql import functions as F

from skysift.functions import geometry as G
from skysift.functions import text as X
from skysift.operators import evaluation as E
from skysift.operators import patches as P
from skysift.operators import retrieval as R
from skysift.sources import tables as S


def images(spark, *sizes):
    return spark.createDataFrame([(f"i{k}", w, h) for k, (w, h) in enumerate(sizes)], "image string, width long, height long")


@pytest.mark.parametrize(("method", "size", "n"), [("vit", (11500, 7500), 442), ("grid", (11500, 7500), 385), ("cc", (11500, 7500), 661), ("cc", (1000, 800), 661), ("cc", (4000, 300), 661), ("cc", (100, 60), 744)])
def test_patch_counts(spark, method, size, n):
    rows = P.patchify(images(spark, size), method).collect()
    assert len(rows) == n if method != "grid" else len(rows) <= n
    assert all(0 <= r.x1 < r.x2 <= size[0] and 0 <= r.y1 < r.y2 <= size[1] for r in rows)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        P.patchify(images(spark, (10, 10)), "hex")


@pytest.mark.parametrize(("output", "choices", "letter"), [("The best answer is (B).", ["(A) x"], "B"), ("", ["(A) x", "(B) y"], "A"), ("y", ["(A) x", "(B) y"], "B"), ("the answer is c", ["(A) c"], "A"), ("w " * 11, ["(A) x"], "")])
def test_answers(spark, output, choices, letter):
    df = spark.createDataFrame([(output, choices)], "o string, c array<string>")
    assert df.select(X.answer_letter(F.col("o"), F.col("c"))).first()[0] == letter


def test_boxes(spark):
    one = spark.range(1)
    lit = lambda *v: tuple(F.lit(x) for x in v)
    assert tuple(one.select(*G.enlarged(lit(10, 10, 30, 30), 2, F.lit(35), F.lit(100))).first()) == (0, 0, 35, 40)
    assert one.select(G.region(lit(0, 0, 10, 10), F.lit(90), F.lit(90))).first()[0] == "Top-left"
    assert one.select(G.region(lit(0, 0, 90, 90), F.lit(90), F.lit(90))).first()[0] == "Top-left"
    assert one.select(*X.box_of(F.lit("<box>[[1, 2,3,4]]</box>"))).first()[0] == 1.0
    assert one.select(X.last_list(F.lit('x [a] ["b","c"]'))).first()[0] == ["b", "c"]


def test_votes(spark):
    sims = spark.createDataFrame([(0, 0, 0, 0.6), (0, 0, 1, 0.4), (0, 1, 1, 0.7), (0, 1, 2, 0.3), (0, 2, 3, 0.8), (0, 2, 1, 0.2)], "question_id long, pos int, patch_idx int, prob double")
    cues = R.vote(sims).orderBy("cue_pos").collect()
    assert [(c.patch_idx, c.confidence) for c in cues] == [(1, 0.7), (0, 0.6), (3, 0.8)]
    assert [c.confidence for c in R.above(R.vote(sims), 0.6).orderBy("cue_pos").collect()] == [0.8, 0.7]


def test_cluster_mean(spark):
    pts = spark.createDataFrame([("l", 0, [1.0, 0.0]), ("l", 1, [0.99, 0.1]), ("l", 2, [0.0, 1.0]), ("m", 3, [0.5, 0.5])], "label string, id int, vec array<double>")
    got = {r.label: r.vec for r in R.cluster_mean(pts, ["label"]).collect()}
    n = (0.99**2 + 0.1**2) ** 0.5
    assert got["l"] == pytest.approx([(1 + 0.99 / n) / 2, 0.1 / n / 2]) and got["m"] == pytest.approx([0.5**0.5] * 2)
    raw = {r.label: r.vec for r in R.cluster_mean(pts, ["label"], normalise=False).collect()}
    assert raw["l"] == pytest.approx([0.995, 0.05]) and raw["m"] == pytest.approx([0.5, 0.5])


def test_slices(spark):
    ids = spark.range(10).toDF("id")
    assert sorted(r["count"] for r in E.assign(ids, ["id"], 4).groupBy("runner").count().collect()) == [2, 2, 3, 3]
    assert sorted(r["count"] for r in E.chunk(ids, ["id"], 4).groupBy("chunk").count().collect()) == [1, 3, 3, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"Question_id": "a", "Ground truth": ["A", "B"], "Answer choices": ["(A) x"]}, {"Question_id": "b", "Ground truth": "C"}]')
    rows = {r.question_id: r.ground_truth for r in S.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert rows == {"a": ["A", "B"], "b": ["C"]}
    with pytest.raises(ValueError):
        S.read_questions(spark, "q.txt")
    (tmp_path / "a.csv").write_text("file_name,text\nx.jpg,hello\n")
    assert S.read_metadata(spark, [str(tmp_path / "a.csv")] * 2).count() == 2
    labels = spark.createDataFrame([("a", [1.0])], "label string, vec array<double>")
    assert S.create_labels(labels, str(tmp_path / "l")) and not S.create_labels(labels, str(tmp_path / "l"))
    (tmp_path / "s.yaml").write_text("path_T: 0.3\nmode: retrieval\n")
    assert S.load_settings(str(tmp_path / "s.yaml"), path_T=0.5) == {"path_T": 0.5, "mode": "retrieval"}
