"""Modes, models, images and the command line, on hand-made cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift import __main__ as cli
from skysift.functions import geometry as G
from skysift.functions import text as X
from skysift.operators import models as M
from skysift.operators import modes as O
from skysift.session import shared_dir
from skysift.sources import images as I
from skysift.sources import tables as S
from skysift.sources import vector_index

PLAIN = "Which? The choices are listed below: \n(A) a\n(B) b\nPick.\nThe best answer is:"
HEAD = "<image>\nAdditional information:\n"
SCHEMA = "question_id long, text string, choices array<string>, category string, width int, height int, gt_toi array<double>"


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(1, "Which?", ["(A) a", "(B) b"], "color", 100, 200, [10.0, 20.0, 31.0, 61.0]), (2, "Which?", ["(A) a", "(B) b"], "count", 100, 200, None), (3, "Which?", ["(A) a", "(B) b"], "Count", 100, 200, [])]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r.question_id: r for r in df.collect()}


def test_plain_and_true_boxes(questions):
    assert {r.prompt for r in O.prompts("baseline", questions, "Pick.").collect()} == {PLAIN}
    got = by_id(O.prompts("detection_gt", questions, "Pick."))
    assert got[1].prompt == HEAD + "Sub-patch 1 at location <box>[[100.00, 100.00, 310.00, 305.00]]</box>: <image>\n" + X.LOOK + PLAIN
    assert tuple(got[1].crops[0]) == (10, 20, 31, 61) and got[2].prompt == got[3].prompt == PLAIN
    wide = by_id(O.prompts("detection_gt", questions, "Pick.", factor=2.0))
    assert tuple(wide[1].crops[0]) == (0, 0, 41, 81)  # centre (20.5, 40.5), sides 42 and 82, clamped
    with pytest.raises(ValueError):
        O.prompts("other", questions, "Pick.")


def test_random_subpatch_draws_the_sides_first(spark, questions):
    r = random.Random(2024)
    w, h = r.randint(1, 100), r.randint(1, 200)
    x, y = r.randint(0, 100 - w), r.randint(0, 200 - h)
    rows = G.random_subpatch(spark.createDataFrame([(100, 200, "t"), (1, 1, "u"), (None, 5, "v"), (0, 5, "v")], "width int, height int, more string")).collect()
    assert [tuple(b[3:]) for b in rows] == [(x, y, x + w, y + h), (0, 0, 1, 1), (None,) * 4, (None,) * 4]
    right = by_id(O.prompts("detection_gt_fake", questions, "Pick."))[1]
    assert tuple(right.boxes[0]) == pytest.approx((x * 10, y * 5, (x + w) * 10, (y + h) * 5)) and tuple(right.crops[0]) == pytest.approx((x, y, x + w, y + h), abs=1)
    fake = by_id(O.prompts("detection_gt_fake", questions, "Pick.", compat=True))[1]
    assert tuple(fake.boxes[0]) == (x, y, x + w, y + h)  # pixels taken for thousandths
    assert tuple(fake.crops[0]) == (int(x / 1000 * 100), int(y / 1000 * 200), int((x + w) / 1000 * 100), int((y + h) / 1000 * 200))


def test_detected_boxes(questions):
    asked = []

    def language():
        return lambda prompts: [" a red roof " if p == "Question: Which?\nWhat is the target of interest in this question? Answer in short phrases only." else "?" for p in prompts]

    def vision():
        return lambda prompts: ["<box>[[100, 200,300,400]]</box>" if i % 2 == 0 and "<ref>a red roof</ref>." in p else "nothing" for i, p in enumerate(prompts)]

    got = by_id(O.prompts("baseline_detection", questions.coalesce(1), "Pick.", language=language, vision=vision))
    assert tuple(got[1].boxes[0]) == (100, 200, 300, 400) and tuple(got[1].crops[0]) == (10, 40, 30, 80) and got[1].target_of_interest == "a red roof"
    assert got[2].prompt == PLAIN and got[2].boxes == [] and not asked


def test_retrieved_evidence(spark, questions):
    cues = spark.createDataFrame([(1, "Fast", 0, 0.2, 10, 20, 30, 40), (1, "Fast", 1, 0.9, 0, 5, 20, 60), (1, "Fast", 2, 0.0, 0, 0, 1, 1), (2, "Slow-LRSD", 0, 0.5, 10, 20, 30, 40), (2, "Slow-LRSD", 1, 0.5, 0, 5, 20, 60)], "question_id long, path string, cue_pos int, confidence double, x1 int, y1 int, x2 int, y2 int")
    got = by_id(O.prompts("retrieval", questions, "Pick.", cues=cues))
    assert [tuple(b) for b in got[1].boxes] == [(0, 25, 200, 300), (100, 100, 300, 200), (0, 25, 300, 300)]
    assert got[1].confidence == pytest.approx([0.9, 0.2, 0.55]) and got[1].path == "Fast"
    assert [tuple(b) for b in got[2].boxes] == [(0, 25, 300, 300)] and got[2].confidence == [0.5]  # count: the union alone
    assert (got[3].prompt, got[3].path, got[3].boxes) == (PLAIN, "Zero-shot", [])
    slip = by_id(O.retrieval(questions, cues, "Pick.", compat=True))
    assert tuple(slip[2].boxes[0]) == (0, 0, 300, 300)
    out = by_id(O.answered("retrieval", questions, "Pick.", lambda: lambda ps: [str(len(p)) for p in ps], cues=cues, batch=2))
    assert out[3].output == str(len(PLAIN))


def test_evidence_is_of_the_first_tier(spark, questions):
    tier = lambda *rows: spark.createDataFrame(list(rows), "question_id long, cue_pos int, patch_idx long, confidence double")
    got = O.evidence(questions, [("Fast", tier((1, 0, 7, 0.9))), ("Slow-LRSD", tier((1, 0, 8, 0.8), (2, 0, 9, 0.7), (2, 1, 9, 0.6), (8, 0, 1, 1.0)))]).collect()
    assert sorted((r.question_id, r.path, r.cue_pos, r.patch_idx) for r in got) == [(1, "Fast", 0, 7), (2, "Slow-LRSD", 0, 9), (2, "Slow-LRSD", 1, 9)]


def test_encoders(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", None, "", "a a"])], "id long, t string")
    got = {r.id: r.vec for r in M.encoded(df, "t", "hashed", batch=2).collect()}
    assert got[1] is None and sum(got[2]) == 0 and sum(got[3]) == max(got[3]) == 2
    with pytest.raises(ValueError):
        M.encoded(df, "t", "unknown")
    cached = spark.createDataFrame([(0, [9.0]), (77, [1.0])], "id long, vec array<double>")
    once = {r.id: r.vec for r in M.encoded_once(df, cached, ["id"], "t", "hashed").collect()}
    assert once.keys() == {0, 1, 2, 3} and once[0] == [9.0] and once[3] == got[3]


def test_phrases_are_asked_again_then_fall_back(spark):
    def model():
        seen = {}

        def ask(prompts):
            out = []
            for p in prompts:
                seen[p] = seen.get(p, 0) + 1
                out.append('x [a] ["roof", "car"]' if p.endswith("good") and seen[p] == 3 else "[]" if seen[p] % 2 else "[broken")
            return out

        return ask

    df = spark.createDataFrame([(1, "good", ["f"]), (2, "bad", ["f", "g"])], "question_id long, text string, own array<string>").coalesce(1)
    got = {r.question_id: r.phrases for r in M.asked_phrases(df, "text", model, "own", tries=4).collect()}
    assert got == {1: ["roof", "car"], 2: ["f", "g"]}
    rows = M.expanded(spark.createDataFrame([(1, ["a", "b", "c"])], "question_id long, phrases array<string>"), lambda: lambda ps: [" same " if p.endswith(("a", "b")) else "other" for p in ps]).collect()
    assert sorted((r.expansion, r.phrase) for r in rows) == [("other", "c"), ("same", "b")]
    assert M.paraphrased(df, "text", lambda: lambda ps: [" new " for _ in ps]).first().paraphrase == "new"
    assert {r.expansion for r in M.expanded(spark.createDataFrame([(1, ["a"])], "question_id long, phrases array<string>")).collect()} == {"a"}


def test_calls_that_raise_lose_their_rows_alone(spark):
    def model():
        def ask(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("refused")
            return ['["x"]' for _ in prompts]

        return ask

    df = spark.createDataFrame([(k, "bad" if k == 3 else "good", ["own"]) for k in range(6)] + [(9, None, ["none"])], "question_id long, text string, own array<string>").coalesce(1)
    asked = M.asked_phrases(df, "text", model, "own", tries=2, batch=4)
    got = {r.question_id: r for r in asked.collect()}
    assert [got[k].phrases for k in (0, 3, 5, 9)] == [["x"], ["own"], ["x"], ["none"]] and [got[k].tries for k in (0, 3, 9)] == [1, 2, 0]
    good, failed = M.split_failed(asked, ["question_id"])
    assert [tuple(r) for r in failed.collect()] == [(3, "RuntimeError: refused")] and good.count() == 6
    said = {r.question_id: (r.paraphrase, r.error) for r in M.paraphrased(df, "text", model).collect()}
    assert said[3] == ("bad", "RuntimeError: refused") and said[0] == ('["x"]', None)
    with pytest.raises(Exception, match="refused"):
        M.replies(df, "text", model).collect()


def test_features_are_encoded_once_and_written_back(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()

    def encoder():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("no vector")
            for t in texts:
                (calls / f"{t}-{len(list(calls.iterdir()))}").touch()
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    named = lambda *names: spark.createDataFrame([(n, n) for n in names], "img_name string, t string").coalesce(1)
    first = M.features(named("a", "bb", "bb", "bad", None), path, ["img_name"], "t", encoder, 2)
    assert first.fresh == 2 and {r.img_name: r.vec for r in first.vectors.collect()} == {"a": [1.0, 1.0], "bb": [2.0, 1.0]}
    assert [tuple(r) for r in first.failed.collect()] == [("bad", "ValueError: no vector")]
    made = len(list(calls.iterdir()))
    again = M.features(named("bb", "a"), path, ["img_name"], "t", encoder)
    assert again.fresh == 0 and again.vectors.count() == 2 and again.failed.count() == 0 and len(list(calls.iterdir())) == made
    dead = tmp_path / "cache" / "batch-dead"  # a run that was killed while it wrote
    spark.createDataFrame([("ccc", [9.0])], "img_name string, vec array<double>").write.parquet(str(dead))
    (dead / "_SUCCESS").unlink()
    more = M.features(named("a", "ccc"), path, ["img_name"], "t", encoder)
    assert more.fresh == 1 and {r.img_name: r.vec for r in more.vectors.collect()} == {"a": [1.0, 1.0], "ccc": [3.0, 1.0]}
    with pytest.raises(ValueError, match="unknown"):
        M.features(named("a"), path, ["img_name"], "t", "unknown")


def test_questions_without_phrases_are_listed(spark, tmp_path):
    def encoder():
        def encode(texts):
            if any("odd" in t for t in texts):
                raise ValueError("odd")
            return [[float(len(t))] for t in texts]

        return encode

    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["a"]), (5, ["odd", "a"])], "question_id long, phrases array<string>")
    got = M.phrase_features(df, str(tmp_path / "c"), encoder, ["{}", "a {}."])
    assert {(r.question_id, r.pos): (r.phrase, r.vec) for r in got.vectors.collect()} == {(1, 0): ("a", [2.5]), (1, 1): ("b", [2.5]), (1, 2): ("a and b", [8.5]), (4, 0): ("a", [2.5])}
    assert {r.question_id: r.error for r in got.failed.collect()} == {2: "no phrases", 3: "no phrases", 5: "ValueError: odd"}


def test_answers_resume_where_they_stopped(spark, tmp_path):
    from skysift.streaming.answers import answer_stream, stream

    schema = spark.createDataFrame([(1, "x")], "question_id long, text string").schema
    out, state, folder = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "in")
    answer = lambda b: b.withColumn("output", F.upper("text"))
    for rows in ([(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, "c")], [(1, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        answer_stream(stream(spark, folder, schema), answer, out, state, ["question_id"]).awaitTermination()  # ends, and is started again
    got = spark.read.schema("question_id long, output string").json(f"{out}/*").collect()
    assert sorted((r.question_id, r.output) for r in got) == [(1, "A"), (2, "B"), (3, "C")]


def test_chosen_phrases_and_small_functions(spark):
    kind = "array<struct<phrase:string,score:double>>"
    df = spark.createDataFrame([([("a b", 0.5), ("c d", 0.4)], [("x", 0.9), ("c d", 0.4), ("a b", 0.1)]), ([("q r", 0.5)], [("x", 0.9), ("y", 0.8)])], f"p {kind}, k {kind}")
    assert [r[0] for r in df.select(X.chosen_phrases(F.col("p"), F.col("k"))).collect()] == [["c d", "x", "a b"], ["x", "y"]]
    lit = lambda *v: [F.lit(float(x)) for x in v]
    one = spark.range(1).select(
        X.region_text(*lit(-3.2, 4.9, 10.7, 20, 45.5)), F.struct(*G.sides_of_ranges(F.array(*lit(1, 5)), F.array(*lit(2, 9)))), G.whole(F.array(F.array(*lit(1.9, 2.2, -3.7, 4)))),
        F.struct(*[v.alias(f"c{k}") for k, v in enumerate(G.cue_boxes(*lit(500, 500, 100, 200), 2.0, F.lit(0.0), F.lit(1000.0), F.lit(50), F.lit(60))[1])]), X.result_parts(F.lit("d_r_m_cc_clip_0.5_0.3_0.5_mean.jsonl"))["reduce_fn"],
    ).first()
    assert one[0] == "<0><4><10><20>|<45>" and tuple(one[1]) == (1, 2, 4, 7) and one[2] == [[1, 2, -3, 4]] and tuple(one[3]) == (20, 18, 30, 42) and one[4] == "mean"
    assert len(set(X.TEMPLATES)) == 80


def test_two_places_agree_with_python(spark):
    rng = random.Random(3)
    values = [0.0, 0.125, 0.375, 2.675, 1.005, 999.995, 3.125, -0.001, -2.5, 12345678.905] + [rng.randint(0, 9_999_999) / 1000 for _ in range(500)] + [rng.random() * 1000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(X.two_places(F.col("x"))).collect()] == [f"{v:.2f}" for v in values]


def test_images_are_read_cut_and_written(spark, tmp_path):
    pixels = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(S.png(pixels))
    (tmp_path / "sub" / "b.png").write_bytes(b"no image")
    got = S.open_images(spark, str(tmp_path)).collect()
    assert len(got) == 1 and (got[0].width, got[0].height) == (7, 5) and bytes(got[0].pixels) == pixels.tobytes()
    assert S.png_sizes(spark, str(tmp_path)).where("path LIKE '%a.png'").select("width", "height").collect() == [(7, 5)]
    assert S.list_images(spark, str(tmp_path)).count() == 2 and S.list_folders(spark, str(tmp_path)).count() == 1
    images = S.open_images(spark, str(tmp_path)).withColumn("image", F.lit("a"))
    boxes = spark.createDataFrame([("a", 0, 1, 1, 4, 3), ("a", 1, 6, 4, 9, 6)], "image string, patch_idx int, x1 int, y1 int, x2 int, y2 int")
    out = {r.patch_idx: r for r in I.crops(images, boxes).collect()}
    outside = np.zeros((2, 3, 3), np.uint8)
    outside[0, 0] = pixels[4, 6]
    assert out[0].name == "a_1-1-4-3.png" and bytes(out[0].png) == S.png(np.ascontiguousarray(pixels[1:3, 1:4])) and bytes(out[1].png) == S.png(outside)


def test_shards_need_their_text(spark, tmp_path):
    spark.createDataFrame([("x/a.jpg", [1.0]), ("y/b.jpg", [2.0])], "img_name string, feat array<double>").write.parquet(str(tmp_path / "s"))
    shards = S.read_shards(spark, str(tmp_path / "s"))
    texts = spark.createDataFrame([(0, "a.jpg", "old"), (1, "a.jpg", "new"), (2, "b.jpg", "b")], "pos int, img_name string, text string")
    assert {(r.img_name, r.text) for r in S.joined_metadata(shards, texts).collect()} == {("a.jpg", "new"), ("b.jpg", "b")}
    with pytest.raises(Exception, match="no text for b.jpg"):
        S.joined_metadata(shards, texts.where("pos < 2")).collect()
    S.write_store(shards, str(tmp_path / "w"), by=["img_name"])
    assert S.read_store(spark, str(tmp_path / "w")).count() == 2


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("a", 900, 500)], "image string, width long, height long").write.parquet(str(tmp_path / "i"))
    cli.main(["patches", str(tmp_path / "i"), str(tmp_path / "p"), "--method", "vit"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
    rows = [{"Question_id": "1", "Task": "Perception", "Subtask": "s", "Category": "color", "Answer choices": ["(A) x"], "Ground truth": "A", "output": "A"}, {"Question_id": "2", "Task": "Perception", "Subtask": "t", "Category": "color", "Answer choices": ["(A) x"], "Ground truth": ["A"], "output": "E"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cli.main(["accuracy", str(tmp_path / "a.jsonl"), str(tmp_path / "acc"), "--subtask", "s"])
    assert spark.read.parquet(str(tmp_path / "acc")).where("level = 7").first().accuracy == 1.0
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "d_s_m_cc_clip_0.3_0.1_0.5_mean.jsonl").write_text("{")
    cli.main(["sweep", str(tmp_path / "results"), str(tmp_path / "sweep"), "--items", "2"])
    assert spark.read.parquet(str(tmp_path / "sweep")).first().reason == "1 unreadable lines"
    spark.createDataFrame([(1, [0.0, 1.0])], "label_id long, vec array<double>").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string").write.parquet(str(tmp_path / "t"))
    for k in (1, 2):
        cli.main(["index", str(tmp_path / "l"), str(tmp_path / "index"), str(tmp_path / f"added{k}")])
        assert vector_index.open_index(spark, str(tmp_path / "index")).blocks.count() == k
        cli.main(["encode", str(tmp_path / "t"), str(tmp_path / "cache"), str(tmp_path / f"vectors{k}")])
    assert spark.read.parquet(str(tmp_path / "vectors2")).count() == 2 and len(list((tmp_path / "cache").iterdir())) == 1
    with pytest.raises(SystemExit):
        cli.main(["query", "none", "x", "y"])


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
