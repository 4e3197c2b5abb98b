"""The tiers on hand-made questions: who enters each, what is found, and what is never run."""

import pytest
from pyspark.sql import functions as F

from skysift.operators import retrieval as R
from skysift.operators import waterfall as W

X, Y, Z, W4 = ([1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0])
PHRASES = "question_id long, pos int, vec array<double>, query_vec array<double>"


@pytest.fixture(scope="module")
def given(spark):
    """Question 1 finds its patch, 2 a label of the first store, 3 a caption of the second, 4 nothing; 5 has no phrases."""
    phrases = spark.createDataFrame([(1, 0, X, Z), (1, 1, X, Z), (2, 0, [0.1, 0.1, 0.1, 0.1], Y), (3, 0, [0.1, 0.1, 0.1, 0.1], X), (4, 0, [0.1, 0.1, 0.1, 0.1], W4)], PHRASES)
    patches = spark.createDataFrame([(q, 10 * q + k, v, 10 * k, 0, 10 * k + 10, 20) for q in (1, 2, 3, 4) for k, v in enumerate((X, Y, Z, W4))], "question_id long, patch_idx long, vec array<double>, x1 int, y1 int, x2 int, y2 int")
    images = "pos long, img_name string, label string, vec array<double>"
    labels = "label string, vec array<double>"
    lrsd = W.store(spark.createDataFrame([(0, "a", "roof", Z), (1, "b", "roof", [0.0, 0.0, 2.0, 0.0]), (2, "c", "road", X)], images), spark.createDataFrame([("roof", Y), ("road", [0.0, 5.0, 5.0, 5.0])], labels))
    crsd = W.store(spark.createDataFrame([(0, "d", "a red car", W4)], images), spark.createDataFrame([("a red car", X)], labels))
    questions = spark.createDataFrame([(q, "Where?", ["(A) a"], "color", 100, 100) for q in (1, 2, 3, 4, 5)], "question_id long, text string, choices array<string>, category string, width int, height int")
    return questions, phrases, patches, lrsd, crsd


def test_each_way_is_met_once(given, monkeypatch):
    """By rerank; the other reductions are queries."""
    settings, asked, nearest = W.Settings(0.9, 0.5, 0.5, "rerank"), [], R.nearest
    monkeypatch.setattr(R, "nearest", lambda phrases, *a: (asked.append(sorted(r.question_id for r in phrases.collect())), nearest(phrases, *a))[1])
    prompts, got = W.retrieved_prompts(*given, settings, "Pick.")
    assert got.entered == {"Fast": 5, "Slow-LRSD": 4, "Slow-CRSD": 3, "Zero-shot": 2}
    assert asked == [[2, 3, 4], [3, 4]]  # labels are searched for those alone whom the tier before left over
    assert {r.question_id: r.path for r in got.paths.collect()} == {1: "Fast", 2: "Slow-LRSD", 3: "Slow-CRSD", 4: "Zero-shot", 5: "Zero-shot"}
    first = {r.question_id: (r.path, r.patch_idx) for r in got.evidence.where("cue_pos = 0").collect()}
    assert first == {1: ("Fast", 10), 2: ("Slow-LRSD", 22), 3: ("Slow-CRSD", 33)}
    rows = {r.question_id: r for r in prompts.collect()}
    assert rows[1].prompt.startswith("<image>") and tuple(rows[2].boxes[0]) == (200, 0, 300, 200) and rows[4].boxes == rows[5].boxes == []
    assert rows[3].path == "Slow-CRSD" and rows[5].path == "Zero-shot"


def test_tiers_that_none_enters_are_not_run(given, monkeypatch):
    questions, *rest = given
    monkeypatch.setattr(W, "slow", lambda *_: pytest.fail("no question is left"))
    got = W.retrieve(questions.where("question_id = 1"), *rest, W.Settings(0.9, 0.5, 0.5))
    assert got.entered == {"Fast": 1, "Slow-LRSD": 0, "Slow-CRSD": 0, "Zero-shot": 0} and got.evidence.count() == 1
    none = W.retrieve(questions.limit(0), *rest, W.Settings(0.9, 0.5, 0.5))
    assert none.evidence.count() == none.paths.count() == 0


def test_last_phrase_and_last_vector_win(spark):
    phrases = spark.createDataFrame([(1, 0, X), (1, 1, X), (2, 0, Y)], "question_id long, pos int, vec array<double>")
    labels = spark.createDataFrame([("l", X), ("m", [1.0, 0.1, 0.0, 0.0])], "label string, vec array<double>")
    got = {(r.question_id, r.label): (r.pos, r.place) for r in W.matched(phrases, labels, 2, 0.5).collect()}
    assert got == {(1, "l"): (1, 0), (1, "m"): (1, 1)}
    lists = spark.createDataFrame([(["a", "b", "a"], ["l", "m", "m"], [X, Y, Z])], "img_names array<string>, labels array<string>, vecs array<array<double>>")
    place = W.store(W.entries_of(lists), labels)
    assert sorted((r.label, r.pos, tuple(r.vec)) for r in place.images.collect()) == [("l", 0, tuple(Z)), ("m", 1, tuple(Y)), ("m", 2, tuple(Z))]
    short = lists.withColumn("vecs", F.slice("vecs", 1, 2))
    with pytest.raises(Exception, match="unequal length: 3, 3, 2"):
        W.entries_of(short).collect()
