"""The ways to answer a question, as tables of prompts: plain, with a located box, with a detected one, and with retrieved evidence.

questions: question_id, text, choices array<string>, category, width, height (and gt_toi array<double>, a box in pixels). Each
mode gives one row a question: question_id, prompt, boxes (in thousandths, as the prompt says them), crops (the same in
pixels, to be cut from the image), confidence (of each box), path. Models come as factories of callables (see models).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions import geometry as G
from skysift.functions import text as X
from skysift.operators import models as M

SIDES = ("x1", "y1", "x2", "y2")
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
MODES = ("baseline", "baseline_detection", "detection_gt", "detection_gt_fake", "retrieval")


def question(instruction: str) -> Column:
    return X.question_prompt(F.col("text"), F.col("choices"), instruction)


def boxed(box: list[Column] | tuple[Column, ...]) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(box, SIDES, strict=True)])


def result(df: DataFrame, instruction: str, boxes: Column, confidence: Column, path: Column) -> DataFrame:
    """Prompts with evidence where there are boxes, else plain ones."""
    none = F.array().cast(f"array<{BOX}>")
    held = df.withColumns({"__b": F.coalesce(boxes, none), "__c": F.coalesce(confidence, F.array().cast("array<double>")), "__p": path})
    crop = lambda b: F.struct(*[G.pixels(b[n], F.col(size)).alias(n) for n, size in zip(SIDES, ("width", "height") * 2, strict=True)])
    plain = question(instruction)
    prompt = F.when(F.size("__b") > 0, X.evidence_question(F.col("__b"), plain)).otherwise(plain)
    return held.select("question_id", prompt.alias("prompt"), F.col("__b").alias("boxes"), F.transform("__b", crop).alias("crops"), F.col("__c").alias("confidence"), F.col("__p").alias("path"))


def baseline(questions: DataFrame, instruction: str) -> DataFrame:
    """The question alone."""
    return result(questions, instruction, F.lit(None), F.lit(None), F.lit("baseline"))


def detection_gt(questions: DataFrame, instruction: str, factor: float = 1.0) -> DataFrame:
    """The true box, enlarged about its centre; questions without one are plain."""
    true = tuple(F.get("gt_toi", k) for k in range(4))
    box = G.enlarged(true, factor, F.col("width"), F.col("height"))
    share = [v.cast("int") / F.col(size) * 1000 for v, size in zip(box, ("width", "height") * 2, strict=True)]
    return result(questions, instruction, F.when(F.size("gt_toi") == 4, F.array(boxed(share))), F.lit(None), F.lit("detection_gt"))


def detection_gt_fake(questions: DataFrame, instruction: str, compat: bool = False) -> DataFrame:
    """A box that depends on the image's size alone; images without pixels have none. compat reproduces a known slip of earlier results: the box's pixels are taken for thousandths."""
    made = G.random_subpatch(questions)
    sides = [F.col(f"sub_{n}") if compat else F.col(f"sub_{n}") / F.col(size) * 1000 for n, size in zip(SIDES, ("width", "height") * 2, strict=True)]
    return result(made, instruction, F.when(F.col("sub_x1").isNotNull(), F.array(boxed(sides))), F.lit(None), F.lit("detection_gt_fake"))


def baseline_detection(questions: DataFrame, instruction: str, language: Callable[[], M.Ask], vision: Callable[[], M.Ask], batch: int = 16) -> DataFrame:
    """A language model names the target, a vision model its box; where the reply holds no box, the question is plain."""
    asked = questions.withColumn("__target", X.target_prompt(F.col("text")))
    named = M.replies(asked, "__target", language, "target_of_interest", batch).withColumn("target_of_interest", F.trim("target_of_interest"))
    asked = named.withColumn("__box", X.box_prompt(F.col("target_of_interest")))
    found = M.replies(asked, "__box", vision, "__reply", batch).withColumn("__found", boxed(X.box_of(F.col("__reply"))))
    whole = F.concat(*[F.col("__found")[n].isNotNull().cast("string") for n in SIDES]) == "true" * 4
    return result(found, instruction, F.when(whole, F.array("__found")), F.lit(None), F.lit("baseline_detection")).join(named.select("question_id", "target_of_interest"), "question_id")


def evidence(questions: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(question_id, path, cue_pos, patch_idx, confidence): the cues of the first tier that has any for a question. Each tier is read once;
    questions without cues have no rows."""
    rows = None
    for rank, (name, cues) in enumerate(tiers):
        part = cues.select("question_id", "cue_pos", "patch_idx", "confidence", F.lit(name).alias("path"), F.lit(rank).alias("__rank"))
        rows = part if rows is None else rows.unionByName(part)
    first = F.min("__rank").over(Window.partitionBy("question_id"))
    kept = rows.join(questions.select("question_id").distinct(), "question_id", "left_semi").withColumn("__first", first).where("__rank = __first")
    return kept.select("question_id", "path", "cue_pos", "patch_idx", "confidence")


def with_union(boxes: Column, confidence: Column, category: Column, compat: bool = False) -> tuple[Column, Column]:
    """Boxes and confidences with the box around all boxes and its mean confidence: added to several boxes, or, for the category count (written so), in
    their place. A single box stays alone. compat reproduces a known slip of earlier results in the union's y1."""
    least = lambda n: F.array_min(F.transform(boxes, lambda b: b[n]))
    most = lambda n: F.array_max(F.transform(boxes, lambda b: b[n]))
    y1 = F.least(least("x1"), F.element_at(boxes, -1)["y1"]) if compat else least("y1")
    union = F.struct(least("x1").alias("x1"), y1.alias("y1"), most("x2").alias("x2"), most("y2").alias("y2"))
    mean = F.aggregate(confidence, F.lit(0.0), lambda s, x: s + x) / F.size(confidence)
    several, count = F.size(boxes) > 1, category == "count"
    pick = lambda all_, one: F.when(several & count, F.array(one)).when(several, F.concat(all_, F.array(one))).otherwise(all_)
    return pick(boxes, union), pick(confidence, mean)


def retrieval(questions: DataFrame, cues: DataFrame, instruction: str, compat: bool = False) -> DataFrame:
    """Retrieved cues (question_id, path, cue_pos, confidence, x1, y1, x2, y2 in pixels), by falling confidence and with their union; questions without cues
    are plain, with the path Zero-shot. A question has a few cues, never more than its phrases and two."""
    order = F.struct((-F.col("confidence")).alias("c"), "cue_pos", F.struct(*[F.col(n).cast("double").alias(n) for n in SIDES]).alias("box"), "confidence")
    lists = cues.where("confidence > 0").groupBy("question_id").agg(F.array_sort(F.collect_list(order)).alias("l"), F.min("path").alias("found"))
    df = questions.join(lists, "question_id", "left").withColumns({"__boxes": F.transform("l", lambda x: x["box"]), "__conf": F.transform("l", lambda x: x["confidence"])})
    boxes, confidence = with_union(F.col("__boxes"), F.col("__conf"), F.col("category"), compat)
    share = lambda b: boxed([G.permille(b[n], F.col(size)) for n, size in zip(SIDES, ("width", "height") * 2, strict=True)])
    return result(df.withColumn("__union", boxes), instruction, F.transform("__union", share), confidence, F.coalesce("found", F.lit("Zero-shot")))


def prompts(mode: str, questions: DataFrame, instruction: str, **given: object) -> DataFrame:
    """The prompts of one of MODES; given: what the mode needs besides (cues, models, factor)."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: one of {list(MODES)} is needed")
    made = {"baseline": baseline, "baseline_detection": baseline_detection, "detection_gt": detection_gt, "detection_gt_fake": detection_gt_fake, "retrieval": retrieval}
    return made[mode](questions, instruction=instruction, **given)


def answered(mode: str, questions: DataFrame, instruction: str, model: Callable[[], M.Ask], batch: int = 16, **given: object) -> DataFrame:
    """As prompts(), with output: the answer model's reply to each prompt."""
    return M.replies(prompts(mode, questions, instruction, **given), "prompt", model, "output", batch)
