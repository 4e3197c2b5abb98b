"""Retrieval of visual evidence in tiers, for all questions at once: only what a tier leaves over reaches the next.

Fast: the question's phrases against its patches, by votes, above a threshold. Slow-LRSD and Slow-CRSD: the labels of a store that are
near the phrases, their images reduced to a cue for each label, the cues against the patches, by votes. What no tier finds anything for is
Zero-shot. What a tier has found, and who is left, is written before the next begins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.operators import modes as O
from skysift.operators import retrieval as R
from skysift.session import stored

FAST, LRSD, CRSD, ZERO = "Fast", "Slow-LRSD", "Slow-CRSD", "Zero-shot"


@dataclass(frozen=True)
class Store:
    """A vector store. labels: label, vec (in the space of the phrases' query_vec); images: label, pos, vec (in that of the patches);
    pos numbers all images, and of equal choices the lower one wins."""

    labels: DataFrame
    images: DataFrame


@dataclass(frozen=True)
class Settings:
    """Thresholds of the three tiers, the reduction of a label's images (mean, cluster or rerank), neighbours of a phrase, patches of a vote."""

    path_t: float
    lrsd_t: float
    crsd_t: float
    reduce: str = "mean"
    neighbours: int = 3
    top: int = 2
    eps: float = 0.3
    scale: float = R.SCALE


@dataclass
class Retrieved:
    """evidence: question_id, path, cue_pos, patch_idx, confidence; paths: question_id, path of every question; entered: how many questions came to each tier."""

    evidence: DataFrame
    paths: DataFrame
    entered: dict[str, int] = field(default_factory=dict)


EVIDENCE = ["question_id", "path", "cue_pos", "patch_idx", "confidence"]


def store(entries: DataFrame, labels: DataFrame) -> Store:
    """A Store of entries (pos, img_name, label, vec) and labels (label, vec). A label has an image as often as entries name it; a name that stands for several vectors has the last one."""
    last = entries.groupBy("img_name").agg(F.max_by("vec", "pos").alias("vec"))
    return Store(labels, entries.select("label", "pos", "img_name").join(last, "img_name").select("label", "pos", "vec"))


def entries_of(lists: DataFrame) -> DataFrame:
    """(pos, img_name, label, vec) of the parallel lists img_names, labels, vecs in a row; lists of unequal length are an error."""
    n = F.size("img_names")
    same = (n == F.size("labels")) & (n == F.size("vecs"))
    said = F.concat(F.lit("lists of unequal length: "), n.cast("string"), F.lit(", "), F.size("labels").cast("string"), F.lit(", "), F.size("vecs").cast("string"))
    zipped = F.when(same, F.arrays_zip("img_names", "labels", "vecs")).otherwise(F.raise_error(said))
    rows = lists.select(F.posexplode(zipped).alias("pos", "x"))
    return rows.select("pos", F.col("x.img_names").alias("img_name"), F.col("x.labels").alias("label"), F.col("x.vecs").alias("vec"))


def matched(phrases: DataFrame, labels: DataFrame, k: int, threshold: float) -> DataFrame:
    """(question_id, label, pos, place): labels among the k nearest of a phrase and within the threshold; pos is the last phrase that found the label, place says in which order labels were found."""
    asked = phrases.select("question_id", "pos", F.col("query_vec" if "query_vec" in phrases.columns else "vec").alias("vec"))
    near = R.nearest(asked, labels.withColumnRenamed("label", "label_id"), k, threshold)
    found = near.groupBy("question_id", F.col("label_id").alias("label")).agg(F.max("pos").alias("pos"), F.min(F.struct("pos", "rank")).alias("first"))
    return found.select("question_id", "label", "pos", (F.col("first.pos") * k + F.col("first.rank") - 1).cast("long").alias("place"))


def cues(found: DataFrame, phrases: DataFrame, images: DataFrame, settings: Settings) -> DataFrame:
    """(question_id, pos, vec): each found label's images as one vector. Means and clusters depend on the label alone and are made once for each label, however many questions found it; a rerank takes the
    three images most like the phrase, which blocks of phrases and images of a label give without a row for each pair."""
    if settings.reduce != "rerank":
        own = images.join(found.select("label").distinct(), "label", "left_semi").withColumnRenamed("pos", "id")
        reduced = R.reduced(own, ["label"], settings.reduce, settings.eps)
        return found.join(reduced, "label").select("question_id", F.col("place").alias("pos"), "vec")
    asked = found.join(phrases.select("question_id", "pos", "vec"), ["question_id", "pos"])
    return R.reranked(asked, images.select("label", F.col("pos").alias("image"), "vec")).join(found, ["question_id", "label"]).select("question_id", F.col("place").alias("pos"), "vec")


def slow(phrases: DataFrame, patches: DataFrame, place: Store, threshold: float, settings: Settings) -> DataFrame:
    """(question_id, cue_pos, patch_idx, confidence): the patches that the cues of the labels near a question's phrases vote for."""
    found = stored(matched(phrases, place.labels, settings.neighbours, threshold), "matched")
    made = stored(cues(found, phrases, place.images, settings), "cues")
    return R.vote(R.best(made, patches, settings.top, settings.scale, normalise_texts=False), settings.top)


def retrieve(questions: DataFrame, phrases: DataFrame, patches: DataFrame, lrsd: Store, crsd: Store, settings: Settings) -> Retrieved:
    """The evidence of all questions. questions: question_id; phrases: question_id, pos, vec (in the space of the patches), and query_vec (in that of the labels) if it is another; patches: question_id, patch_idx, vec (without
    question_id every question sees all). A tier searches for the questions that are left alone; where none is left, it isn't run."""
    left = stored(questions.select("question_id").where("question_id IS NOT NULL").distinct(), "questions")
    tiers = [
        (FAST, lambda p, own: R.above(R.vote(R.best(p, own, settings.top, settings.scale), settings.top), settings.path_t)),
        (LRSD, lambda p, own: slow(p, own, lrsd, settings.lrsd_t, settings)),
        (CRSD, lambda p, own: slow(p, own, crsd, settings.crsd_t, settings)),
    ]
    blocks = stored(R.patch_blocks(patches), "patches")  # sorted and normalised once for all tiers
    entered, parts = {}, []
    for name, tier in tiers:
        entered[name] = left.count()
        if not entered[name]:
            break
        own = blocks.join(left, F.col("p_key_question_id") == F.col("question_id"), "left_semi") if "question_id" in patches.columns else blocks
        found = stored(tier(phrases.join(left, "question_id", "left_semi"), own).withColumn("path", F.lit(name)).select(EVIDENCE), "evidence")
        parts.append(found)
        left = stored(left.join(found.select("question_id").distinct(), "question_id", "left_anti"), "left")
    else:
        entered[ZERO] = left.count()
    evidence = parts[0] if parts else None
    for part in parts[1:]:
        evidence = evidence.unionByName(part)
    if evidence is None:
        evidence = left.select("question_id", F.lit(ZERO).alias("path"), F.lit(0).alias("cue_pos"), F.lit(None).cast(patches.schema["patch_idx"].dataType).alias("patch_idx"), F.lit(0.0).alias("confidence")).limit(0)
    paths = evidence.select("question_id", "path").distinct().unionByName(left.withColumn("path", F.lit(ZERO)))
    return Retrieved(evidence, paths, {name: entered.get(name, 0) for name in (FAST, LRSD, CRSD, ZERO)})


def retrieved_prompts(questions: DataFrame, phrases: DataFrame, patches: DataFrame, lrsd: Store, crsd: Store, settings: Settings, instruction: str, compat: bool = False) -> tuple[DataFrame, Retrieved]:
    """The prompts of modes.retrieval() from questions (as in modes), phrases, patches (with x1, y1, x2, y2 in pixels) and stores; and what was retrieved."""
    got = retrieve(questions, phrases, patches, lrsd, crsd, settings)
    by = [c for c in ("question_id", "patch_idx") if c in patches.columns]
    return O.retrieval(questions, got.evidence.join(patches.select(*by, *O.SIDES), by), instruction, compat), got
