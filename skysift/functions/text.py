"""Answers, labels, prompts and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What introduces an answer, tried in this order; two of them are run together, as the results to match have it.
PREFIXES = ["The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:", "Answer"]
# The parts of prompts.
CHOICES_HEAD, ANSWER_TAIL = " The choices are listed below: \n", "\nThe best answer is:"
TARGET_QUESTION = "What is the target of interest in this question? Answer in short phrases only."
BOX_REQUEST = "<image>\nPlease provide the bounding box coordinate of the region this sentence describes: <ref>{}</ref>."
LOOK = "Look at the image and answer the question based on the provided additional information (location of sub-patches). \nQuestion: "
# The texts that a phrase is put in before it is encoded.
TEMPLATES = [
    "a bad photo of a {}.",
    "a photo of many {}.",
    "a sculpture of a {}.",
    "a photo of the hard to see {}.",
    "a low resolution photo of the {}.",
    "a rendering of a {}.",
    "graffiti of a {}.",
    "a bad photo of the {}.",
    "a cropped photo of the {}.",
    "a tattoo of a {}.",
    "the embroidered {}.",
    "a photo of a hard to see {}.",
    "a bright photo of a {}.",
    "a photo of a clean {}.",
    "a photo of a dirty {}.",
    "a dark photo of the {}.",
    "a drawing of a {}.",
    "a photo of my {}.",
    "the plastic {}.",
    "a photo of the cool {}.",
    "a close-up photo of a {}.",
    "a black and white photo of the {}.",
    "a painting of the {}.",
    "a painting of a {}.",
    "a pixelated photo of the {}.",
    "a sculpture of the {}.",
    "a bright photo of the {}.",
    "a cropped photo of a {}.",
    "a plastic {}.",
    "a photo of the dirty {}.",
    "a jpeg corrupted photo of a {}.",
    "a blurry photo of the {}.",
    "a photo of the {}.",
    "a good photo of the {}.",
    "a rendering of the {}.",
    "a {} in a video game.",
    "a photo of one {}.",
    "a doodle of a {}.",
    "a close-up photo of the {}.",
    "a photo of a {}.",
    "the origami {}.",
    "the {} in a video game.",
    "a sketch of a {}.",
    "a doodle of the {}.",
    "a origami {}.",
    "a low resolution photo of a {}.",
    "the toy {}.",
    "a rendition of the {}.",
    "a photo of the clean {}.",
    "a photo of a large {}.",
    "a rendition of a {}.",
    "a photo of a nice {}.",
    "a photo of a weird {}.",
    "a blurry photo of a {}.",
    "a cartoon {}.",
    "art of a {}.",
    "a sketch of the {}.",
    "a embroidered {}.",
    "a pixelated photo of a {}.",
    "itap of the {}.",
    "a jpeg corrupted photo of the {}.",
    "a good photo of a {}.",
    "a plushie {}.",
    "a photo of the nice {}.",
    "a photo of the small {}.",
    "a photo of the weird {}.",
    "the cartoon {}.",
    "art of the {}.",
    "a drawing of the {}.",
    "a photo of the large {}.",
    "a black and white photo of a {}.",
    "the plushie {}.",
    "a dark photo of a {}.",
    "itap of a {}.",
    "graffiti of the {}.",
    "a toy {}.",
    "itap of my {}.",
    "a photo of a cool {}.",
    "a photo of a small {}.",
    "a tattoo of the {}.",
]


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def answer_letter(output: Column, choices: Column, strict: bool = False) -> Column:
    """The letter A to E that an answer names, '' if none.

    The text after the last occurrence of the first prefix found counts. Over ten words without such a letter name none;
    else the first letter; else the second character of the first choice that holds the text. An empty text is in every
    choice; strict makes it name none."""
    s = stripped(output)
    cut = s
    for p in reversed(PREFIXES):
        cut = F.when(s.contains(p), F.element_at(F.split(s, p), -1)).when(s.contains(p.lower()), F.element_at(F.split(s, p.lower()), -1)).otherwise(cut)
    letter = F.regexp_extract(cut, "[ABCDE]", 0)
    words = F.size(F.filter(F.split(cut, r"\s+"), lambda w: w != ""))
    choice = F.get(F.filter(choices, lambda c: F.lower(c).contains(F.lower(cut))), 0)
    fallback = F.coalesce(F.substring(choice, 2, 1), F.lit(""))
    if strict:
        fallback = F.when(stripped(cut) == "", "").otherwise(fallback)
    return F.when(letter != "", letter).when(words > 10, "").otherwise(fallback)


def category(raw: Column) -> Column:
    """Lower case; of attributes only what stands before the first slash, with /attribute."""
    low = F.lower(raw)
    return F.when(low.contains("attribute"), F.concat(F.substring_index(low, "/", 1), F.lit("/attribute"))).otherwise(low)


def label(raw: Column) -> Column:
    return F.translate(F.lower(raw), "-_", "  ")


def question_prompt(text: Column, choices: Column, instruction: str) -> Column:
    return F.concat(text, F.lit(CHOICES_HEAD), F.concat_ws("", F.transform(choices, lambda c: F.concat(c, F.lit("\n")))), F.lit(instruction + ANSWER_TAIL))


def two_places(x: Column) -> Column:
    """A number with two decimal places, as exact rounding of the binary number gives it, halves to even; Java's format() rounds the shortest decimal form, halves up."""
    size = F.abs(x)
    rest = F.floor((size - F.floor(size)) * float(1 << 52)) * 100  # below 2**59
    cut, over = F.shiftright(rest, 52), rest.bitwiseAND(F.lit((1 << 52) - 1))
    up = (over > F.lit(1 << 51)) | ((over == F.lit(1 << 51)) & (cut % 2 == 1))
    n = F.floor(size) * 100 + cut + F.when(up, 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def evidence_prompt(boxes: Column) -> Column:
    """boxes: array of structs x1, y1, x2, y2 in thousandths."""
    def line(b: Column, i: Column) -> Column:
        return F.concat(F.lit("Sub-patch "), (i + 1).cast("string"), F.lit(" at location <box>[["), F.concat_ws(", ", *[two_places(b[k].cast("double")) for k in ("x1", "y1", "x2", "y2")]), F.lit("]]</box>: <image>\n"))

    return F.concat(F.lit("<image>\nAdditional information:\n"), F.concat_ws("", F.transform(boxes, line)))


def evidence_question(boxes: Column, prompt: Column) -> Column:
    """The question after its evidence."""
    return F.concat(evidence_prompt(boxes), F.lit(LOOK), prompt)


def target_prompt(text: Column) -> Column:
    return F.concat(F.lit("Question: "), text, F.lit("\n" + TARGET_QUESTION))


def box_prompt(target: Column) -> Column:
    return F.replace(F.lit(BOX_REQUEST), F.lit("{}"), target)


def templated(phrase: Column, templates: list[str]) -> Column:
    """The phrase in each template."""
    return F.array(*[F.replace(F.lit(t), F.lit("{}"), phrase) for t in templates])


def chosen_phrases(phrases: Column, keywords: Column, keep: int = 5) -> Column:
    """Phrases that are keywords with the same score, then the other keywords; without any such, the keywords. Both: array<struct<phrase, score>>."""
    both = F.array_intersect(phrases, keywords)
    return F.transform(F.slice(F.concat(both, F.array_except(keywords, both)), 1, keep), lambda x: x["phrase"])


def region_text(left: Column, top: Column, right: Column, bottom: Column, angle: Column) -> Column:
    """A box and its angle as <left><top><right><bottom>|<angle>, in whole numbers, left and top not below 0."""
    whole = lambda v: v.cast("int").cast("string")
    least = lambda v: F.greatest(v, F.lit(0.0))
    return F.concat(F.lit("<"), F.concat_ws("><", whole(least(left)), whole(least(top)), whole(right), whole(bottom)), F.lit(">|<"), whole(angle), F.lit(">"))


def summary_phrase(phrases: Column) -> Column:
    """'a and b', or 'a, b, and c'; null for fewer than two."""
    n = F.size(phrases)
    return F.when(n == 2, F.concat_ws(" and ", phrases)).when(n > 2, F.concat(F.array_join(F.slice(phrases, 1, n - 1), ", "), F.lit(", and "), F.element_at(phrases, -1)))


def last_list(reply: Column) -> Column:
    """The strings of the last bracketed list in a reply; null if it doesn't parse."""
    return F.from_json(F.try_element_at(F.regexp_extract_all(reply, F.lit(r"\[[^\]]*\]"), F.lit(0)), F.lit(-1)), "array<string>")


def box_of(reply: Column) -> list[Column]:
    """The four numbers of the first [[a,b,c,d]] in a reply, null where they aren't numbers."""
    pattern = r"\[*\[(.*?),(.*?),(.*?),(.*?)\]\]*"
    return [F.trim(F.regexp_extract(reply, pattern, k)).try_cast("double") for k in (1, 2, 3, 4)]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def result_name(dataset: Column, run: Column, mode: Column, method: Column, encoder: Column, path_t: Column, lrsd_t: Column, crsd_t: Column, reducer: Column) -> Column:
    return F.concat(F.concat_ws("_", dataset, run, mode, method, encoder, path_t, lrsd_t, crsd_t, reducer), F.lit(".jsonl"))


def result_parts(name: Column) -> dict[str, Column]:
    """Parameters in a result file's name."""
    parts = F.split(F.regexp_replace(name, r"\.jsonl$", ""), "_")
    names = ("patch_method", "encoder_name", "path_T", "lrsd_T", "crsd_T", "reduce_fn")
    return {n: F.try_element_at(parts, F.lit(k + 4)) for k, n in enumerate(names)}


def patch_box(path: Column) -> list[Column]:
    """The coordinates in a patch file's name, null if it has none."""
    return [F.regexp_extract(path, r"_(\d+)-(\d+)-(\d+)-(\d+)\.png$", k).try_cast("int") for k in (1, 2, 3, 4)]
