"""Models behind plain callables: encoders and language models are made once in each task and called on batches of rows.

A model is given as a factory, a function without arguments that returns the callable, so that nothing large is sent to
executors. ask: list of prompts -> list of replies; encode: list of values -> list of vectors.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from skysift.functions import text as X
from skysift.operators import retrieval as R
from skysift.session import stored
from skysift.sources.batches import add_batch, read_batches

Ask = Callable[[list], list]
ENCODERS: dict[str, Callable[[], Ask]] = {}

#: What language models are asked; {} is the text.
PARAPHRASE = "Say this question in plain words, keep its meaning, and return nothing but the new question.\n\n{}"
KEYWORDS = 'Which objects and features would have to be found in an aerial image to answer this question? Return a list like ["a", "b"].\n\n{}'
EXPANSION = "Explain this phrase in a few sentences, with its synonyms, so that a class of the same meaning can be found by it.\n\n{}"


def register_encoder(name: str, factory: Callable[[], Ask]) -> None:
    ENCODERS[name] = factory


def hashed_words(dim: int = 16) -> Ask:
    """An encoder without weights: counts of the words' hashes."""

    def encode(texts: list) -> list:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in re.findall(r"\w+", (t or "").lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1.0
            out.append(v)
        return out

    return encode


register_encoder("hashed", hashed_words)


def called(df: DataFrame, column: str, factory: Callable[[], Ask], name: str, kind: str, batch: int, error: str | None = None) -> DataFrame:
    """df with `name`: the model's result for each row's `column`, in batches of at most `batch` rows; null in, null out. With the name of an error column a call that raises is made again
    row by row, and rows that raise alone have a null result and the exception there; without one it fails the task."""
    schema = df.withColumn(name, F.lit(None).cast(kind)).schema
    where, target = df.columns.index(column), schema[name].dataType
    if error:
        schema = df.withColumns({name: F.lit(None).cast(kind), error: F.lit(None).cast("string")}).schema
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for b in batches:
            call = call or factory()
            values = b.column(where).to_pylist()
            there = [i for i, v in enumerate(values) if v is not None]
            out: list = [None] * len(values)
            wrong: list = [None] * len(values)
            for at in range(0, len(there), batch):
                some = there[at : at + batch]
                for i, v, w in zip(some, *(attempted(call, [values[i] for i in some]) if error else (call([values[i] for i in some]), [None] * len(some))), strict=True):
                    out[i], wrong[i] = v, w
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow), *([pa.array(wrong, pa.string())] if error else [])], names=schema.names)

    return df.mapInArrow(run, schema)


def attempted(call: Ask, values: list) -> tuple[list, list]:
    """The results of a call, and the exceptions: of all values at once, or one by one where that raises."""
    try:
        got = call(values)
        if len(got) != len(values):
            raise ValueError(f"{len(got)} results for {len(values)} values")
        return list(got), [None] * len(values)
    except Exception as e:  # whatever a model raises concerns its rows alone
        if len(values) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    each = [attempted(call, [v]) for v in values]
    return [x[0][0] for x in each], [x[1][0] for x in each]


def replies(df: DataFrame, prompt: str, factory: Callable[[], Ask], name: str = "reply", batch: int = 16) -> DataFrame:
    """df with the model's reply to each prompt."""
    return called(df, prompt, factory, name, "string", batch)


def encoded(df: DataFrame, column: str, encoder: str | Callable[[], Ask], name: str = "vec", batch: int = 50) -> DataFrame:
    """df with the vector of each value. encoder: a registered name or a factory."""
    if isinstance(encoder, str) and encoder not in ENCODERS:
        raise ValueError(f"encoder {encoder!r}: one of {sorted(ENCODERS)} is needed")
    return called(df, column, ENCODERS[encoder] if isinstance(encoder, str) else encoder, name, "array<double>", batch)


def encoded_once(requested: DataFrame, cached: DataFrame, on: list[str], column: str, encoder: str | Callable[[], Ask], batch: int = 50) -> DataFrame:
    """(on, vec) of all that is requested: from cached (on, vec) where it is there, else encoded now."""
    known = cached.join(requested.select(*on).distinct(), on, "left_semi").select(*on, "vec")
    fresh = requested.dropDuplicates(on).join(cached.select(*on).distinct(), on, "left_anti")
    return known.unionByName(encoded(fresh, column, encoder, batch=batch).select(*on, "vec"))


@dataclass
class Features:
    """vectors: on, vec of what was requested; failed: on, error of what has none; fresh: how many were encoded now."""

    vectors: DataFrame
    failed: DataFrame
    fresh: int


def features(requested: DataFrame, path: str, on: list[str], column: str, encoder: str | Callable[[], Ask], batch: int = 50) -> Features:
    """The features of all that is requested (on, column), from the cache at path where they are there; the rest is encoded once and written back as one more batch, which counts only when all of it is written. A second run, or one after
    a run that died, encodes what no whole batch holds. Values that are null or that the encoder raises on are in `failed`, and aren't cached: they are
    tried again next time. Where two runs have written the same key, one of the two counts."""
    spark = requested.sparkSession
    if isinstance(encoder, str) and encoder not in ENCODERS:
        raise ValueError(f"encoder {encoder!r}: one of {sorted(ENCODERS)} is needed")
    keys = requested.select(*on).schema
    schema = StructType([*keys.fields, StructField("vec", ArrayType(DoubleType()))])
    single = requested.select(*on, column).dropna(subset=on).dropDuplicates(on)
    fresh = single.join(read_batches(spark, path, schema).select(*on).distinct(), on, "left_anti")
    tried = stored(called(fresh, column, ENCODERS[encoder] if isinstance(encoder, str) else encoder, "vec", "array<double>", batch, "error"), "encoded")
    good = tried.where("vec IS NOT NULL").select(*on, "vec")
    n = good.count()
    if n:
        add_batch(good, path)
    known = read_batches(spark, path, schema).dropDuplicates(on)
    failed = tried.where("vec IS NULL").select(*on, F.coalesce("error", F.lit("nothing to encode")).alias("error"))
    return Features(known.join(single.select(*on), on, "left_semi"), failed, n)


def phrase_features(phrases: DataFrame, path: str, encoder: str | Callable[[], Ask], templates: list[str], batch: int = 50) -> Features:
    """Features of (question_id, phrases array<string>): question_id, pos, phrase, vec in `vectors`, the last phrase being the summary where there are several; each phrase is the mean over the templates and is encoded once however many
    questions have it. Questions without phrases, and those of phrases that can't be encoded, are in `failed` (question_id, error)."""
    listed = F.when(F.size("phrases") > 1, F.concat("phrases", F.array(X.summary_phrase(F.col("phrases"))))).otherwise(F.col("phrases"))
    rows = phrases.select("question_id", F.posexplode(listed).alias("pos", "phrase"))
    texts = rows.select("phrase").distinct().select("phrase", F.explode(X.templated(F.col("phrase"), templates)).alias("text"))
    got = features(texts, path, ["phrase", "text"], "text", encoder, batch)
    vectors = rows.join(R.mean(got.vectors, ["phrase"], normalise=False), "phrase").select("question_id", "pos", "phrase", "vec")
    bad = rows.join(got.failed.groupBy("phrase").agg(F.min("error").alias("error")), "phrase").groupBy("question_id").agg(F.min("error").alias("error"))
    none = phrases.where(F.coalesce(F.size("phrases"), F.lit(-1)) <= 0).select("question_id", F.lit("no phrases").alias("error"))
    return Features(vectors.join(bad.select("question_id"), "question_id", "left_anti"), none.unionByName(bad), got.fresh)


def listed(reply: str | None) -> list[str]:
    """The strings of the last bracketed list in a reply; empty if there is none or it doesn't parse."""
    found = re.findall(r"\[[^\]]*\]", reply or "")
    try:
        got = ast.literal_eval(found[-1]) if found else []
    except (ValueError, SyntaxError):
        return []
    return [str(x) for x in got]


def asked_phrases(df: DataFrame, text: str, factory: Callable[[], Ask], fallback: str, tries: int = 20, batch: int = 16) -> DataFrame:
    """df with phrases, tries and error: what a language model lists for the text. Empty and unreadable replies, and calls that raise, are asked again, up to `tries` times in all; then the column fallback counts and error says
    what the last reply lacked or what was raised. tries is how often the model was asked. Null texts aren't asked."""

    def asker() -> Ask:
        ask = factory()

        def run(texts: list) -> list:
            out = [{"phrases": None, "tries": 0, "error": None} for _ in texts]
            for _ in range(tries):
                open_ = [i for i, x in enumerate(out) if not x["phrases"]]
                if not open_:
                    break
                for i, r, wrong in zip(open_, *attempted(ask, [KEYWORDS.replace("{}", texts[i]) for i in open_]), strict=True):
                    found = listed(r) or None
                    out[i] = {"phrases": found, "tries": out[i]["tries"] + 1, "error": None if found else wrong or "no list in the reply"}
            return out

        return run

    got = called(df, text, asker, "__asked", "struct<phrases:array<string>,tries:int,error:string>", batch)
    return got.withColumns({"phrases": F.coalesce("__asked.phrases", fallback), "tries": F.coalesce("__asked.tries", F.lit(0)), "error": F.col("__asked.error")}).drop("__asked")


def split_failed(df: DataFrame, on: list[str], error: str = "error") -> tuple[DataFrame, DataFrame]:
    """The rows without an error, and (on, error) of the others."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull()).select(*on, error)


def paraphrased(df: DataFrame, text: str, factory: Callable[[], Ask], batch: int = 16) -> DataFrame:
    """df with paraphrase, stripped, and error; where the model raises, the text stands for its paraphrase."""
    asked = df.withColumn("__prompt", F.replace(F.lit(PARAPHRASE), F.lit("{}"), F.col(text)))
    got = called(asked, "__prompt", factory, "paraphrase", "string", batch, "error")
    return got.withColumn("paraphrase", F.coalesce(F.trim("paraphrase"), F.col(text))).drop("__prompt")


def expanded(df: DataFrame, factory: Callable[[], Ask] | None = None, batch: int = 16) -> DataFrame:
    """(question_id, expansion, phrase) of df (question_id, phrases): one call a phrase; of equal expansions the last phrase counts. Without a model a phrase expands to itself."""
    rows = df.select("question_id", F.posexplode("phrases").alias("pos", "phrase"))
    if factory:
        asked = rows.withColumn("__prompt", F.replace(F.lit(EXPANSION), F.lit("{}"), F.col("phrase")))
        rows = replies(asked, "__prompt", factory, "expansion", batch).withColumn("expansion", F.trim("expansion"))
    else:
        rows = rows.withColumn("expansion", F.col("phrase"))
    return rows.groupBy("question_id", "expansion").agg(F.max_by("phrase", "pos").alias("phrase"))
