"""Accuracy of answers, and analysis of sweeps."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions import text as X
from skysift.session import checkpointed


def judged(answers: DataFrame) -> DataFrame:
    """answers (task, subtask, category, output, choices, truth array) with letter, is_true and is_e."""
    named = answers.withColumn("category", X.category(F.col("category"))).withColumn("letter", X.answer_letter(F.col("output"), F.col("choices")))
    return named.withColumns({"is_true": F.array_contains("truth", F.col("letter")).cast("long"), "is_e": (F.col("letter") == "E").cast("long")})


def accuracy(judgements: DataFrame) -> DataFrame:
    """(level, task, subtask, category, n, n_true, n_e, accuracy): level 0 a category, 1 a subtask, 3 a task, 7 all; null where nothing was judged."""
    rows = judgements.rollup("task", "subtask", "category").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("is_true").alias("n_true"), F.sum("is_e").alias("n_e"))
    return rows.withColumn("accuracy", F.expr("try_divide(n_true, n)"))


def chunk(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df with `chunk`: n contiguous chunks of ceil(rows / n), the last ones shorter or missing. Ranks come from sorted parts and their sizes, so no task sees all rows."""
    at = ranked(df, order)
    total = df.count()
    return at.withColumn("chunk", F.floor(F.col("__rank") / max(-(-total // n), 1)).cast("int")).drop("__rank")


def assign(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df with `runner`: n contiguous slices of equal size, the first ones one row longer."""
    total = df.count()
    base, extra = divmod(total, n)
    at = ranked(df, order)
    r = F.col("__rank")
    head = extra * (base + 1)
    return at.withColumn("runner", F.when(r < head, F.floor(r / (base + 1))).otherwise(extra + F.floor((r - head) / max(base, 1))).cast("int")).drop("__rank")


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __rank from 0: sorted ranges ranked each by itself, then moved by the sizes of those before."""
    cols = [F.col(c) for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the checkpoint fixes which rows a range holds
    ranges = checkpointed(df.repartitionByRange(parts, *cols).withColumn("__part", F.spark_partition_id()))
    sizes = ranges.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*cols)) - 1
    return ranges.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("__rank", F.col("__own") + F.col("__before")).drop("__own", "__before", "__part")


def best_rows(results: DataFrame, metric: str) -> DataFrame:
    """All rows that reach the largest value of metric."""
    return results.join(F.broadcast(results.agg(F.max(metric).alias("__m"))), F.col(metric) == F.col("__m")).drop("__m")


DIM = 256
WORD = re.compile(r"[^\W\d_]+")
WORD_AND_SIGNS = re.compile(r"([^\W\d_]+)([\W\d_]*)")


class Grams:
    """Runs of a text's words, compared with the text and with each other by the cosine of their words' hashed counts.

    Only slots are held for each run, not its vector, so a text takes memory in proportion to its words; products are of whole numbers, so ties are
    exact and the first run wins them."""

    def __init__(self, words: list[str], at: np.ndarray, size: np.ndarray, dim: int = DIM):
        """at, size: where each run begins, and its words; of equal runs the first stays."""
        self.words, self.dim, self.at, self.size = words, dim, at, size
        if not len(at):
            return
        number: dict[str, int] = {}
        named = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        own = np.fromiter((zlib.crc32(w.encode()) % dim for w in number), np.int64, len(number))[named]
        key = np.zeros(len(at), np.int64)
        for k in range(size.max()):
            if k and (len(number) + 1) ** (k + 1) >= 1 << 63:
                key = np.unique(key, return_inverse=True)[1]
            key = key * (len(number) + 1) + np.where(k < size, named[np.minimum(at + k, len(words) - 1)] + 1, 0)
        first = np.sort(np.unique(key, return_index=True)[1])
        self.at, self.size = at, size = at[first], size[first]
        # the slots of each run's words; the slot `dim` counts nothing
        self.slots = [np.where(k < size, own[np.minimum(at + k, len(words) - 1)], dim) for k in range(size.max())]
        square = size.copy()
        for j in range(len(self.slots)):
            for i in range(j):
                square += 2 * ((self.slots[i] == self.slots[j]) & (j < size))
        self.norm = np.sqrt(square)
        self.text = self.cosine(np.bincount(own, minlength=dim))  # of each run with the text

    def cosine(self, counts: np.ndarray) -> np.ndarray:
        """Of all runs with the text of these counts."""
        padded = np.append(counts, 0).astype(np.float64)
        total = padded[self.slots[0]]
        for slots in self.slots[1:]:
            total += padded[slots]
        return total / (self.norm * np.sqrt((counts**2).sum()))

    def with_run(self, k: int) -> np.ndarray:
        return self.cosine(np.bincount([s[k] for s in self.slots], minlength=self.dim + 1)[: self.dim])

    def __len__(self) -> int:
        return len(self.at)

    def name(self, k: int) -> str:
        return " ".join(self.words[self.at[k] : self.at[k] + self.size[k]])


SCORED = "array<struct<phrase:string,score:double>>"


Choose = Callable[[str], list[tuple[str, float]]]


def scored(docs: DataFrame, **choosers: Choose) -> DataFrame:
    """(doc_id, a column for each chooser): what it gives for each text; nothing for null."""
    kind = pa.list_(pa.struct([("phrase", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [pa.array([[{"phrase": p, "score": float(x)} for p, x in choose(t)] for t in texts], kind) for choose in choosers.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["doc_id", *choosers])

    columns = ", ".join(f"`{n}` {SCORED}" for n in choosers)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def by_relevance(top: int, diversity: float, sizes: tuple[int, ...]) -> Choose:
    """n-grams by maximal marginal relevance to their text, with their likeness to it."""

    def choose(text: str) -> list[tuple[str, float]]:
        words = WORD.findall(text.lower())
        count = [max(len(words) - n + 1, 0) for n in sizes]
        grams = Grams(words, np.concatenate([np.arange(c) for c in count]), np.repeat(sizes, count))
        if not len(grams):
            return []
        out = [int(grams.text.argmax())]
        near = grams.with_run(out[0])
        while len(out) < min(top, len(grams)):
            score = (1 - diversity) * grams.text - diversity * near
            score[out] = -np.inf
            out.append(int(score.argmax()))
            near = np.maximum(near, grams.with_run(out[-1]))
        return [(grams.name(k), grams.text[k]) for k in out]

    return choose


def key_phrases(docs: DataFrame, top: int = 10, keep: int = 5, diversity: float = 0.7, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(doc_id, phrases): n-grams chosen by maximal marginal relevance to their document, of which the first `keep` stay."""
    names = F.transform(F.slice("phrases", 1, keep), lambda x: x["phrase"])
    return scored(docs, phrases=by_relevance(top, diversity, sizes)).select("doc_id", names.alias("phrases"))


def common_words(docs: DataFrame, share: float) -> list[str]:
    """Words that more than this share of all documents hold: at most a document's mean number of distinct words / share, however many documents there are."""
    texts = docs.where("text IS NOT NULL").select("text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter(w for t in b.column(0).to_pylist() for w in set(WORD.findall(t.lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    total = texts.count()
    counts = texts.mapInArrow(counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return sorted(r.w for r in counts.where(F.col("n") > share * total).collect())


def by_rarity(common: frozenset[str], top: int, longest: int) -> Choose:
    """Runs of up to `longest` words between signs and common words, those most like their text first, with their likeness to it. Longer runs are parted from their beginning."""

    def choose(text: str) -> list[tuple[str, float]]:
        found, runs, size, signs = WORD_AND_SIGNS.findall(text.lower()), [], 0, " "
        words = [w for w, _ in found]
        for i, (w, after) in enumerate(found):
            rare = w not in common
            if size and (not rare or size == longest or signs != " " and signs.strip()):
                runs.append((i - size, size))
                size = 0
            size, signs = (size + 1 if rare else 0), after
        if size:
            runs.append((len(words) - size, size))
        grams = Grams(words, *np.array(runs, np.int64).reshape(-1, 2).T)
        order = np.lexsort((np.arange(len(grams)), -grams.text))[:top] if len(grams) else []
        return [(grams.name(k), grams.text[k]) for k in order]

    return choose


def keywords(docs: DataFrame, top: int = 10, share: float = 0.2, longest: int = 4) -> DataFrame:
    """(doc_id, keywords array<struct<phrase,score>>) of each document. What words are common follows from all documents: without a tagger of parts of speech the runs between them stand for noun phrases."""
    return scored(docs, keywords=by_rarity(frozenset(common_words(docs, share)), top, longest))


def key_texts(docs: DataFrame, keep: int = 5, top: int = 10, diversity: float = 0.7, sizes: tuple[int, ...] = (2, 3, 4), share: float = 0.2, longest: int = 4) -> DataFrame:
    """(doc_id, texts): phrases of each document that are keywords as well, with one score, then the other keywords; without any such, the keywords."""
    both = scored(docs, phrases=by_relevance(top, diversity, sizes), keywords=by_rarity(frozenset(common_words(docs, share)), top, longest))
    return both.select("doc_id", X.chosen_phrases(F.col("phrases"), F.col("keywords"), keep).alias("texts"))
