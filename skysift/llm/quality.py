"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered: 0 toxic, 1 low quality, 2 good. One weight vector w over hashed features serves all grades, and
ordered thresholds part them: P(grade <= j) = sigmoid(threshold_j - w.x). The model gives each text its expected grade
and the tail probabilities P(grade >= 1) and P(grade >= 2).

Features are distinct words, prefixes of words, and the levels that a few shares reach (capitals, signs, repeated words, ...). It
is fitted on at most about SAMPLE labelled rows of each grade, chosen by a hash of doc_id; each row weighs as many rows as it
stands for, times the root of how rare its grade is. Executors count in how many rows of each grade a feature occurs; features
that go with the grade by LEAST_Z standard deviations are learned from, in the driver, and nothing else is sent there. Every
document is then scored, whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.shared import small, stored, table
from skysift.llm.textcols import DIGIT, DROP, LETTER, Lexicon, encoded, gather, hashes, raw, runs, slices, unicode_classes

SAMPLE, BITS, GRADES = 6000, 18, 3
LEVELS = 24
PREFIXES = (4, 6)
LEAST_Z, LEAST_ROWS = 2.6, 3


@dataclass
class Model:
    weights: np.ndarray  # of the 2**BITS features
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def features(texts: pa.Array, lexicon: Lexicon, alive: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, end, the row and the number of each feature, sorted, each once in a row. alive: which numbers matter."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for i, j in slices(texts):
        part = texts.slice(i, j - i)
        data, off = raw(part)
        rows = j - i
        count = lambda x, weights=None: np.bincount(x, weights, minlength=rows)  # noqa: B023, E731
        size = np.maximum(np.diff(off), 1)
        of = np.repeat(np.arange(rows), np.diff(off))
        kind = unicode_classes()[np.minimum(data, 127)]
        sign = (data < 128) & (kind != LETTER) & (kind != DROP)
        other = sign & (kind != DIGIT)
        doubled = other[1:] & (data[1:] == data[:-1])
        shares = {"upper": count(of[(data >= 65) & (data <= 90)]) / size, "signs": count(of[sign]) / size, "doubled": count(of[1:][doubled]) / np.maximum(count(of[other]), 1)}
        data, off = raw(pc.utf8_lower(part))
        s, e, first, packed = runs(data, off, unicode_classes())
        words, idx = encoded(s, e, packed)
        row = np.repeat(np.arange(rows), np.diff(first))
        pair = np.unique(row.astype(np.int64) * max(len(words), 1) + idx) if len(words) else np.zeros(0, np.int64)
        prow, pword = (pair // len(words), pair % len(words)) if len(words) else (pair, pair)
        n = np.maximum(np.diff(first), 1)
        again = (idx[1:] == idx[:-1]) & (row[1:] == row[:-1])
        shares |= {"again": count(row[1:][again]) / n, "distinct": count(prow) / n, "length": np.minimum(count(row, e - s) / n / 16, 1), "words": np.minimum(np.log2(n) / 16, 1)}
        number = lexicon(words)[pword] if len(words) else np.zeros((0, 1), np.int64)
        r, f = [np.repeat(prow, number.shape[1])], [number.ravel()]
        for name, share in shares.items():
            reached = np.minimum((share * LEVELS).astype(np.int64), LEVELS) + 1
            r.append(np.repeat(np.arange(rows), reached))
            f.append(level_numbers(name)[gather(np.zeros(rows, np.int64), reached)])
        r, f = np.concatenate(r), np.concatenate(f)
        if alive is not None:
            r, f = r[alive[f]], f[alive[f]]
        key = np.unique(r << BITS | f)
        yield i, j, key >> BITS, key & ((1 << BITS) - 1)


def numbered(names: list[str]) -> np.ndarray:
    return (hashes(names) & np.uint64((1 << BITS) - 1)).astype(np.int64)


@functools.lru_cache(16)
def level_numbers(share: str) -> np.ndarray:
    return numbered([f"\x00{share}:{k}" for k in range(LEVELS + 1)])


def new_lexicon() -> Lexicon:
    """The word's number and those of its prefixes."""
    return Lexicon(lambda words: np.stack([numbered(words), *(numbered([f"\x01{w[:n]}" for w in words]) for n in PREFIXES)], axis=1))


def fit(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, epochs: int = 20, rate: float = 0.15, l1: float = 1e-3, batch: int = 32) -> Model:
    """Stochastic gradients with a rate of its own for each weight, and soft thresholding, which leaves rare noise at zero."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    share = np.cumsum([weight[grades == k].sum() for k in range(GRADES - 1)]) / max(weight.sum(), 1e-9)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    theta[1:] = np.maximum(theta[1:], theta[:-1] + 1e-3)
    t2 = np.full(GRADES - 1, 1.0)
    weight = weight / weight.mean() if len(weight) else weight
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            size = np.fromiter((len(rows[k]) for k in pick), np.int64, len(pick))
            cols, owner = np.concatenate([rows[k] for k in pick]), np.repeat(np.arange(len(pick)), size)
            score = np.bincount(owner, w[cols], len(pick))
            y, c = grades[pick], weight[pick]
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            with np.errstate(over="ignore"):
                hi, lo = 1 / (1 + np.exp(score - edge[y + 1])), 1 / (1 + np.exp(score - edge[y]))
            ds = (1 - hi - lo) * c
            p = np.maximum(hi - lo, 1e-9)
            grad = np.bincount(cols, ds[owner], 1 << BITS)
            seen = np.unique(cols)
            gs = grad[seen] / len(pick)
            g2[seen] += gs * gs
            step = rate / np.sqrt(g2[seen])
            v = w[seen] - step * gs
            w[seen] = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
            dt = np.zeros(GRADES - 1)
            np.add.at(dt, y[y < GRADES - 1], (-hi * (1 - hi) / p * c)[y < GRADES - 1])
            np.add.at(dt, y[y > 0] - 1, (lo * (1 - lo) / p * c)[y > 0])
            dt /= len(pick)
            t2 += dt * dt
            theta = np.sort(theta - rate / np.sqrt(t2) * dt)
    return Model(w, theta)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): toxic rows 0, other rows of quality 0 1, the rest 2; rows without a rating are left out, of several for a document the worst counts."""
    toxic, quality = F.coalesce(F.col("toxic"), F.lit(0)), F.col("quality")
    return labels.where(F.col("doc_id").isNotNull() & (quality.isNotNull() | (toxic > 0))).groupBy("doc_id").agg(F.min(F.when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Without any labelled document all weights are 0 and every text is good."""
    grades = graded(labels)
    counts = {r.grade: r["count"] for r in grades.groupBy("grade").count().collect()}
    part = F.create_map(*[F.lit(x) for g in range(GRADES) for x in (g, min(1.0, sample / max(counts.get(g, 0), 1)))])
    chosen = grades.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < part[F.col("grade")] * (1 << 30))
    joined = docs.select("doc_id", "text").join(small(chosen), "doc_id").select("doc_id", "grade", "text")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = new_lexicon()
        for b in batches:
            for i, j, r, f in features(b.column(2), lexicon):
                off = np.searchsorted(r, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(off), pa.array(f.astype(np.int32)))], names=["doc_id", "grade", "f"])

    seen = stored(joined.mapInArrow(rows_of, "doc_id long, grade int, f array<int>"), "features")
    there = {r.grade: r["count"] for r in seen.groupBy("grade").count().collect()}  # one row a grade
    if not there:
        return Model(np.zeros(1 << BITS), np.array([-30.0, -29.0]))
    rare = {g: (sum(counts.values()) / len(counts) / counts[g]) ** 0.5 for g in there}
    stands = {g: counts[g] / there[g] * rare[g] for g in there}
    level = sum(there[g] * stands[g] for g in there)
    mean = sum(g * there[g] * stands[g] for g in there) / level
    spread = sum((g - mean) ** 2 * there[g] * stands[g] for g in there) / level
    # counts of at most 2**BITS features, by grade; what goes with the grade is kept
    held = seen.select("grade", F.explode("f").alias("f")).groupBy("f").agg(*[F.count(F.when(F.col("grade") == g, 1)).alias(f"n{g}") for g in range(GRADES)])
    pull = sum((F.col(f"n{g}") * ((g - mean) * stands[g]) for g in there), F.lit(0.0))
    noise = F.sqrt(sum((F.col(f"n{g}") * stands[g] ** 2 for g in there), F.lit(0.0)) * max(spread, 1e-9))
    chosen = held.where((F.col("n0") + F.col("n1") + F.col("n2") >= LEAST_ROWS) & (F.abs(pull) >= LEAST_Z * noise)).select("f").collect()
    alive = np.zeros(1 << BITS, bool)
    alive[[r.f for r in chosen]] = True

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, of = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            ok = alive[flat]
            off = np.searchsorted(of[ok], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(off), pa.array(flat[ok]))], names=["doc_id", "grade", "f"])

    got = seen.mapInArrow(thinned, "doc_id long, grade int, f array<int>").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    rows = [np.asarray(x, np.int64) for x in got.column("f").to_pylist()]
    order = sorted(range(len(rows)), key=lambda k: (got.column("doc_id")[k].as_py(), rows[k].tolist()))  # ids may repeat
    y = got.column("grade").to_numpy().astype(np.int64)[order]
    return fit([rows[k] for k in order], y, np.array([stands.get(g, 0.0) for g in range(GRADES)])[y])


def tails_of(batches: Iterator[pa.RecordBatch], text: int, at: np.ndarray, values: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch, and the tail probabilities of its column `text`. at, values: the weights that aren't 0."""
    w = np.zeros(1 << BITS)
    w[at] = values
    mine, lexicon = Model(w, thresholds), new_lexicon()
    for b in batches:
        s = np.zeros(b.num_rows)
        for i, j, r, f in features(b.column(text), lexicon, w != 0):
            s[i:j] = np.bincount(r, w[f], j - i)
        yield b, mine.tails(s)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns `keep` with expected_grade, p_not_toxic and p_good. docs: also text."""
    at = np.flatnonzero(model.weights)
    values, thresholds, b_text = model.weights[at], model.thresholds, len(keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in tails_of(batches, b_text, at, values, thresholds):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(t.sum(1)), pa.array(t[:, 0]), pa.array(t[:, 1])], names=[*keep, "expected_grade", "p_not_toxic", "p_good"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(scored, f"{fields}, expected_grade double, p_not_toxic double, p_good double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade (0 to 2), p_not_toxic, p_good, kept.

    A document is kept if it is good more likely than not. Null or empty texts have no words and are graded by the
    thresholds and the shares of an empty text. Rows that repeat a doc_id are graded each by its text; an empty table
    gives no rows; columns other than doc_id, text, quality and toxic are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, train(docs, labels), ["doc_id"]).withColumn("kept", F.col("p_good") >= 0.5)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the classifier doesn't reject, with all their columns. Rows that repeat or lack a doc_id are judged each by
    its own text, null as an empty one. An empty table stays empty."""
    model = train(docs, table(spark, sf_dir, "labels"))
    at, values, thresholds = np.flatnonzero(model.weights), model.weights[model.weights != 0], model.thresholds
    where = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in tails_of(batches, where, at, values, thresholds):
            yield b.filter(pa.array(t[:, 1] >= 0.5))

    return docs.mapInArrow(good, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
