"""Language of text by a linear-chain conditional random field over words.

Each word is labelled with a language. Its score sums weights of hashed features: the word itself if the lexicon has it,
prefixes, suffixes, letter n-grams, and the language that the lexicon favours; learned transitions tie neighbouring
words together, so code-switched text is labelled in stretches. Forward-backward gives each word its posterior; a
document's language is the one with the largest mean posterior.

The field is fitted in the driver on the whole texts of at most about SAMPLE documents of each language, chosen by a hash;
stretches of several languages are put together, from which the transitions are learned. Only texts and languages of the
rows marked as learnable are used; every document is then labelled, whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.shared import table
from skysift.llm.textcols import Lexicon, encoded, gather, letter_classes, mix, raw, runs, slices

SAMPLE = 120
BITS = 16
UNKNOWN = "und"


def grams(words: list[str], favoured: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The features of each word, one word after the other, and how many each has."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    end = np.cumsum(size)
    begin, word = end - size, np.repeat(np.arange(len(words)), size)

    def hashed(start: np.ndarray, n: int, kind: int) -> np.ndarray:
        key = np.full(len(start), kind + 1, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + cp[start + i]
        return (mix(key) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    owner, number = [], []
    with np.errstate(over="ignore"):
        for n in (2, 3):
            at = np.flatnonzero(np.arange(len(cp)) + n <= end[word])
            owner.append(word[at])
            number.append(hashed(at, n, n))
        for kind, ns in ((10, (2, 3, 4)), (20, (2, 3, 4, 5))):
            for n in ns:
                k = np.flatnonzero(size >= n)
                owner.append(k)
                number.append(hashed(begin[k] if kind == 10 else end[k] - n, n, kind + n))
    liked = np.fromiter((favoured.get(w, -1) for w in words), np.int64, len(words))
    k = np.flatnonzero(liked >= 0)
    known = np.fromiter((zlib.crc32(words[i].encode()) & ((1 << BITS) - 1) for i in k), np.int64, len(k))
    owner += [k, k]
    number += [known, (mix(liked[k].astype(np.uint64) + np.uint64(1000)) & np.uint64((1 << BITS) - 1)).astype(np.int64)]
    owner, number = np.concatenate(owner), np.concatenate(number)
    order = np.argsort(owner, kind="stable")
    return number[order], np.bincount(owner, minlength=len(words))


class Field:
    """weights: (2**BITS, L) of features; moves: (L, L) of transitions; begin: (L,)."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages, self.favoured = languages, {}
        self.weights, self.moves, self.begin = np.zeros((1 << BITS, n), np.float32), np.zeros((n, n)), np.zeros(n)

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        flat, size = grams(words, self.favoured)
        return np.add.reduceat(self.weights[flat], np.cumsum(size) - size, axis=0)

    def posteriors(self, scores: np.ndarray, off: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(label of each word), by forward-backward over all rows at once; with pairs also the expected transitions.

        Row r has the words off[r]:off[r + 1]. Step t treats the t-th word of every row that has one."""
        n = scores.shape[1]
        e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
        move, size = np.exp(self.moves - self.moves.max()), np.diff(off)
        order = np.argsort(-size, kind="stable")
        begin, size = off[:-1][order], size[order]
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        alpha, beta, moved = np.zeros_like(e), np.zeros_like(e), np.zeros((n, n))
        for t, k in enumerate(live):
            at = begin[:k] + t
            a = (np.exp(self.begin - self.begin.max()) if t == 0 else a[:k] @ move) * e[at]
            a = a / a.sum(1, keepdims=True)
            alpha[at] = a
        b = np.zeros((0, n))
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            if len(b):
                after = begin[: len(b)] + t + 1
                eb = e[after] * b
                if pairs:
                    joint = alpha[after - 1][:, :, None] * move[None] * eb[:, None, :]
                    moved += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                b = eb @ move.T
                b = b / b.sum(1, keepdims=True)
            if len(b) < k:
                b = np.concatenate([b, np.full((k - len(b), n), 1 / n)])
            beta[begin[:k] + t] = b
        post = alpha * beta
        return post / np.maximum(post.sum(1, keepdims=True), 1e-300), moved


def learn(stretches: list[tuple[int, list[str]]], languages: list[str], epochs: int = 4, rate: float = 0.2, batch: int = 48, least: int = 3) -> Field:
    """Adaptive gradients of the conditional likelihood. stretches: (language, words of a text)."""
    field, n = Field(languages), len(languages)
    seen: dict[str, Counter] = {}
    for k, words in stretches:
        for w in words:
            seen.setdefault(w, Counter())[k] += 1
    field.favoured = {w: c.most_common(1)[0][0] for w, c in sorted(seen.items()) if sum(c.values()) >= least and c.most_common(1)[0][1] > 0.8 * sum(c.values())}
    vocabulary = {w: i for i, w in enumerate(sorted(seen))}
    flat, size = grams(list(vocabulary), field.favoured)
    first = np.cumsum(size) - size
    rng = np.random.default_rng(11)
    g2, m2, b2 = np.full_like(field.weights, 1e-2), np.full((n, n), 1.0), np.full(n, 1.0)
    for _ in range(epochs):
        parts = []  # stretches cut anew and put together in rows of one to four
        for k, words in stretches:
            at = 0
            while at < len(words):
                step = int(rng.integers(4, 60))
                parts.append((k, words[at : at + step]))
                at += step
        parts = [parts[i] for i in rng.permutation(len(parts))]
        rows = []
        while parts:
            take = int(rng.integers(1, 5))
            rows.append(parts[:take])
            parts = parts[take:]
        for at in range(0, len(rows), batch):
            some = rows[at : at + batch]
            words = np.array([vocabulary[w] for row in some for _, ws in row for w in ws])
            gold = np.array([k for row in some for k, ws in row for _ in ws])
            off = np.concatenate([[0], np.cumsum([sum(len(ws) for _, ws in row) for row in some])])
            kinds, idx = np.unique(words, return_inverse=True)
            ranges = gather(first[kinds], size[kinds])
            cols, owner = flat[ranges], np.repeat(np.arange(len(kinds)), size[kinds])
            emission = np.stack([np.bincount(owner, field.weights[cols, j], len(kinds)) for j in range(n)], 1)
            post, moved = field.posteriors(emission[idx], off, pairs=True)
            d = post.copy()
            d[np.arange(len(gold)), gold] -= 1
            by_kind = np.stack([np.bincount(idx, d[:, j], len(kinds)) for j in range(n)], 1)
            some_cols = np.unique(cols)
            place = np.searchsorted(some_cols, cols)
            g = np.stack([np.bincount(place, by_kind[owner, j], len(some_cols)) for j in range(n)], 1) / len(gold) * 32
            g2[some_cols] += g * g
            field.weights[some_cols] -= rate * g / np.sqrt(g2[some_cols])
            inner = np.ones(len(gold), bool)
            inner[off[:-1]] = False
            k = np.flatnonzero(inner)
            np.add.at(moved, (gold[k - 1], gold[k]), -1)
            db = post[off[:-1]].sum(0) - np.bincount(gold[off[:-1]], minlength=n)
            for x, h, d2 in ((field.moves, m2, moved / max(len(k), 1) * 32), (field.begin, b2, db / len(some))):
                h += d2 * d2
                x -= rate * d2 / np.sqrt(h)
    return field


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """For slices of rows: first row, end, distinct words, the index of each word, each row's first word. Words are runs of letters, lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for i, j in slices(texts):
        data, off = raw(pc.utf8_lower(texts.slice(i, j - i)))
        s, e, first, packed = runs(data, off, letter_classes())
        words, idx = encoded(s, e, packed)
        yield i, j, words, idx, first


def train(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Field:
    """From docs' text and lang where learnable holds; sample bounds the rows of a language."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Field([UNKNOWN])
    pick = F.xxhash64("text", F.lit(3))
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, sample / c))])
    some = rows.where(F.pmod(pick, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).distinct()  # copies count once
    got = sorted({(r.lang, r.text) for r in some.collect()})
    languages, out = sorted(counts), []
    for _, _, words, idx, first in words_of(pa.array([t for _, t in got], pa.large_string())):
        out += [[words[k] for k in idx[s:e]] for s, e in zip(first[:-1], first[1:], strict=True)]
    return learn([(languages.index(k), w) for (k, _), w in zip(got, out, strict=True) if w], languages)


def label(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """docs' columns `keep` with lang_pred, score (the mean posterior of lang_pred), n_words, and switches (places where the label changes)."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(field.emissions)
        for b in batches:
            for i, j, words, idx, first in words_of(b.column(b.num_columns - 1)):
                pred, score, count, switches = np.full(j - i, UNKNOWN, object), np.zeros(j - i), np.diff(first), np.zeros(j - i, np.int64)
                has = np.flatnonzero(count)
                if len(has):
                    post, _ = field.posteriors(lexicon(words)[idx], first)
                    mean = np.add.reduceat(post, first[:-1][has], axis=0) / count[has, None]
                    pred[has], score[has] = np.array(field.languages, object)[mean.argmax(1)], np.clip(mean.max(1), 0, 1)
                    best = post.argmax(1)
                    change = np.concatenate([[0], best[1:] != best[:-1]])
                    change[first[:-1][has]] = 0
                    switches[has] = np.add.reduceat(change, first[:-1][has])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[:-1]], pa.array(pred, pa.string()), pa.array(score), pa.array(count), pa.array(switches)], names=[*keep, "lang_pred", "score", "n_words", "switches"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(labelled, f"{fields}, lang_pred string, score double, n_words long, switches long")


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, n_words, switches.

    Rows whose crc32 of doc_id (as text) is divisible by 5 are held out, and so are rows without doc_id. Null texts and
    texts without a letter are `und` with score 0. With nothing to learn from, all is `und`. Rows that repeat a doc_id
    are labelled each by its text; an empty table gives no rows; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    rows = docs.select("doc_id", held.alias("held_out"), "lang", "text")
    return label(rows, train(rows, ~F.col("held_out")), ["doc_id", "held_out"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
