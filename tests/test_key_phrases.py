"""Key phrases against a plain reading of maximal marginal relevance, on whole documents."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skysift.operators import evaluation as E
from skysift.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(text, keep=5):
    words = re.findall(r"[^\W\d_]+", text.lower())
    grams = list(dict.fromkeys(" ".join(words[i : i + n]) for n in (2, 3, 4) for i in range(len(words) - n + 1)))
    count = lambda ws: Counter(zlib.crc32(w.encode()) % 256 for w in ws)
    cos = lambda a, b: sum(n * b[k] for k, n in a.items()) / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values())))
    vec, doc, out = [count(g.split(" ")) for g in grams], count(words), []
    rel = [cos(v, doc) for v in vec]
    while len(out) < min(10, len(grams)):
        score = lambda k: (1 - 0.7) * rel[k] - 0.7 * max(cos(vec[k], vec[j]) for j in out) if out else rel[k]
        out.append(max((k for k in range(len(grams)) if k not in out), key=score))
    return [grams[k] for k in out[:keep]]


def test_key_phrases_agree_with_brute_force(spark):
    texts = ["", None, "one", "a b", "b a b a b a", "The storm reached the coast; the coast guard reached the storm in the night.", "x y z " * 40 + "w"]
    got = {r.doc_id: r.phrases for r in E.key_phrases(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: plain(t or "") for k, t in enumerate(texts)}


def plain_keywords(texts, share, longest=4, top=10):
    """By the definition: parts between signs and common words, cut every `longest` words, by cosine."""
    low = {k: (t or "").lower() for k, t in texts.items()}
    find = lambda t: re.findall(r"[^\W\d_]+", t)
    held = Counter(w for k, t in low.items() if texts[k] is not None for w in set(find(t)))
    common = {w for w, n in held.items() if n > share * sum(t is not None for t in texts.values())}
    count = lambda ws: Counter(zlib.crc32(w.encode()) % 256 for w in ws)
    cos = lambda a, b: sum(n * b[k] for k, n in a.items()) / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values())))
    out = {}
    for k, t in low.items():
        runs = []
        for part in re.split(r"(?:\s*[^\s\w]|\s*[\d_])+\s*", t):
            run = []
            for w in [*find(part), None]:
                if w is None or w in common:
                    runs += [" ".join(run[i : i + longest]) for i in range(0, len(run), longest)]
                    run = []
                else:
                    run.append(w)
        own, doc = list(dict.fromkeys(runs)), count(find(t))
        scored = [(cos(count(r.split(" ")), doc), r) for r in own]
        out[k] = [(r, s) for s, r in sorted(scored, key=lambda x: -round(x[0], 12))[:top]]
    return out


def test_keywords_agree_with_brute_force(spark):
    texts = dict(enumerate(["", None, "one", "the red roof, the old red roof and the car", "The storm reached the coast; the coast guard reached the storm in the night.", "alpha beta gamma delta epsilon zeta eta theta iota", "the 12 cars_and roofs"]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [(x.phrase, x.score) for x in r.keywords] for r in E.keywords(df, share=0.3).collect()}
    want = plain_keywords(texts, 0.3)
    assert {k: [p for p, _ in v] for k, v in got.items()} == {k: [p for p, _ in v] for k, v in want.items()}
    assert all(got[k][i][1] == pytest.approx(s) for k, v in want.items() for i, (_, s) in enumerate(v))
    assert "the" not in {p for v in got.values() for p, _ in v}
    chosen = {r.doc_id: r.texts for r in E.key_texts(df, share=0.3).collect()}
    assert chosen[0] == chosen[1] == [] and chosen[2] == ["one"]
    for k, v in want.items():  # those that are phrases as well come first
        phrases = plain(texts[k] or "", 10)
        first = [p for p in phrases if p in dict(v)]
        assert chosen[k] == [*first, *(p for p, _ in v if p not in first)][:5]
    assert E.key_texts(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are needed")
def test_q37_covers_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.phrases for r in QUERIES["q37_mmr_keyphrases"](spark, DATA).collect()}
    assert got.keys() == docs.keys()
    some = [k for k in sorted(docs) if docs[k] and len(docs[k]) < 3000][:10]
    assert {k: got[k] for k in some} == {k: plain(docs[k]) for k in some}


@pytest.mark.parametrize("words", [["a"] * 5, ["a", "b"] * 6 + ["c"], [f"w{k % 60_001}" for k in range(70_000)]])
def test_equal_runs_are_one_without_a_string_for_each(words):
    runs = [(i, n) for n in (2, 3, 4) for i in range(len(words) - n + 1)]
    grams = E.Grams(words, *np.array(runs).T)
    assert [grams.name(k) for k in range(len(grams))] == list(dict.fromkeys(" ".join(words[i : i + n]) for i, n in runs))
