"""Hard negatives against brute force and SQL, and the rigour of the bounds."""

import duckdb
import numpy as np
import pytest

from skysift.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, vec array<long>, score string"


def brute(rows, positives=5, negatives=10, low=30, high=90, of=lambda i: i % 10 == 0):
    dim = max((len(v) for _, _, v in rows if v is not None), default=0)
    known = {}
    for i, lab, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]), key=lambda r: (r[0], r[1], r[2])):
        known.setdefault(i, (lab, [*v, *[0] * (dim - len(v))]))
    out = []
    for a, (lab, v) in known.items():
        if not of(a):
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, (m, w) in known.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == lab][:positives]:
            inside = [r for r in ranked if r[2] != lab and low * -s <= -100 * r[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def vectors(seed, n, dim, spread=60):
    rng = np.random.default_rng(seed)
    center = rng.integers(-spread, spread, (4, dim))
    return [(int(i), int(i % 4), (center[i % 3] + rng.integers(-spread, spread, dim)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize(
    ("rows", "blocks"),
    [
        (vectors(1, 300, 7), (64, 8, 1 << 10)),
        (vectors(2, 200, 8) + [(1000 + k, k % 2, [5] * 8) for k in range(150)], (32, 256, 1 << 24)),  # copies: ties by vec_id
        (vectors(3, 80, 4, 1 << 24), (4096, 256, 1 << 24)),  # products of some 52 bits
        (vectors(4, 50, 5) + [(None, 1, [1]), (60, None, [1]), (70, 1, None), (80, 1, [1, None]), (90, 1, [3, 4]), (0, 3, [1] * 5), (0, 2, [9] * 5), (100, 0, [])], (4096, 256, 1 << 24)),
        ([(0, 1, [2, 2]), (1, 1, [3, 3]), (2, 2, [1, 2])], (4096, 256, 1 << 24)),
    ],
)
def test_mine_agrees_with_brute_force(spark, monkeypatch, rows, blocks):
    for name, x in zip(("ROW_BLOCK", "ANCHOR_BLOCK", "ANCHOR_BYTES"), blocks, strict=True):
        monkeypatch.setattr(H, name, x)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in H.mine(df, "vec_id % 10 = 0").collect())
    assert got == brute(rows)


def test_bounds_hold_for_any_centroids():
    rng = np.random.default_rng(8)
    rows, anchors = rng.integers(-900, 900, (500, 9)).astype(float), rng.integers(-900, 900, (20, 9)).astype(float)
    for sample in (rows[:300], rows[:2], rows[:0]):
        book = H.Codebook(sample, 9)
        codes, norms = book.encode(rows)
        gap = np.abs(H.looked_up(book.tables(anchors), codes) - rows @ anchors.T)
        assert (gap <= norms[:, None] * np.sqrt((anchors**2).sum(1))).all()


def test_the_filter_leaves_few_to_score(monkeypatch):
    rng = np.random.default_rng(6)
    rows = (rng.normal(size=(4000, 16)) * 80).round()
    book = H.Codebook(rows[:1500], 16)
    scored = []
    monkeypatch.setattr(H, "exact", lambda v, w, r, a: (scored.append(len(r)), (v @ w.T)[r, a].astype(np.int64))[1])
    asked = H.Asked([np.arange(50).astype("<i8").tobytes(), np.zeros(50, "<i8").tobytes(), rows[:50].astype("<f8").tobytes(), b"", b""], book, 1, 5, None)
    for at in range(0, 4000, 1000):
        part = slice(at, at + 1000)
        asked.meet(np.arange(at, at + 1000), np.zeros(1000, int), rows[part], *book.encode(rows[part]))
    assert sum(scored) < 0.1 * 50 * 4000


def test_errors_and_empty_tables(spark):
    df = spark.createDataFrame([(0, 1, [1 << 40], "x"), (1, 1, [1], "x")], SCHEMA)
    with pytest.raises(ValueError, match="products"):
        H.mine(df, "vec_id = 0")
    assert H.mine(df.limit(0), "vec_id = 0").count() == 0
    assert H.mine(df.where("vec_id = 1"), "vec_id = 0").count() == 0


def test_sql_and_query_agree(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    rel = con.sql(H.SQL)
    df = H.op11_hard_negatives(spark, folder)
    want = sorted(rel.fetchall())
    assert want
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == want
