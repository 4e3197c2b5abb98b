"""Conversation repair against a dynamic program over whole conversations, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from skysift.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, __how string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        text = {1: "", 2: text.translate(dict.fromkeys(map(ord, ".!?")))}.get(how, text)
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def brute(rows):
    """Digests by conversation: cheapest edits of least letters, all states held with their letters and lines."""
    want = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = {r[1] for r in own} - {None}
        n, seen, items = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, _, role, text in own:
            said = text.strip(SPACES)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            items.append((role, text, fault))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(items, items[1:], strict=False)]
        states = {"0": (0, "", ())}
        go = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        names = {"u": "user", "a": "assistant"}

        def better(into, q, way):
            if q not in into or way < into[q]:
                into[q] = way

        def inserted(states):
            for _ in range(4):
                for q, (cost, said, lines) in list(states.items()):
                    for x, to in go[q].items():
                        if x in names:
                            better(states, to, (cost + 3, said + "I", (*lines, names[x] + ":")))
            return states

        for role, text, fault in items:
            then = {}
            for q, (cost, said, lines) in inserted(states).items():
                better(then, q, (cost + 4, said + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 if fault else 0
                for x, to in go[q].items():
                    if role[:1] == x:
                        better(then, to, (cost + more, said + "K", (*lines, f"{role}:{text}")))
                    if x in names:
                        better(then, to, (cost + 3 + more, said + "R", (*lines, f"{names[x]}:{text}")))
            states = then
        cost, said, lines = min(w for q, w in inserted(states).items() if q in "0a")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        want[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, said, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def made(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three? ", "cut", "", "  \t", None, "ünï. \n", "a", "."]
    rows = []
    for conv in [*range(conversations), None]:
        for k in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else k + rng.randint(-1, 1)
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.4 else f"Said {rng.random()}."))
    return rows


@pytest.mark.parametrize(("rows", "batch"), [(made(1, 60, 9), 10_000), (made(2, 40, 12), 4), (made(3, 1, 400), 16), ([(5, 1, "user", "Hm.")] * 90 + made(4, 6, 5), 3)])
def test_repair_agrees_with_brute_force(spark, rows, batch):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # conversations of many pieces
    try:
        df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
        got = {r.conv_id: tuple(r[n] for n in [*C.RESULT, "audit", "repaired_sha256"]) for r in C.audited(C.repair(C.damaged(df))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == brute(rows)


def test_sql_agrees_with_brute_force():
    rows = made(7, 25, 9)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(C.SQL)
    got = {r["conv_id"]: tuple(r[n] for n in [*C.RESULT, "audit", "repaired_sha256"]) for r in (dict(zip(rel.columns, x, strict=True)) for x in rel.fetchall())}
    assert got == brute(rows)


def test_repaired_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hello there.", 1), (1, 1, "user", "And again.", 1), (2, 0, "tool", "x", 0)], "conv_id long, turn long, role string, text string, copies long")
    rows = [(r.conv_id, r.role, r.text) for r in C.repaired_rows(C.repair(df)).orderBy("conv_id", "part", "seq", "pos").collect()]
    assert rows == [(1, "user", "Hello there."), (1, "assistant", "And again.")]
    got = {r.conv_id: r for r in C.audited(C.repair(df)).collect()}
    assert got[1].audit == "KR" and got[1].cost == 3 and got[2].audit == "" and got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert C.audited(C.repair(df.limit(0))).count() == 0
