"""Conversation structure repair by a lazily determinised weighted automaton.

A repaired conversation's roles are nothing, or perhaps one system turn and then user and assistant by turns. Four states read
such roles; edits of a row (keep, rerole, delete, insert before it) are arcs with costs. The costs of all four states after some rows,
less their minimum, are one state of the determinised automaton. It is made when a row first leads there and kept in a
transition table with what the row adds to the minimum, so costs come from one look in the table a row. Costs that a state can
never make up for are put to infinity, which keeps the vectors few. Going back from the last row, arcs that add up exactly (tight
ones) mark what lies on a cheapest way; reading forward along the marks, least letter first, gives the audit. Both steps are kept in
tables as well.

Rows are sorted into ranges, not gathered by conversation: a piece is what one batch of a range holds of one conversation. Most
conversations are one piece. For others each piece is a matrix of costs from state to state; going back over the matrices gives
each piece the costs that are still to come, going forward over its rows' kinds (not their texts) its first state. Then all pieces are
repaired by themselves.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.shared import small, stored, table

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
INF = 1 << 40
SPACE = " \t\n\x0b\x0c\r"

#: States: nothing read, system read, user read, assistant read. Kinds of roles: system, user, assistant (by initial), another.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NEXT = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
#: The role that an inserted or reroled row gets in each state, and the state after it.
MADE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: What each state costs from the end of a conversation on: nothing where the roles may end, else insertions.
FINAL = (0, 2 * INSERT, INSERT, 0)

#: A row as the automaton sees it: its role's kind if it is sound, that and CUT if it is truncated, GONE if it has to be deleted.
CUT, GONE = 4, 8


class Automaton:
    """The determinised automaton, as far as rows have led into it."""

    def __init__(self) -> None:
        self.index: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.marks: dict[tuple[int, int, int], int] = {}
        self.steps: dict[tuple[int, int, int, int], tuple[str, int]] = {}

    def state(self, costs: list[int]) -> tuple[int, int]:
        """The number of a vector, insertions included, and its minimum."""
        v = list(costs)
        for _ in range(3):
            for q, (_, to) in enumerate(MADE):
                v[to] = min(v[to], v[q] + INSERT)
        # from state 3 all that can follow states 0 and 1 can follow as well, a system turn deleted
        if v[0] > v[3] + DELETE:
            v[0] = INF
        if v[1] > v[3]:
            v[1] = INF
        low = min(v)
        key = tuple(x - low if x < INF else INF for x in v)
        if key not in self.index:
            self.index[key] = len(self.vectors)
            self.vectors.append(key)
        return self.index[key], low

    def start(self, q: int) -> int:
        return self.state([0 if k == q else INF for k in range(4)])[0]

    def arcs(self, q: int, row: int) -> list[tuple[str, int, int]]:
        """(letter, cost, state) of what can become of a row in state q, by letter."""
        out = [("D", DELETE, q)]
        if row != GONE:
            kind, more = row % CUT, TRUNCATED * (row >= CUT)
            if kind in NEXT[q]:
                out.append(("K", more, NEXT[q][kind]))
            out.append(("R", REROLE + more, MADE[q][1]))
        return out

    def next(self, s: int, row: int) -> tuple[int, int]:
        """The state after a row, and what is added to the minimum."""
        got = self.table.get((s, row))
        if got is None:
            v, after = self.vectors[s], [INF] * 4
            for q in range(4):
                if v[q] < INF:
                    for _, cost, to in self.arcs(q, row):
                        after[to] = min(after[to], v[q] + cost)
            got = self.table[s, row] = self.state(after)
        return got

    def mark(self, s: int, row: int, after: int) -> int:
        """The states before a row (as bits) from which tight arcs lead to the marked ones after it."""
        got = self.marks.get((s, row, after))
        if got is None:
            v, (to, add) = self.vectors[s], self.next(s, row)
            w, got = self.vectors[to], 0
            for q in range(4):
                if v[q] < INF and any(after >> x & 1 and v[q] + cost == add + w[x] for _, cost, x in self.arcs(q, row)):
                    got |= 1 << q
            for _ in range(3):
                for q, (_, x) in enumerate(MADE):
                    if got >> x & 1 and v[q] < INF and v[q] + INSERT == v[x]:
                        got |= 1 << q
            self.marks[s, row, after] = got
        return got

    def step(self, s: int, row: int, after: int, q: int) -> tuple[str, int]:
        """The least letters by which a row, and insertions before it, lead from state q to a marked one."""
        got = self.steps.get((s, row, after, q))
        if got is None:
            v, (to, add) = self.vectors[s], self.next(s, row)
            w, marked, said, at = self.vectors[to], self.mark(s, row, after), "", q
            while True:
                ways = [(letter, x, True) for letter, cost, x in self.arcs(at, row) if after >> x & 1 and v[at] + cost == add + w[x]]
                x = MADE[at][1]
                if marked >> x & 1 and v[at] + INSERT == v[x]:
                    ways.append(("I", x, False))
                letter, at, done = min(ways)
                said += letter
                if done:
                    break
            got = self.steps[s, row, after, q] = said, at
        return got

    def costs(self, rows: list[tuple[int, int]], q: int) -> list[int]:
        """From state q over rows (row, times) to each state."""
        s, total = self.start(q), 0
        for row, times in rows:
            s, add = self.next(s, row)
            total += add + DELETE * (times - 1)  # only deleted rows are repeated, and they change no state
        return [total + x if x < INF else INF for x in self.vectors[s]]

    def trace(self, rows: list[tuple[int, int]], q: int, togo: list[int]) -> tuple[list[tuple[str, int]], int]:
        """(letters, times) of each of the rows, and the state after them, on the cheapest way of least letters from state q; togo: what each state costs from there on."""
        seen = [self.start(q)]
        for row, _ in rows:
            seen.append(self.next(seen[-1], row)[0])
        total = [min(x + y, INF) for x, y in zip(self.vectors[seen[-1]], togo, strict=True)]
        marked = [sum(1 << k for k in range(4) if total[k] == min(total))]
        for s, (row, _) in zip(seen[-2::-1], rows[::-1], strict=True):
            marked.append(self.mark(s, row, marked[-1]))
        marked.reverse()
        out, at = [], q
        for s, (row, times), after in zip(seen, rows, marked[1:], strict=False):
            letters, at = self.step(s, row, after, at)
            out.append((letters, times))
        return out, at


@functools.lru_cache(1)
def automaton() -> Automaton:
    """One for each Python worker."""
    return Automaton()


#: A deleted row that is repeated more often than this is folded: in so many repeats insertions between them have found their place.
FOLD = 4


def seen_rows(copies: list[int], kinds: list[int], faults: list[int]) -> list[tuple[int, int, int]]:
    """(row, times, place) as the automaton sees the rows of a piece. Copies after the first are duplicates, unless the row is blank, and deleted all the same."""
    out = []
    for k, (n, kind, fault) in enumerate(zip(copies, kinds, faults, strict=True)):
        if n and fault not in (BLANK, DUPLICATE):
            out.append((kind + CUT * (fault == LATE), 1, k))
            n -= 1
        if n > FOLD:
            out.append((GONE, n - FOLD + 1, k))
            n = FOLD - 1
        out += [(GONE, 1, k)] * n
    return out


# ---------------------------------------------------------------- rows and pieces

NONE, BLANK, DUPLICATE, LATE = range(4)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as a careless export would leave them, by crc32 of conv_id:turn modulo 20. Lost rows have 0 copies and nothing else, so that their conversation is known."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("__how"))
    lost = F.col("__how") == 0
    text = F.when((F.col("__how") == 1) | lost, "").when(F.col("__how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(lost, "").when(F.col("__how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(lost, 0).when(F.col("__how") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", F.when(~lost, F.col("turn").cast("long")).alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with equal ones as one, kind (of the role) and fault (of the first copy): blank, duplicate (role and text stand in an earlier row) or truncated."""
    equal = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    equal = equal.withColumn("__said", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = equal.where("copies > 0").groupBy(F.col("conv_id").alias("__c"), F.col("__said").alias("__s")).agg(F.min(turn).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    known = equal.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__said") == F.col("__s")), "left")
    again = F.col("__first").isNotNull() & ~turn["turn"].eqNullSafe(F.col("__first.turn"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(F.btrim("text", F.lit(SPACE)) == "", BLANK).when(again, DUPLICATE).when(~end.isin(*".!?"), LATE).otherwise(NONE)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    return known.select("conv_id", "turn", "role", "text", "copies", kind.cast("tinyint").alias("kind"), fault.cast("tinyint").alias("fault"))


ROWS = {"turn": "long", "role": "string", "text": "string", "copies": "long", "kind": "tinyint", "fault": "tinyint"}


def pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, part, seq, edge, arrays of the rows' columns): judged rows in order, as pieces of conversations. Pieces that are not at the edge of a batch are whole conversations."""
    lead = F.substring("text", 1, 64)  # equal keys stay together, so the order by whole texts is the order over all ranges
    ranges = rows.repartitionByRange("conv_id", "turn", "role", lead).sortWithinPartitions("conv_id", "turn", "role", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0)
            there, value = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
            at = np.flatnonzero(np.concatenate([[True], (there[1:] != there[:-1]) | (value[1:] != value[:-1])]))
            off = pa.array(np.append(at, b.num_rows).astype(np.int32))
            edge = np.zeros(len(at), bool)
            edge[[0, -1]] = True
            lists = [pa.ListArray.from_arrays(off, b.column(k + 1)) for k in range(len(ROWS))]
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(at)), pa.array(np.full(len(at), part, np.int32)), pa.array(np.full(len(at), seq, np.int64)), pa.array(edge), *lists], names=["conv_id", "part", "seq", "edge", *ROWS])
            seq += 1

    cells = ", ".join(f"{n} array<{kind}>" for n, kind in ROWS.items())
    return ranges.select(F.col("conv_id").cast("long").alias("conv_id"), *ROWS).mapInArrow(cut, f"conv_id long, part int, seq long, edge boolean, {cells}")


# ---------------------------------------------------------------- conversations of several pieces

AT = ["conv_id", "part", "seq"]


def runs(columns: list[list]) -> list[tuple[int, int]]:
    return [(row, times) for row, times, _ in seen_rows(*columns)]


def entries(of: DataFrame) -> DataFrame:
    """(conv_id, part, seq, entry, togo, last) of pieces: the state that each begins in, what each state costs from its end on, and whether none comes after it."""
    kinds = of.select(*AT, "copies", "kind", "fault")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            made = [[x for q in range(4) for x in auto.costs(rows, q)] for rows in map(runs, zip(*(c.to_pylist() for c in b.columns[3:6]), strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.list_(pa.int64()))], names=[*AT, "matrix"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, togo, begun = None, list(FINAL), False
        for b in batches:
            out, last = [], []
            for c, m in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not begun or c != conv:
                    conv, togo, begun = c, list(FINAL), True
                    last.append(True)
                else:
                    last.append(False)
                out.append(togo)
                togo = [min(min(m[4 * q + x] + togo[x] for x in range(4)), INF) for q in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.int64())), pa.array(last, pa.bool_())], names=[*AT, "togo", "last"])

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, conv, state, begun = automaton(), None, 0, False
        for b in batches:
            out = []
            for c, togo, *columns in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), *(x.to_pylist() for x in b.columns[5:8]), strict=True):
                if not begun or c != conv:
                    conv, state, begun = c, 0, True
                out.append(state)
                state = auto.trace(runs(columns), state, togo)[1]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.int32()), b.column(3), b.column(4)], names=[*AT, "entry", "togo", "last"])

    keys = "conv_id long, part int, seq long"
    cost = kinds.mapInArrow(matrices, f"{keys}, matrix array<long>").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    togo = cost.mapInArrow(back, f"{keys}, togo array<long>, last boolean")
    both = at_pieces(togo, kinds).repartition("conv_id").sortWithinPartitions(*AT)
    return both.select(*AT, "togo", "last", "copies", "kind", "fault").mapInArrow(forth, f"{keys}, entry int, togo array<long>, last boolean")


def at_pieces(left: DataFrame, right: DataFrame) -> DataFrame:
    named = right.withColumnsRenamed({"conv_id": "__c", "part": "__p", "seq": "__q"})
    return left.join(named, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")) & (F.col("seq") == F.col("__q"))).drop("__c", "__p", "__q")


# ---------------------------------------------------------------- repair

FACTS = {"blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "turns": "long", "low": "long", "high": "long", "first": "int", "final": "int", "cost": "long"}


def facts(turn: list, copies: list[int], kinds: list[int], faults: list[int]) -> list:
    """What FACTS names, of one piece, without its cost. first and final are the kinds of its first and last role."""
    n, illegal, seen, last, first = [0] * 4, 0, [], None, None
    for t, c, kind, fault in zip(turn, copies, kinds, faults, strict=True):
        if not c:
            continue
        n[fault] += 1
        n[BLANK if fault == BLANK else DUPLICATE] += c - 1
        illegal += (last is not None and (last, kind) not in LEGAL) + c - 1  # equal roles side by side
        first, last = kind if first is None else first, kind
        if t is not None and (not seen or seen[-1] != t):
            seen.append(t)
    return [n[BLANK], n[DUPLICATE], n[LATE], illegal, len(seen), seen[0] if seen else None, seen[-1] if seen else None, first, last]


def mended(of: DataFrame) -> DataFrame:
    """(conv_id, part, seq, single, FACTS, audit, rows) of pieces with entry, togo, last and single; rows are the repaired ones, array<struct<role,text>>."""

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            out: list[list] = [[] for _ in range(len(FACTS) + 1)]
            roles, texts, off = [], [], [0]
            for entry, togo, last, turn, role, text, copies, kinds, faults in zip(*(b.column(k).to_pylist() for k in range(4, 13)), strict=True):
                seen = seen_rows(copies, kinds, faults)
                letters, state = auto.trace([(row, times) for row, times, _ in seen], entry, togo)
                said, cost, at = [], 0, entry
                for (word, times), (row, _, k) in zip(letters, seen, strict=True):
                    said.append(word[:-1] + word[-1] * times)
                    for _ in word[:-1]:
                        roles.append(MADE[at][0])
                        texts.append("")
                        cost, at = cost + INSERT, MADE[at][1]
                    if word[-1] == "D":
                        cost += DELETE * times
                        continue
                    kept = word[-1] == "K"
                    roles.append(role[k] if kept else MADE[at][0])
                    texts.append(text[k])
                    cost, at = cost + (0 if kept else REROLE) + TRUNCATED * (row >= CUT), NEXT[at][row % CUT] if kept else MADE[at][1]
                while last and FINAL[state]:
                    said.append("I")
                    roles.append(MADE[state][0])
                    texts.append("")
                    cost, state = cost + INSERT, MADE[state][1]
                off.append(len(roles))
                for column, x in zip(out, [*facts(turn, copies, kinds, faults), cost, "".join(said)], strict=True):
                    column.append(x)
            kinds_of = [*(pa.int32() if k == "int" else pa.int64() for k in FACTS.values()), pa.string()]
            rows = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["role", "text"]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x, k) for x, k in zip(out, kinds_of, strict=True)), rows], names=[*AT, "single", *FACTS, "audit", "rows"])

    cells = ", ".join(f"{n} {kind}" for n, kind in FACTS.items())
    return of.select(*AT, "single", "entry", "togo", "last", *ROWS).mapInArrow(mend, f"conv_id long, part int, seq long, single boolean, {cells}, audit string, rows array<struct<role:string,text:string>>")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations, in pieces: conv_id, part, seq (the order of a conversation's pieces), single (whether it is its conversation's only one), FACTS, audit, rows array<struct<role,text>>.

    rows: conv_id, turn, role, text, copies; rows of a conversation are taken by turn (nulls first), then role, then text. A null
    conv_id is a conversation of its own. A row with 0 copies only makes its conversation known. A role that is neither
    system, user nor assistant by its initial is reroled or deleted. An empty table gives no rows."""
    cut = stored(pieces(judged(rows)), "pieces")
    several = small(cut.where("edge").groupBy(F.col("conv_id").alias("__several")).count().where("count > 1").select("__several"))
    same = F.col("conv_id").eqNullSafe(F.col("__several"))
    single = cut.join(several, same, "left_anti").withColumns({"entry": F.lit(0), "togo": F.array(*map(F.lit, FINAL)).cast("array<long>"), "last": F.lit(True), "single": F.lit(True)})
    parted = cut.where("edge").join(several, same, "left_semi")
    return mended(single.unionByName(at_pieces(stored(entries(parted), "entries"), parted).withColumn("single", F.lit(False)).select(*single.columns)))


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """(conv_id, part, seq, pos, role, text): the rows of repair(), in the order of these columns."""
    return repaired.select(*AT, F.posexplode("rows").alias("pos", "x")).select(*AT, "pos", "x.role", "x.text")


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audited(repaired: DataFrame) -> DataFrame:
    """One row per conversation of repair(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A digest needs its bytes in order, so the texts of a conversation of
    several pieces stream through one task, one piece at a time."""
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    kept = stored(repaired.select(*AT, "single", *FACTS, "audit", F.size("rows").alias("n"), lines.alias("lines")), "repaired")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    single = kept.where("single").select("conv_id", gaps.alias("gaps"), *RESULT[1:], "audit", F.sha2("lines", 256).alias("repaired_sha256"))
    names = ["conv_id", *RESULT, "audit", "repaired_sha256"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, total, begun = None, None, False

        def result() -> pa.RecordBatch:
            low, high = total["low"], total["high"]
            row = [conv, 0 if low is None else high - low + 1 - total["turns"], *(total[n] for n in RESULT[1:]), "".join(total["audit"]), total["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row[:-2]), *(pa.array([x], pa.string()) for x in row[-2:])], names=names)

        for b in batches:
            for k in range(b.num_rows):
                c = b.column(0)[k].as_py()
                x = {n: b.column(n)[k].as_py() for n in [*FACTS, "audit", "n", "lines"]}
                if not begun or c != conv:
                    if begun:
                        yield result()
                    conv, begun = c, True
                    total = dict.fromkeys((*RESULT, "turns", "n"), 0) | {"low": None, "high": None, "final": None, "audit": [], "sha": hashlib.sha256()}
                for n in ("blank", "duplicate", "truncated", "illegal", "turns", "cost"):
                    total[n] += x[n]
                if x["first"] is not None:
                    total["illegal"] += total["final"] is not None and (total["final"], x["first"]) not in LEGAL
                    total["final"] = x["final"]
                if x["low"] is not None:
                    total["turns"] -= total["high"] == x["low"]
                    total["low"] = x["low"] if total["low"] is None else total["low"]
                    total["high"] = x["high"]
                total["audit"].append(x["audit"])
                if x["n"]:
                    total["sha"].update(("\n" * (total["n"] > 0) + x["lines"]).encode())
                    total["n"] += x["n"]
        if begun:
            yield result()

    ordered = kept.where("NOT single").select("conv_id", "part", "seq", *FACTS, "audit", "n", "lines").repartition("conv_id").sortWithinPartitions(*AT)
    counts = ", ".join(f"{n} long" for n in RESULT)
    return single.unionByName(ordered.mapInArrow(joined, f"conv_id long, {counts}, audit string, repaired_sha256 string"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return audited(repair(damaged(table(spark, sf_dir, "conversations"))))


# ---------------------------------------------------------------- the same in SQL


def least_sql(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def way_sql(state: str, letter: str, cost: str, line: str | None = None, only: str = "true") -> str:
    """A state's cost, letters and lines after one more edit."""
    said = f"{state}.r || chr(10) || {line}" if line else f"{state}.r"
    return f"{{'c': CASE WHEN {only} THEN {state}.c + {cost} ELSE {INF} END, 'a': {state}.a || '{letter}', 'r': {said}}}"


def inserted_sql(rows: str, name: str, keep: str) -> str:
    """rows with insertions: into the user's state, then from there into the assistant's."""
    user, assistant = "'user:'", "'assistant:'"
    to_user = least_sql("s2", *(way_sql(s, "I", str(INSERT), user) for s in ("s0", "s1", "s3")))
    return f"""
{name}2 AS (SELECT {keep}, s0, s1, {to_user} AS s2, s3 FROM {rows}),
{name} AS (SELECT {keep}, s0, s1, s2, {least_sql("s3", way_sql("s2", "I", str(INSERT), assistant))} AS s3 FROM {name}2)"""


def row_sql() -> str:
    """The four states after the row of table o."""
    more = f"{TRUNCATED} * CAST(fault = {LATE} AS BIGINT)"
    sound = f"fault IN ({NONE}, {LATE})"
    keep = lambda s, kind: way_sql(s, "K", more, "role || ':' || text", f"{sound} AND initial = '{kind}'")
    change = lambda s, role: way_sql(s, "R", f"{REROLE} + {more}", f"'{role}:' || text", sound)
    drop = lambda s: way_sql(s, "D", str(DELETE))
    others = [f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (change, "user"))]
    return f"{drop('s0')} AS s0, {least_sql(drop('s1'), keep('s0', 's'))} AS s1, {least_sql(drop('s2'), *others)} AS s2, {least_sql(drop('s3'), keep('s2', 'a'), change('s2', 'assistant'))} AS s3"


NEVER = f"{{'c': {INF}, 'a': '', 'r': ''}}"
SPACE_SQL = " || ".join(f"chr({ord(c)})" for c in SPACE)

SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS key FROM conversations),
h AS (SELECT k.* EXCLUDE (key), xor(list_reduce(list_concat([4294967295], key), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM k, crc),
g AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE how <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM g),
o AS (SELECT *, left(role, 1) AS initial, CASE WHEN trim(text, {SPACE_SQL}) = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {DUPLICATE} WHEN right(trim(text, {SPACE_SQL}), 1) NOT IN ('.', '!', '?') THEN {LATE} ELSE {NONE} END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {LATE}) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM o GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations),
w AS (
  SELECT conv_id, 0 AS done, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS s0, {NEVER} AS s1, {NEVER} AS s2, {NEVER} AS s3 FROM c
  UNION ALL
  SELECT * FROM (
    WITH {inserted_sql("w", "x", "conv_id, done")}
    SELECT x.conv_id, done + 1 AS done, {row_sql()} FROM x JOIN o ON o.conv_id IS NOT DISTINCT FROM x.conv_id AND o.i = x.done + 1)),
e AS (SELECT w.* FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id WHERE done = coalesce(rows, 0)),
{inserted_sql("e", "y", "conv_id")},
z AS (SELECT conv_id, {least_sql("s0", "s3")} AS s FROM y)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c AS cost, s.a AS audit, sha256(substr(s.r, 2)) AS repaired_sha256
FROM z LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id"""
