"""Best-fit packing of tokenized documents by bin completion with branch and bound.

Documents become pieces of at most CAPACITY ids. Only the number of pieces of each length matters to a packing, so the
search runs on a histogram of at most CAPACITY counts however large the corpus is.

Incumbents are best-fit, all worked out on the histogram: each length in falling order in the fullest sequence that holds it; of a few
fillings around the largest length left the one that fits best, as often as the counts allow; and the same with the filling that wastes
least of all. Where the best one doesn't meet the lower bound, bin completion looks for less: every undominated filling around the largest
piece left is enumerated, least waste first and only up to the waste that a better packing can have, used as often as the
counts allow, then once less, and so on, and completed the same way. A filling is dominated if a piece of it could give way to a
larger one that is left, two of it to one, or another could be added. The search ends when the lower bound is met, when nothing is left to
try (then the packing is proven smallest), or after NODES nodes or SECONDS; then the gap to the bound is what least_sequences
shows, and the packing is the best one found, never worse than best fit. Pieces are dealt to the patterns' places by their rank among
those of their length, in parallel.
"""

from __future__ import annotations

import bisect
import time
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.llm.shared import row_tag, stored, table
from skysift.llm.textcols import encoder

CAPACITY, END_ID, NODES, SECONDS = 2048, 0, 4000, 6.0

Pattern = tuple[tuple[int, int], ...]  # (length, how many), largest first


def lower_bound(counts: np.ndarray) -> int:
    """No packing has fewer sequences: the items' total, and for each a the large items that no item of at least a can join."""
    cap = len(counts) - 1
    n, t = np.cumsum(counts), np.cumsum(counts * np.arange(cap + 1))
    best, half = -(-int(t[-1]) // cap), cap // 2
    for a in range(1, half + 1):
        alone, wide = int(n[cap] - n[cap - a]), int(n[cap - a] - n[half])
        room = wide * cap - int(t[cap - a] - t[half])
        small = int(t[half] - t[a - 1])
        best = max(best, alone + wide + max(0, -(-(small - room) // cap)))
    return best


def fillings(counts: np.ndarray) -> list[Pattern]:
    """At most three fillings around the largest length left, least waste first.

    After k more items, each the largest that fits, the rest is closed by the best one or two items. Of fillings with as
    much waste the one with larger items comes first, as it leaves the easier rest."""
    cap = len(counts) - 1
    left = counts.copy()
    used: dict[int, int] = {}

    def take(x: int) -> None:
        left[x] -= 1
        used[x] = used.get(x, 0) + 1

    def largest(limit: int) -> int:
        at = np.flatnonzero(left[1 : limit + 1])
        return int(at[-1]) + 1 if len(at) else 0

    first = largest(cap)
    take(first)
    room, found = cap - first, {}
    while True:
        there = np.flatnonzero(left[: room + 1])
        ends: list[tuple[int, ...]] = [()]
        if len(there):
            ends.append((int(there[-1]),))
            below = np.zeros(room + 1, np.int64)  # the largest length up to each place
            below[there] = there
            np.maximum.accumulate(below, out=below)
            other = below[room - there]
            twice = (other == there) & (left[there] < 2)
            other[twice] = np.where(there[twice] > 0, below[np.maximum(there[twice] - 1, 0)], 0)
            both = np.where(other > 0, there + other, 0)
            if both.max() > there[-1]:
                for k in np.flatnonzero(both == both.max())[-2:]:
                    ends.append((int(there[k]), int(other[k])))
        for end in ends:
            full = dict(used)
            for x in end:
                full[x] = full.get(x, 0) + 1
            p = tuple(sorted(full.items(), reverse=True))
            found[p] = cap - sum(x * c for x, c in p)
        nxt = largest(room)
        if not nxt:
            break
        many = max(1, min(int(left[nxt]), room // nxt - 2))  # long runs of one length at once
        for _ in range(many):
            take(nxt)
        room -= nxt * many
    order = sorted(found, key=lambda p: (found[p], [-x for x, _ in p]))
    least = found[order[0]]
    return [p for p in order if found[p] <= least + cap // 64][:3]


Packing = list[tuple[Pattern, int]]


def repeated(counts: np.ndarray) -> Packing:
    """An incumbent: the first of fillings() as often as the counts allow, again and again."""
    left, out = counts.astype(np.int64), []
    while left.any():
        p = fillings(left)[0]
        times = min(int(left[x]) // c for x, c in p)
        for x, c in p:
            left[x] -= c * times
        out.append((p, times))
    return out


def tightest(counts: np.ndarray, until: float) -> Packing | None:
    """An incumbent: the filling around the largest length that wastes least as often as the counts allow, again and again. None where that takes too long."""
    cap, out = len(counts) - 1, []
    left = {x: int(c) for x, c in enumerate(counts) if c}
    while left:
        if time.monotonic() > until:
            return None
        x = max(left)
        left[x] -= 1
        use = Counter([x, *next(undominated(left, cap - x, cap))])
        left[x] += 1
        times = min(left[y] // c for y, c in use.items())
        out.append((pattern(list(use.elements())), times))
        left = spent(left, use, times)
    return out


def spent(left: dict[int, int], use: Counter[int], times: int) -> dict[int, int]:
    after = left | {x: left[x] - c * times for x, c in use.items()}
    return {x: c for x, c in after.items() if c}


def best_fit(counts: np.ndarray) -> Packing:
    """An incumbent: the largest first, each in the fullest sequence that holds it. Sequences of one filling are one group, and pieces of one length are placed many at a time."""
    cap = len(counts) - 1
    groups: dict[int, list[tuple[Pattern, int]]] = {}  # by room left: fillings, and how many sequences of each
    rooms: list[int] = []  # the rooms there are, rising
    for x in (np.flatnonzero(counts)[::-1]).tolist():
        left = int(counts[x])
        while left:
            k = bisect.bisect_left(rooms, x)
            room = rooms[k] if k < len(rooms) else cap
            if k < len(rooms):
                held, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                held, n = (), left
            each = room // x  # a sequence stays the fullest one until x doesn't fit
            full = min(n, left // each)
            parts = [(full, each)] if full else []
            left -= full * each
            if full < n and left and (left < each):
                parts.append((1, left))
                left = 0
            used = sum(m for m, _ in parts)
            if k < len(rooms) or held:
                if used < n:
                    parts.append((n - used, 0))
            for m, c in parts:
                rest = room - c * x
                if rest not in groups:
                    bisect.insort(rooms, rest)
                groups.setdefault(rest, []).append((held + ((x, c),) if c else held, m))
    return [x for own in groups.values() for x in own]


def pattern(lengths: list[int]) -> Pattern:
    return tuple(sorted(Counter(lengths).items(), reverse=True))


def undominated(left: dict[int, int], room: int, most: int) -> Iterator[list[int]]:
    """Fillings of room that waste at most `most`, least waste first. left: how many pieces of each length there are."""
    there = sorted((x for x, c in left.items() if c and x <= room), reverse=True)
    # sums[i]: as bits, what pieces of there[i:] can add up to
    sums, full = [1] * (len(there) + 1), (1 << room + 1) - 1
    for i in range(len(there) - 1, -1, -1):
        sums[i], many, step = sums[i + 1], min(left[there[i]], room // there[i]), 1
        while many:
            take = min(step, many)
            sums[i] |= sums[i] << take * there[i] & full
            many, step = many - take, step * 2

    def exact(i: int, rest: int) -> Iterator[list[int]]:
        if not rest:
            yield []
            return
        while i < len(there) and (there[i] > rest or not sums[i] >> rest & 1):
            if not sums[i] >> rest & 1:
                return
            i += 1
        if i == len(there):
            return
        x = there[i]
        for n in range(min(left[x], rest // x), -1, -1):
            if sums[i + 1] >> rest - n * x & 1:
                for more in exact(i + 1, rest - n * x):
                    yield [x] * n + more

    for waste in range(min(most, room) + 1):
        if sums[0] >> room - waste & 1:
            for chosen in exact(0, room - waste):
                if not dominated(chosen, left, there, waste):
                    yield chosen


def dominated(chosen: list[int], left: dict[int, int], there: list[int], waste: int) -> bool:
    used = Counter(chosen)
    rest = [x for x in there if left[x] > used[x]]  # falling
    if rest and rest[-1] <= waste:
        return True
    if any(y < x <= y + waste for y in used for x in rest):
        return True
    kinds = sorted(used)
    pairs = {a + b for i, a in enumerate(kinds) for b in kinds[i:] if a != b or used[a] > 1}
    return any(y <= x <= y + waste for y in pairs for x in rest)


def complete(counts: np.ndarray, nodes: int = NODES, seconds: float = SECONDS) -> tuple[Packing, int]:
    """(pattern, times) that together hold counts[length] pieces of each length, and a proven lower bound for the number of sequences: it is
    reached where the search ended by itself."""
    cap, bound, until = len(counts) - 1, lower_bound(counts), time.monotonic() + seconds
    total = int((counts * np.arange(cap + 1)).sum())
    best = best_fit(counts)
    for other in (repeated, lambda c: tightest(c, until - seconds / 2)):
        if sequences(best) > bound and (found := other(counts)) is not None:
            best = min(best, found, key=sequences)
    fewest = sequences(best)
    if fewest <= bound:
        return best, bound
    tried = 0

    def children(left: dict[int, int], waste: int) -> Iterator[tuple[Counter[int], int]]:
        """Fillings and how often they are used: as often as the counts allow first, then less."""
        x = max(left)
        rest = left | {x: left[x] - 1}
        for chosen in undominated(rest, cap - x, (fewest - 1) * cap - total - waste):
            use = Counter([x, *chosen])
            for times in range(min(left[y] // c for y, c in use.items()), 0, -1):
                yield use, times

    start = {x: int(c) for x, c in enumerate(counts) if c}
    path: list[tuple[Counter[int], int]] = []
    stack = [(start, 0, 0, children(start, 0))]  # what is left, sequences, waste so far, fillings not yet tried
    ended = False
    while stack:
        left, n, waste, more = stack[-1]
        ended = tried >= nodes or time.monotonic() > until
        found = None if ended else next(more, None)
        if found is None or waste > (fewest - 1) * cap - total:
            stack.pop()
            if path:
                path.pop()
            continue
        tried += 1
        use, times = found
        after = spent(left, use, times)
        wasted = waste + (cap - sum(x * c for x, c in use.items())) * times
        if wasted > (fewest - 1) * cap - total or n + times + rest_bound(after, cap) >= fewest and (after or n + times >= fewest):
            continue
        path.append((use, times))
        if not after:
            fewest, best = n + times, [(pattern(list(c.elements())), t) for c, t in path]
            path.pop()
            if fewest <= bound:
                return best, bound
            continue
        stack.append((after, n + times, wasted, children(after, wasted)))
    return best, bound if ended else fewest


def sequences(packing: Packing) -> int:
    return sum(n for _, n in packing)


def rest_bound(left: dict[int, int], cap: int) -> int:
    counts = np.zeros(cap + 1, np.int64)
    counts[list(left)] = list(left.values())
    return lower_bound(counts) if left else 0


def places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank: from rank `rank` on, `each` a sequence from `seq` on, at `offset`."""
    rows, base, ranks = [], 0, {}
    for p, times in patterns:
        offset = 0
        for x, c in p:
            r = ranks.get(x, 0)
            rows.append((x << 40 | r, c, base, offset))
            ranks[x] = r + c * times
            offset += x * c
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("key", "each", "seq", "offset"), cols, strict=True))


def pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """(doc_id, __t, piece, start, length, ids_crc32) of each row's pieces."""
    schema = pa.schema([("doc_id", pa.int64()), ("__t", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            doc, tag = b.column(0), b.column(1)
            for i, j, ids, ends in enc(b.column(2)):
                size = np.diff(ends) + 1
                full = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4")
                at = np.concatenate([[0], np.cumsum(size)])
                n = -(-size // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                view, begin = memoryview(full).cast("B"), (at[row] + start) * 4
                crc = np.fromiter((zlib.crc32(view[s : s + 4 * k]) for s, k in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                at_row = pa.array(row + i)
                yield pa.record_batch([doc.take(at_row), tag.take(at_row), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(F.col("text")).alias("__t"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, __t long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """One row per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequences, least_sequences.

    sequences is how many there are in all, least_sequences a proven bound below which no packing can go; both are the same in every row.
    A null or empty text is the end id alone. Rows that repeat a doc_id are packed each for itself. An empty table gives
    no rows; other columns are ignored. Sequences are filled from offset 0 without gaps.
    """
    parts = stored(pieces(docs, capacity, end_id, tokenizer), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    packing, least = complete(counts)
    slots, total = places(packing), sequences(packing)
    salts = int(min(max(counts.sum() // 20_000, 16), 1 << 20))
    salted = parts.withColumn("__s", F.pmod(F.xxhash64("doc_id", "__t", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "__s").count().withColumn("__n", F.sum("count").over(Window.partitionBy("length").orderBy("__s")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "__s").orderBy("doc_id", "__t", "piece")) - 1
    ranked = salted.withColumn("__r", rank).join(before, ["length", "__s"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.shiftleft("length", 40) + F.col("__r") + F.col("__n")).alias("__k"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(5).to_numpy()
            at = np.searchsorted(slots["key"], key, "right") - 1
            k, each = key - slots["key"][at], slots["each"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(slots["seq"][at] + k // each), pa.array(slots["offset"][at] + k % each * (key >> 40))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumns({"sequences": F.lit(total).cast("long"), "least_sequences": F.lit(least).cast("long")})


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packing of all rows that are left, as pack() returns it; null texts are the end id alone, an empty table gives no rows."""
    return pack(docs)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
