"""Removal of byte strings that repeat an earlier document, by range-partitioned suffixes.

A string of SPAN bytes is removed if it also starts in a document with a smaller doc_id. Not all suffixes are needed to
find them: in every SPAN bytes the LEAD-byte string with the least hash is an anchor, and equal strings have equal
anchors at equal places, so it is enough to compare the suffixes at anchors, and for each the few bytes before it.

1. Anchors are reduced to numbers and dealt to buckets by value, a task sending each number once; a bucket reports the
   numbers that several documents hold. The number only filters: two strings that share one cost work, not correctness.
2. Suffixes at reported anchors are dealt to ranges of their leading bytes, by splitters from a sample of documents. Tasks send
   them in blobs, sorted and compressed, since many are alike. A range that turns out heavy is parted by its suffixes' LEAD bytes.
3. Each range is sorted by multikey quicksort (eight bytes at a time, each time only within runs that are still equal), and
   neighbours with equal LEAD bytes are compared byte by byte, to both sides of the anchor: what they share covers whole
   strings of SPAN bytes, or nothing. Large groups are compared by sorting their strings instead of pair by pair.
4. LEAD bytes that very many suffixes begin with never meet in one task: each of their strings of SPAN bytes is reduced to a
   128-bit digest, the smallest document of each digest found by partial minima, and joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.near_duplicates import groups
from skysift.llm.shared import drop_stored, row_tag, stored, table
from skysift.llm.textcols import gather, mix, raw, slices, trim

SPAN, LEAD = 50, 24
REACH = SPAN - LEAD  # a string's anchor is at most so far from its begin
SLICE = 512 << 10  # bytes of text that are hashed at a time; some hundred bytes of arrays for each
MANY = 128
SAMPLE_DOCS = 2000
#: Suffixes of a range beyond which it is parted, and of one leading string beyond which they are compared by digest (or a ten-thousandth of all, if that is more).
HEAVY, HOT = 500_000, 250_000
#: Suffixes, and bytes of text, that a task holds before it sends them.
HOLD, TEXT = 100_000, 4 << 20
NUMBERS = 750_000  # anchors that a task reduces to distinct ones at a time
NOBODY = -(1 << 62)  # a null doc_id, smaller than all
_T = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = [np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in range(LEAD + 1)]


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, row and hash of the LEAD bytes of each anchor in the rows data[off[i]:off[i + 1]]."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h8 = _T[data]
        for step in (1, 2, 4):
            h8 = h8[:-step] * _M[step] + h8[step:]
        h = (h8[:-8] * _M[8] + h8[8:])[: n - LEAD + 1] * _M[8] + h8[16 : 16 + n - LEAD + 1]
        del h8
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    least, place, width = h, np.arange(len(h)), 1  # of the windows of `width` strings: the least hash, and the leftmost place that has it

    def wider(by: int) -> tuple[np.ndarray, np.ndarray]:
        right = least[by:] < least[:-by]
        return np.where(right, least[by:], least[:-by]), np.where(right, place[by:], place[:-by])

    while width * 2 <= REACH + 1:
        least, place = wider(width)
        width *= 2
    if rest := REACH + 1 - width:
        least, place = wider(rest)
    size = np.diff(off)
    whole = np.flatnonzero(size >= SPAN)
    chosen = np.zeros(len(h), bool)
    chosen[place[gather(off[:-1][whole], size[whole] - SPAN + 1)]] = True
    at = np.flatnonzero(chosen)
    return at, np.searchsorted(off, at, "right") - 1, h[at]


def numbers_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of anchors, the first `bits` bits of 32 + bits being their bucket. Anchors have the least hashes near them, so a hash as it is would put a third of all into the first of 64 buckets."""
    return (mix(h) >> np.uint64(32 - bits)).astype(np.int64)


def packed(doc: np.ndarray, num: np.ndarray) -> bytes:
    """Both arrays of longs in few bytes: differences, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(doc, prepend=0), num]).tobytes())


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (doc * np.int64(0x2545F4914F6CDD1D) >> np.int64(33)) % parts


def reports(doc: np.ndarray, num: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The numbers of each document, in blobs by document part."""
    part = doc_part(doc, parts)
    order = np.lexsort((num, doc, part))
    doc, num, part = doc[order], num[order], part[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([part[s]], pa.int64()), pa.array([packed(doc[s:e], num[s:e])], pa.binary())], names=["kind", "part", "blob"])


def anchor_numbers(docs: DataFrame, bits: int, parts: int) -> DataFrame:
    """(kind, part, blob): kind 0 numbers for the bucket `part`, one of each in a task; kind 1 numbers that documents of one task share."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            doc, num = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, num))
            doc, num = doc[order], num[order]
            del order
            first = np.concatenate([[0], np.flatnonzero(np.diff(num)) + 1])
            size = np.diff(np.append(first, len(num)))
            several = doc[first] != doc[first + size - 1]
            yield from reports(doc[np.repeat(several, size)], num[np.repeat(several, size)], parts)
            doc, num = doc[first], num[first]
            bucket = num >> 32
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                o = np.argsort(doc[s:e], kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([bucket[s]], pa.int64()), pa.array([packed(doc[s:e][o], num[s:e][o] & 0xFFFFFFFF)], pa.binary())], names=["kind", "part", "blob"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(b.column(1), SLICE):
                data, off = raw(b.column(1).slice(i, j - i))
                _, row, h = anchors(data, off)
                if len(row):
                    num = numbers_of(h, bits)
                    held.append((ids[i:j][row], num))
                if sum(len(x) for x, _ in held) > NUMBERS:
                    yield from flush()
        if held:
            yield from flush()
        trim()

    return docs.select("doc_id", "text").mapInArrow(numbers, "kind int, part long, blob binary")


def shared_numbers(buckets: DataFrame, parts: int) -> DataFrame:
    """Reports of the numbers that a bucket's entries from several tasks share. buckets: (part, blob)."""
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 1):
            bucket = b.column(0)[0].as_py()
            doc, num = (np.concatenate(x) for x in zip(*map(unpacked, b.column(1).to_pylist()), strict=True))
            order = np.lexsort((doc, num))
            doc, num = doc[order], num[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(num)) + 1])
            size = np.diff(np.append(first, len(num)))
            several = np.repeat(doc[first] != doc[first + size - 1], size)
            yield from reports(doc[several], num[several] | bucket << 32, parts)
        trim()

    return buckets.repartition("part").sortWithinPartitions("part").mapInArrow(shared, "kind int, part long, blob binary")


def lead_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first 8 bytes at each place, as a number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def splitters(docs: DataFrame, count: int, ranges: int) -> np.ndarray:
    """Bounds of `ranges` ranges of leading bytes, from the anchors of about SAMPLE_DOCS documents."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < min(1.0, SAMPLE_DOCS / max(count, 1)) * (1 << 30))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                data, off = raw(b.column(0).slice(i, j - i))
                at, _, _ = anchors(data, off)
                lead = np.unique(lead_of(data, at[:: max(1, len(at) // 20_000)]))
                yield pa.RecordBatch.from_arrays([pa.array([lead.tobytes()], pa.binary())], names=["lead"])

    got = [np.frombuffer(bytes(r.lead), np.uint64) for r in some.select("text").mapInArrow(leads, "lead binary").collect()]
    got = np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)
    return np.unique(got[np.arange(1, ranges) * len(got) // ranges]) if len(got) else got


def text_blobs(docs: DataFrame, parts: int) -> DataFrame:
    """(part, blob): docs (doc_id, __t, text) by the document part that reports() uses, many in a compressed blob."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for i, j in slices(b.column(2), SLICE):
                held.append(b.slice(i, j - i))
                if sum(x.nbytes for x in held) > TEXT:
                    yield from blobs(held)
                    held = []
        if held:
            yield from blobs(held)

    def blobs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        whole = pa.Table.from_batches(held)
        part = doc_part(whole.column(0).to_numpy(), parts)
        order = np.argsort(part, kind="stable")
        whole, part = whole.take(pa.array(order)), part[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_table(whole.slice(s, e - s).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([part[s]], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(sink.getvalue())], pa.binary())], names=["part", "blob"])

    return docs.select("doc_id", "__t", F.col("text").cast("binary").alias("text")).mapInArrow(pack, "part long, blob binary")


def texts_in(blob: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, __t, text as bytes) in slices."""
    import zstandard

    for b in pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)):
        for i, j in slices(b.column(2), SLICE):
            yield b.slice(i, j - i)


class Suffixes:
    """Columns around (SPAN bytes from the anchor on, then the REACH bytes before it), doc, tag, and place: the anchor's place << 16, how many of
    the latter << 8 and of the former are the document's."""

    def __init__(self, around: np.ndarray, doc: np.ndarray, tag: np.ndarray, place: np.ndarray):
        self.around, self.doc, self.tag, self.place = around, doc, tag, place

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(self.around[at], self.doc[at], self.tag[at], self.place[at])

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(x, c) for x in parts]) for c in ("around", "doc", "tag", "place")))

    def blob(self) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in (self.around, self.doc, self.tag, self.place)))

    @staticmethod
    def of(blob: bytes) -> Suffixes:
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(blob)
        n, wide = len(data) // (REACH + SPAN + 24), REACH + SPAN
        return Suffixes(np.frombuffer(data, np.uint8, n * wide).reshape(n, wide), *(np.frombuffer(data, np.int64, n, n * (wide + 8 * k)) for k in range(3)))

    def words(self) -> np.ndarray:
        """The LEAD bytes as numbers that sort as they do."""
        return np.ascontiguousarray(self.around[:, :LEAD]).view(">u8").astype(np.uint64)

    def ordered(self) -> tuple[Suffixes, np.ndarray]:
        """By LEAD bytes, then doc; and the number of each row's group of equal LEAD bytes. Multikey quicksort: runs that are equal so far are sorted by their next eight bytes."""
        words = self.words()
        order, group = np.arange(len(self)), np.zeros(len(self), np.int64)
        for key in [*words.T, self.doc]:
            size = np.bincount(group, minlength=1)
            open_ = np.flatnonzero(size[group] > 1)  # rows of runs with more than one; they stay in their run
            mine = order[open_]
            mine = mine[np.lexsort((key[mine], group[open_]))]
            order[open_] = mine
            if key is not self.doc:
                new = np.zeros(len(order), bool)
                new[1:] = group[1:] != group[:-1]
                new[1:] |= key[order[1:]] != key[order[:-1]]
                group = np.cumsum(new)
        return self.take(order), group

    def hashed_leads(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint64)
        with np.errstate(over="ignore"):
            for w in self.words().T:
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
        return out

    def is_in(self, leads: list[bytes]) -> np.ndarray:
        if not leads or not len(self):
            return np.zeros(len(self), bool)
        return np.isin(np.ascontiguousarray(self.around[:, :LEAD]).view(f"V{LEAD}").ravel(), np.array(leads, f"V{LEAD}"))


SUFFIX_SCHEMA = "range int, sub int, n long, blob binary"


def dealt(rows: Suffixes, key: np.ndarray, sub: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blobs of rows by (key, sub), sorted within."""
    order = np.lexsort((*rows.words().T[::-1], sub, key))
    rows, key, sub = rows.take(order), key[order], sub[order]
    cut = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(sub) != 0)) + 1, [len(key)]]) if len(key) else [0]
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([key[s]], pa.int32()), pa.array([sub[s]], pa.int32()), pa.array([e - s], pa.int64()), pa.array([rows.take(np.arange(s, e)).blob()], pa.binary())], names=["range", "sub", "n", "blob"])


def suffixes(texts: DataFrame, found: DataFrame, bits: int, bounds: np.ndarray) -> DataFrame:
    """(range, sub, n, blob) of the anchors whose numbers were reported for their document. texts: of text_blobs()."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reported: list[bytes] = []
        now, ready = None, None
        held: list[Suffixes] = []
        for b in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    now, reported, ready = part, [], None
                if kind == 0:
                    reported.append(blob)
                    continue
                if ready is None:
                    doc, num = (np.concatenate(x) for x in zip(*map(unpacked, reported), strict=True)) if reported else (np.zeros(0, np.int64),) * 2
                    order = np.lexsort((num, doc))
                    ready, reported = (doc[order], num[order]), []
                for some in texts_in(blob):
                    own, tags = some.column(0).to_numpy(), some.column(1).to_numpy()
                    data, off = raw(some.column(2))
                    at, row, h = anchors(data, off)
                    keep = member(own[row], numbers_of(h, bits), *ready)
                    at, row = at[keep], row[keep]
                    if not len(at):
                        continue
                    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(SPAN, np.uint8)])
                    begin, end = np.minimum(at - off[row], REACH), np.minimum(off[row + 1] - at, SPAN)
                    around = np.roll(padded[at[:, None] + np.arange(REACH + SPAN)], -REACH, 1)
                    held.append(Suffixes(around, own[row], tags[row], (at - off[row]) << 16 | begin << 8 | end))
                    if sum(map(len, held)) > HOLD:
                        yield from sent(held)
                        held = []
        if held:
            yield from sent(held)

    def sent(held: list[Suffixes]) -> Iterator[pa.RecordBatch]:
        rows = Suffixes.joined(held)
        yield from dealt(rows, np.searchsorted(bounds, rows.words()[:, 0], "right"), np.zeros(len(rows), np.int64))

    both = found.select("part", F.lit(0).alias("kind"), "blob").unionByName(texts.select("part", F.lit(1).alias("kind"), "blob"))
    return both.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(cut, SUFFIX_SCHEMA)


def member(doc: np.ndarray, num: np.ndarray, docs: np.ndarray, nums: np.ndarray) -> np.ndarray:
    """Which pairs (doc, num) are among the sorted pairs (docs, nums). Equal docs follow one another."""
    out = np.zeros(len(doc), bool)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else [0]
    own = doc[cut[:-1]] if len(doc) else doc
    lo, hi = np.searchsorted(docs, own, "left"), np.searchsorted(docs, own, "right")
    for s, e, a, b in zip(cut[:-1], cut[1:], lo, hi, strict=True):
        if b > a:
            at = np.searchsorted(nums[a:b], num[s:e])
            out[s:e] = nums[a:b][np.minimum(at, b - a - 1)] == num[s:e]
    return out


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many columns of each row agree from the first on, at most `most`."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def covered(group: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and the first and last distance before the anchor at which a string of SPAN bytes begins that a smaller doc has.
    Rows are sorted by group and doc; before: bytes leftwards from the anchor, after: from the anchor on."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    size = np.diff(np.append(start, len(group)))
    place = np.arange(len(group)) - np.repeat(start, size)
    live = np.flatnonzero((place > 0) & (np.repeat(size, size) <= MANY))
    lag = 1
    while len(live):
        r, q = live, live - lag
        smaller = doc[q] < doc[r]
        r, q = r[smaller], q[smaller]
        left = common(before[r], before[q], np.minimum(begin[r], begin[q]))
        right = common(after[r], after[q], np.minimum(end[r], end[q]))
        hit = SPAN - right <= left
        out.append((r[hit], np.maximum(SPAN - right[hit], 0), left[hit]))
        done = np.zeros(len(group), bool)
        done[r[(left == REACH) & (right == SPAN)]] = True
        lag += 1
        live = live[(place[live] >= lag) & ~done[live]]
    for s, n in zip(start[size > MANY], size[size > MANY], strict=True):
        k = np.arange(s, s + n)
        around = np.concatenate([before[k][:, ::-1], after[k]], 1)
        for a in range(REACH + 1):
            ok = k[(begin[k] >= a) & (end[k] >= SPAN - a)]
            strings = np.ascontiguousarray(around[ok - s, REACH - a : REACH - a + SPAN]).view(f"V{SPAN}").ravel()
            _, kind = np.unique(strings, return_inverse=True)
            least = np.full(kind.max() + 1 if len(kind) else 0, np.iinfo(np.int64).max)
            np.minimum.at(least, kind, doc[ok])
            late = ok[doc[ok] > least[kind]]
            out.append((late, np.full(len(late), a), np.full(len(late), a)))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


STRETCH = "doc_id long, __t long, s long, e long"


def stretches(rows: Suffixes, at: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows.doc[at]), pa.array(rows.tag[at]), pa.array(s), pa.array(e)], names=["doc_id", "__t", "s", "e"])


def hot_leads(suffix: DataFrame, heavy: DataFrame, hot: int) -> list[bytes]:
    """LEAD bytes that more than `hot` suffixes begin with; there are at most as many as all suffixes divided by `hot`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                lead, n = np.unique(np.ascontiguousarray(Suffixes.of(blob).around[:, :LEAD]).view(f"V{LEAD}").ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in lead], pa.binary()), pa.array(n)], names=["lead", "n"])

    rows = suffix.join(heavy, "range", "left_semi").select("blob").mapInArrow(count, "lead binary, n long")
    return sorted(bytes(r.lead) for r in rows.groupBy("lead").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("lead").collect())


def parted(suffix: DataFrame, leads: list[bytes], size: int) -> DataFrame:
    """Blobs of heavy ranges (range, n_all: suffixes of the range, blob) without the hot leads, parted by LEAD bytes to about `size` suffixes each."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, total, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = Suffixes.of(blob)
                rows = rows.take(np.flatnonzero(~rows.is_in(leads)))
                sub = (rows.hashed_leads() % np.uint64(-(-total // size))).astype(np.int64)
                yield from dealt(rows, np.full(len(rows), key), sub)

    return suffix.select("range", "n_all", "blob").mapInArrow(part, SUFFIX_SCHEMA)


def by_digest(suffix: DataFrame, leads: list[bytes]) -> DataFrame:
    """The stretches of suffixes that begin with one of leads, from blobs of their ranges: each string of SPAN bytes by its digest."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for blob in b.column(0).to_pylist():
                rows = Suffixes.of(blob)
                rows = rows.take(np.flatnonzero(rows.is_in(leads)))
                around = np.roll(rows.around, REACH, 1)  # as in the text
                for a in range(REACH + 1):
                    at = np.flatnonzero(((rows.place >> 8 & 0xFF) >= a) & ((rows.place & 0xFF) >= SPAN - a))
                    if not len(at):
                        continue
                    kinds, of = np.unique(np.ascontiguousarray(around[at, REACH - a : REACH - a + SPAN]).view(f"V{SPAN}").ravel(), return_inverse=True)
                    digest = pa.array([xxhash.xxh128_digest(x.tobytes()) for x in kinds], pa.binary()).take(pa.array(of))
                    begin = (rows.place[at] >> 16) - a
                    yield pa.RecordBatch.from_arrays([digest, *stretches(rows, at, begin, begin + SPAN).columns], names=["digest", "doc_id", "__t", "s", "e"])

    found = stored(suffix.select("blob").mapInArrow(strings, f"digest binary, {STRETCH}"), "strings")
    first = stored(found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "firsts")
    return found.join(first, "digest").where("doc_id > first").select("doc_id", "__t", "s", "e")


def repeats(suffix: DataFrame, heavy: int = HEAVY, hot: int = HOT) -> DataFrame:
    """(doc_id, __t, s, e): stretches of bytes to remove, each from one anchor. suffix: stored blobs of suffixes()."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for b in batches:
            for *key, blob in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if key != now and held:
                    yield compared(held)
                    held = []
                now = key
                held.append(blob)
        if held:
            yield compared(held)
        trim()

    def compared(held: list[bytes]) -> pa.RecordBatch:
        rows, group = Suffixes.joined([Suffixes.of(x) for x in held]).ordered()
        r, lo, hi = covered(group, rows.doc, rows.around[:, SPAN:][:, ::-1], rows.around[:, :SPAN], rows.place >> 8 & 0xFF, rows.place & 0xFF)
        at = rows.place[r] >> 16
        return stretches(rows, r, at - hi, at - lo + SPAN)

    sizes = suffix.groupBy("range").agg(F.sum("n").alias("n_all"))
    total = suffix.agg(F.sum("n").alias("n")).first().n or 0
    large = stored(sizes.where(F.col("n_all") > heavy), "heavy")
    out = None
    if not large.isEmpty():
        rest = suffix.join(large, "range", "left_anti")
        blobs = suffix.join(large, "range")
        leads = hot_leads(suffix, large.select("range"), max(hot, total // 10_000))
        suffix = rest.unionByName(parted(blobs, leads, heavy // 2 or 1))
        if leads:
            out = by_digest(blobs, leads)
    ready = suffix.repartition("range", "sub").sortWithinPartitions("range", "sub").mapInArrow(compare, STRETCH)
    return ready if out is None else ready.unionByName(out)


def removal(docs: DataFrame, heavy: int = HEAVY, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Texts are UTF-8 bytes, null is empty; texts shorter than SPAN lose nothing. Rows that repeat a doc_id don't repeat each
    other, as neither doc_id is smaller; a null doc_id is smaller than all. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc_id"), row_tag(F.col("text")).alias("__t"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    size = total.b or 0
    bits = min(max(int(size // (16 << 20)).bit_length(), 4), 31)  # about a million anchors a bucket
    parts = max(16, int(size // (16 << 20)))
    ranges = max(64, int(size // (2 << 20)))
    first = stored(anchor_numbers(rows, bits, parts), "anchors")
    found = stored(first.where("kind = 1").select("part", "blob").unionByName(shared_numbers(first.where("kind = 0").select("part", "blob"), parts).select("part", "blob")), "reports")
    drop_stored(first)
    texts = text_blobs(rows, parts)
    suffix = stored(suffixes(texts, found, bits, splitters(rows, total.n, ranges)), "suffixes")
    spans = stored(span_blobs(repeats(suffix, heavy, hot), parts), "spans")
    drop_stored(suffix)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for b in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    now, held, ready = part, [], None
                if kind == 0:
                    held.append(blob)
                    continue
                if ready is None:
                    ready, held = Spans(held), []
                for some in texts_in(blob):
                    yield ready.removed(some)

    both = spans.select("part", F.lit(0).alias("kind"), "blob").unionByName(texts.select("part", F.lit(1).alias("kind"), "blob"))
    out = both.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NOBODY, F.col("doc_id")))


def span_blobs(spans: DataFrame, parts: int) -> DataFrame:
    """(part, blob): spans by document part, each once in a task, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([c.to_numpy() for c in b.columns], 1))
            if sum(map(len, held)) > HOLD:
                yield from sent(np.concatenate(held))
                held = []
        if held:
            yield from sent(np.concatenate(held))

    def sent(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        import zstandard

        rows = rows[np.lexsort(rows.T[::-1])]
        rows = merged(rows)
        part = doc_part(rows[:, 0], parts)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([part[s]], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(rows[s:e].T.tobytes())], pa.binary())], names=["part", "blob"])

    return spans.mapInArrow(pack, "part long, blob binary")


def merged(rows: np.ndarray) -> np.ndarray:
    """Rows (doc, tag, s, e) sorted by all, with stretches of one document that touch or overlap as one."""
    if not len(rows):
        return rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    first = np.flatnonzero(new)
    # running largest end within a document: ends are raised by the document's number so that one scan serves all
    step = int(rows[:, 3].max()) + 1
    lift = (np.cumsum(new) - 1) * step
    upto = np.maximum.accumulate(rows[:, 3] + lift) - lift
    new[1:] |= rows[1:, 2] > upto[:-1]
    new[first] = True
    begin = np.flatnonzero(new)
    out = rows[begin].copy()
    out[:, 3] = np.maximum.reduceat(rows[:, 3], begin)
    return out


class Spans:
    """The stretches of a part's documents."""

    def __init__(self, blobs: list[bytes]):
        import zstandard

        parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64).reshape(4, -1).T for x in blobs]
        rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
        rows = merged(rows[np.lexsort(rows.T[::-1])])
        cut = np.concatenate([[0], np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, np.int64)
        self.rows, self.at = rows, {(int(rows[s, 0]), int(rows[s, 1])): (s, e) for s, e in zip(cut[:-1], cut[1:], strict=True)}

    def removed(self, texts: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for doc, tag, text in zip(*(c.to_pylist() for c in texts.columns), strict=True):
            s, e = self.at.get((doc, tag), (0, 0))
            kept, upto, gone = [], 0, 0
            for begin, end in self.rows[s:e, 2:].tolist():
                kept.append(text[upto:begin])
                upto, gone = end, gone + end - begin
            kept = b"".join([*kept, text[upto:]])
            for x, v in zip(out, (len(text), gone, e - s, kept), strict=True):
                x.append(v)
        digests = [hashlib.sha256(x).hexdigest() for x in out[3]]
        return pa.RecordBatch.from_arrays([texts.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(digests), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents")).drop("kept")
