"""Online packing of tokenized documents by sums of squares.

A document's whole windows are sequences of their own; what is left of it is placed as it comes. counts[h] says how many open windows
hold h ids. Of all levels that have room, a new window included, the one is taken after which the sum of counts[h] ** 2 over partly
filled windows is least, the fullest of equal ones: levels that many windows stand at are left, levels that none stands at
are not entered lightly, and so windows of all levels stay few and close exactly. Where placing a document whole would raise
the sum by CUT more than cutting it between a window that it fills and a new one, it is cut.

Every task packs its own rows as they stream by, so nothing is shuffled and no task waits for another. It holds the open windows
alone, at most HELD ids. At its end (or if they were more than that) the open ones are closed without padding: those at a power
of two as they are, the others one after the other in full windows and, by binary digits, in at most ten short ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.shared import table
from skysift.llm.textcols import encoder

WINDOW, END_ID, CUT, HELD = 1024, 0, 16, 4 << 20
NEVER = 1 << 40

#: doc_id, ids before the piece, the piece's ids as bytes, ids of the document.
Piece = tuple[int | None, int, bytes, int]


class Levels:
    """The level array: how many open windows hold so many ids, and what the sum of squares gains when one leaves or enters a level."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.leave = np.full(window + 1, NEVER, np.int64)
        self.leave[0] = 0  # a new window
        self.enter = np.ones(window + 1, np.int64)
        self.enter[window] = 0  # a full one is open no more

    def whole(self, size: int) -> tuple[int, int]:
        """(gain, level) of the best level for size ids."""
        gain = self.leave[: self.window - size + 1] + self.enter[size:]
        h = len(gain) - 1 - int(gain[::-1].argmin())
        return int(gain[h]), h

    def cut(self, size: int) -> tuple[int, int]:
        """(gain, level) of the best level to be filled by the first of size ids, if a new window takes the rest."""
        if size < 2:
            return NEVER, 0
        gain = self.leave[self.window - size + 1 : self.window] + self.enter[1:size]
        k = int(gain.argmin())
        return int(gain[k]), self.window - size + 1 + k

    def move(self, level: int, to: int) -> None:
        for h, by in ((level, -1), (to, 1)):
            if 0 < h < self.window:
                self.counts[h] += by
                n = int(self.counts[h])
                self.leave[h], self.enter[h] = (1 - 2 * n if n else NEVER), 2 * n + 1


class Packer:
    """Places pieces as they come; windows that are closed are handed to `out`."""

    def __init__(self, window: int, out):
        self.window, self.out = window, out
        self._open()

    def _open(self) -> None:
        self.levels, self.at, self.held = Levels(self.window), [[] for _ in range(self.window)], 0

    def _put(self, piece: Piece, level: int) -> None:
        size = len(piece[2]) // 4
        held = self.at[level].pop() if level else []
        held.append(piece)
        self.held += size
        self.levels.move(level, level + size)
        if level + size == self.window:
            self.held -= self.window
            self.out(held)
        else:
            self.at[level + size].append(held)

    def add(self, piece: Piece) -> None:
        """Places a piece of at most a window."""
        doc, start, ids, total = piece
        size = len(ids) // 4
        gain, level = self.levels.whole(size)
        if gain > CUT:
            cut, at = self.levels.cut(size)
            if cut + CUT < gain:
                room = self.window - at
                self._put((doc, start, ids[: 4 * room], total), at)
                doc, start, ids, total = piece = doc, start + room, ids[4 * room :], total
                level = self.levels.whole(len(ids) // 4)[1]
        self._put(piece, level)
        if self.held > HELD:
            self.close()

    def close(self) -> None:
        """Closes all open windows without padding."""
        rest: list[Piece] = []
        for level in range(self.window - 1, 0, -1):
            for held in self.at[level]:
                if level & (level - 1):
                    rest += held
                else:
                    self.out(held)
        left = sum(len(p[2]) for p in rest) // 4
        sizes = [self.window] * (left // self.window) + [1 << k for k in range(self.window.bit_length() - 1, -1, -1) if left % self.window >> k & 1]
        rest.reverse()
        for size in sizes:
            held = []
            while size:
                doc, start, ids, total = rest.pop()
                take = min(size, len(ids) // 4)
                held.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    rest.append((doc, start + take, ids[4 * take :], total))
                size -= take
            self.out(held)
        self._open()


COLUMNS = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", ids: bool = False) -> DataFrame:
    """One row per piece of each row of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `ids` the piece's ids (array<int>).

    No sequence is longer than `window`, a power of two; each holds that many ids or a lesser power of two, so none is padded. A null or empty text is
    the end id alone. Rows that repeat a doc_id (or have none) are packed each for itself. An empty table gives no rows; other columns are
    ignored. sequence_id has the number of the task that packed it in its upper bits: a task that is run again packs its rows anew
    and replaces all it gave before."""
    if window < 2 or window & (window - 1):
        raise ValueError(f"a window of {window} ids: a power of two is needed")
    schema = pa.schema([*((n, pa.int64()) for n in COLUMNS), *([("ids", pa.list_(pa.int32()))] if ids else [])])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 40, 0
        rows: list[list] = [[] for _ in schema.names]

        def out(held: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, data, total in held:
                size = len(data) // 4
                cells = [doc, start, size, zlib.crc32(data), total, base + sequence, offset]
                for column, x in zip(rows, cells + [np.frombuffer(data, "<i4")] if ids else cells, strict=True):
                    column.append(x)
                offset += size
            sequence += 1

        def made() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
            for c in rows:
                c.clear()
            return b

        packer = Packer(window, out)
        for b in batches:
            names = b.column(0).to_pylist()
            for i, j, found, ends in enc(b.column(1)):
                full = np.insert(found, ends[1:], np.uint32(end_id)).astype("<u4")
                ends = ends + np.arange(j - i + 1)
                for k in range(j - i):
                    own = full[ends[k] : ends[k + 1]]
                    rest = len(own) // window * window
                    for s in range(0, rest, window):
                        out([(names[i + k], s, own[s : s + window].tobytes(), len(own))])
                    if rest < len(own):
                        packer.add((names[i + k], rest, own[rest:].tobytes(), len(own)))
                    if len(rows[0]) >= 4096:
                        yield made()
        packer.close()
        yield made()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(place, ", ".join(f"{n} {kind}" for n, kind in COLUMNS.items()) + (", ids array<int>" if ids else ""))


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
