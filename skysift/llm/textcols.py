"""Words of whole Arrow columns at once: character classes by table, words by dictionary, no Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as arrays at a time; a longer document is a slice of its own.
SLICE = 2 << 20
DROP, LETTER, DIGIT, OTHER = 0, 1, 2, 3


@functools.lru_cache(1)
def unicode_classes() -> np.ndarray:
    """Class of each code point: white space DROP, letters LETTER, numbers DIGIT, all else OTHER."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": DIGIT, "Z": DROP}
    table[: 0x34000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x34000)]
    table[[9, 10, 11, 12, 13, 0x85]] = DROP
    return table


@functools.lru_cache(1)
def letter_classes() -> np.ndarray:
    """Letters and their combining marks LETTER, all else DROP."""
    table = np.where(unicode_classes() == LETTER, LETTER, DROP).astype(np.uint8)
    table[[c for c in range(0x34000) if unicodedata.category(chr(c))[0] == "M"]] = LETTER
    return table


@functools.lru_cache(1)
def word_classes() -> np.ndarray:
    """0-9, a-z, A-Z and all beyond ASCII LETTER, other ASCII DROP."""
    table = np.full(0x110000, LETTER, np.uint8)
    table[[c for c in range(128) if not chr(c).isalnum()]] = DROP
    return table


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the offsets of the rows in them. Nulls are empty."""
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = arr.buffers()
    off = np.frombuffer(at, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def trim() -> None:
    """Gives freed memory back: a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(arr: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    _, off = raw(arr)
    i, n = 0, len(arr)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j
    trim()


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character begins in UTF-8 bytes, and its code point."""
    if data.max() < 128:
        return np.arange(len(data)), data.astype(np.int32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    wide = np.append(data, np.zeros(3, np.uint8))
    cp = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        k = np.flatnonzero((lead >= low) & ((lead < low + (0xFF - low + 1) // 2) if size < 4 else True))
        v = lead[k] & mask
        for i in range(1, size):
            v = v << 6 | (wide[at[k] + i] & 0x3F)
        cp[k] = v
    return at, np.minimum(cp, 0x10FFFF)


def runs(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends (in bytes) of the words in data, each row's first word, and the words' bytes. A character of class DIGIT is a word of its own."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64), data
    if data.max() < 128:
        at, cls = None, classes[data]
    else:
        at, cp = code_points(data)
        cls = classes[cp]
    first = np.zeros(len(cls), bool)
    rows = off[:-1][off[:-1] < len(data)]
    first[rows if at is None else np.searchsorted(at, rows)] = True
    starts = first | (cls == DIGIT)
    starts[1:] |= cls[1:] != cls[:-1]
    s = np.flatnonzero(starts)
    e = np.append(s[1:], len(cls))
    keep = cls[s] != DROP
    s, e = s[keep], e[keep]
    kept = cls != DROP
    if at is not None:
        at = np.append(at, len(data))
        s, e, kept = at[s], at[e], np.repeat(kept, np.diff(at))
    return s, e, np.searchsorted(s, off), data[kept]


def encoded(s: np.ndarray, e: np.ndarray, packed: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct words, and the index of each word among them. packed: the words' bytes, one after the other."""
    if not len(s):
        return [], np.zeros(0, np.int64)
    words, idx = dictionary(s, e, packed)
    return words.to_pylist(), idx


def dictionary(s: np.ndarray, e: np.ndarray, packed: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """As encoded(), with the words as a column."""
    off = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=off[1:])
    arr = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(off), pa.py_buffer(packed))
    d = pc.dictionary_encode(arr)
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


class Lexicon:
    """Numbers for words, made once for each distinct word and kept for the next batches. The store only saves time: it is emptied when full."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], limit: int = 100_000):
        self.make, self.limit, self.index, self.rows = make, limit, {}, None

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.limit:
            self.index, self.rows = {}, None
        get = self.index.get
        at = [get(w, -1) for w in words]
        new = [w for w, i in zip(words, at, strict=True) if i < 0]
        if new:
            n, made = len(self.index), self.make(new)
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            at = [self.index[w] for w in words]
        return self.rows[np.asarray(at, np.int64)] if at else self.make([])


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of the tokenizers library for whole columns.

    White space is dropped and no merge crosses a word, so the ids of a text are those of its words, and each distinct
    word is encoded by the library once. Texts in which that does not hold (special tokens, contractions, letters whose
    lower case is longer) go to the library whole.
    """

    WHOLE = r"<\||'(?:s|t|re|ve|m|ll|d)|İ"
    #: Words that are encoded as one text, and words that are remembered; both only save time.
    LINE, LIMIT = 500, 200_000

    def __init__(self, file: str = "word_bpe_49k.json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread of the library memory of its own
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path_of(file))
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.off = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and the end of each word's. Words go to the library in lines; a line with other ends than its words have is encoded word by word."""
        lines = [words[k : k + self.LINE] for k in range(0, len(words), self.LINE)]
        ids, ends, at = [], [], 0
        for line in lines:  # one at a time: what the library keeps of a text is many times its ids
            own = np.asarray(self.tok.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, np.uint32)
            end = np.flatnonzero(self.last[own]) + 1
            if len(end) != len(line) or end[-1] != len(own):
                each = [e.ids for e in self.tok.encode_batch_fast(line, add_special_tokens=False)]
                own, end = np.asarray([y for x in each for y in x], np.uint32), np.cumsum([len(x) for x in each])
            ids.append(own)
            ends.append(end + at)
            at += len(own)
        return np.concatenate(ids), np.concatenate(ends)

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.flat the ids of each of the distinct words begin, and how many they are."""
        if len(self.words) > self.LIMIT:
            self._forget()
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            ids, ends = self._encode(new.to_pylist())
            at[fresh] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, new])
            self.off = np.concatenate([self.off, self.off[-1] + ends])
            self.flat = np.concatenate([self.flat, ids])
        return self.off[at], self.off[at + 1] - self.off[at]

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For slices of rows: first row, end, all ids, and the offset of each row's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for i, j in slices(texts, SLICE // 2):
            part = texts.slice(i, j - i)
            low = pc.utf8_lower(pa.array([t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in part.to_pylist()], pa.large_string()))
            odd = np.flatnonzero((pc.match_substring_regex(low, self.WHOLE).to_numpy(zero_copy_only=False)) | (pc.match_substring(part, "İ").to_numpy(zero_copy_only=False)))
            if len(odd):
                mask = np.zeros(j - i, bool)
                mask[odd] = True
                low = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), low)
            data, off = raw(low)
            s, e, first, packed = runs(data, off, unicode_classes())
            if len(s):
                words, idx = dictionary(s, e, packed)
                start, size = self._word_ids(words)
                start, size = start[idx], size[idx]
                ids = self.flat[gather(start, size)]
                ends = np.concatenate([[0], np.cumsum(size)])[first]
            else:
                ids, ends = np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
            if len(odd):
                own = {int(k): np.asarray(self.tok.encode(part[int(k)].as_py(), add_special_tokens=False).ids, np.uint32) for k in odd}
                pieces = [own[k] if k in own else ids[ends[k] : ends[k + 1]] for k in range(j - i)]
                ids = np.concatenate(pieces)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            yield i, j, ids, ends


class ByteEncoder(Encoder):
    """Ids of the tokenizers library for whole columns, for byte-level files.

    The library parts a text into words before it merges: letters, numbers or signs, each with a space before it, or white space,
    or an English ending after an apostrophe. Words are found here for whole columns by the classes that the library itself gives
    their characters; each distinct word is encoded by the library once. Texts that hold one of its added tokens go to it whole.
    """

    UNKNOWN, ENDINGS = 255, ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, file: str = "byte_bpe_50k.json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path_of(file))
        vocab = self.tok.get_vocab()
        self.heads = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that begin with a space
        self.heads[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.classes = np.full(0x110000, self.UNKNOWN, np.uint8)
        self._forget()

    def _class(self, c: str) -> int:
        alone = lambda before: len(self.tok.pre_tokenizer.pre_tokenize_str(before + c)) == 1
        return LETTER if alone("a") else DIGIT if alone("1") else OTHER if alone("!") else DROP

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and the end of each word's. Words that begin with a space go to the library in lines, in which their first ids show."""
        spaced = np.fromiter((len(w) > 1 and w[0] == " " and not w[1].isspace() for w in words), bool, len(words))
        own: list = [None] * len(words)
        rest = np.flatnonzero(~spaced).tolist()
        lines = np.flatnonzero(spaced).tolist()
        for k in range(0, len(lines), self.LINE):
            at = lines[k : k + self.LINE]
            ids = np.asarray(self.tok.encode_batch_fast(["".join(words[i] for i in at)], add_special_tokens=False)[0].ids, np.uint32)
            begin = np.flatnonzero(self.heads[ids])
            if len(begin) != len(at) or begin[0]:
                rest += at
                continue
            for i, x in zip(at, np.split(ids, begin[1:]), strict=True):
                own[i] = x
        for k in range(0, len(rest), self.LINE):
            at = rest[k : k + self.LINE]
            for i, x in zip(at, self.tok.encode_batch_fast([words[i] for i in at], add_special_tokens=False), strict=True):
                own[i] = np.asarray(x.ids, np.uint32)
        return np.concatenate(own), np.cumsum([len(x) for x in own])

    def _words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin in data, and each row's first word."""
        at, cp = code_points(data)
        cls = self.classes[cp]
        if (cls == self.UNKNOWN).any():
            for c in np.unique(cp[cls == self.UNKNOWN]).tolist():
                self.classes[c] = self._class(chr(c))
            cls = self.classes[cp]
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, off[:-1][off[:-1] < len(data)])] = True
        first[n] = True
        run = first.copy()
        run[1:n] |= cls[1:] != cls[:-1]
        begins, ends = np.flatnonzero(run)[:-1], np.flatnonzero(run)[1:]
        starts = run.copy()
        # the last character of white space is a word of its own before other characters, or if it is a space part of theirs
        last = ends[(cls[begins] == DROP) & ~first[ends]] - 1
        starts[last] = True
        starts[last[cp[last] == 32] + 1] = False
        quote = begins[(ends - begins == 1) & (cp[begins] == 39)]
        quote = quote[starts[quote] & ~first[quote + 1]]
        quote = quote[cls[quote + 1] == LETTER]
        if len(quote):
            stop = ends[np.searchsorted(begins, quote + 1)]  # of the letters
            wide = np.append(cp, [0, 0])
            size = np.zeros(len(quote), np.int64)
            for e in self.ENDINGS:
                there = stop - quote > len(e)
                for k, c in enumerate(e):
                    there &= wide[quote + 1 + k] == ord(c)
                size[there & (size == 0)] = len(e)
            quote, size = quote[size > 0], size[size > 0]
            starts[quote + 1] = False
            starts[quote + 1 + size] = True
        s = np.flatnonzero(starts[:n])
        return at[s], np.searchsorted(at[s], off)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For slices of rows: first row, end, all ids, and the offset of each row's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for i, j in slices(texts, SLICE // 2):
            part = texts.slice(i, j - i)
            odd = np.zeros(j - i, bool)
            for token in self.added:
                odd |= pc.match_substring(part, token).to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), part) if odd.any() else part
            data, off = raw(plain)
            ids, ends = np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
            if len(data):
                s, first = self._words(data, off)
                words, idx = dictionary(s, np.append(s[1:], len(data)), data)
                start, size = self._word_ids(words)
                start, size = start[idx], size[idx]
                ids = self.flat[gather(start, size)]
                ends = np.concatenate([[0], np.cumsum(size)])[first]
            if odd.any():
                own = {int(k): np.asarray(self.tok.encode(part[int(k)].as_py(), add_special_tokens=False).ids, np.uint32) for k in np.flatnonzero(odd)}
                rows = [own[k] if k in own else ids[ends[k] : ends[k + 1]] for k in range(j - i)]
                ids = np.concatenate(rows)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            yield i, j, ids, ends


@functools.lru_cache(2)
def encoder(file: str = "word_bpe_49k.json") -> Encoder:
    """One for each Python worker; byte-level files are named so."""
    return ByteEncoder(file) if file.startswith("byte_") else Encoder(file)


if sys.byteorder != "little":  # ids are handed on as little-endian bytes
    raise ImportError("a little-endian machine is needed")
