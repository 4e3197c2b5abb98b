"""N-gram Jaccard join with Bayesian pruning of candidates.

A text is its set of SHINGLE-word shingles; texts with one set are one node. MinHash values in BANDS bands of ROWS bring
nodes together that agree in a band. A pair's values are compared a few at a time: given m matches among n, similarity has
a Beta(m + 1, n - m + 1) posterior (uniform prior), and the pair is dropped when the probability of reaching the
threshold falls below TOLERANCE. What is left is verified on the sets themselves; only verified pairs are links.

Pairs within a bucket are never listed. First each node is compared with the bucket's leader, in two rounds with other
leaders; links join nodes to components. After that only buckets whose nodes lie in several components are looked at, and of
them only pairs of different components, in blocks of bounded size: the nodes outside a bucket's largest component meet all
others, those within it don't meet each other. A first pass over the signatures finds the nodes with a plausible partner,
a second verifies these on their sets and keeps as many links as connect the block's components. So a group of copies
gives links in proportion to its size, and every linked pair that shares a bucket lies within one component, a class.

So all linked pairs lie within components. How many links a node has is counted there: the nodes of a component meet two by
two in blocks of bounded size, which give a number for each node and no row for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.shared import by_row, row_tag, stored, table, without
from skysift.llm.textcols import Lexicon, encoded, gather, hashes, mix, raw, runs, slices, word_classes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares no band with probability 3e-6
TOLERANCE, STEP = 1e-6, 16
BLOCK = 256
NODE = "binary"
#: Stored tables of nodes, labels and buckets of at most so many rows (some ten MB) are sent to all executors instead of being shuffled: a shuffle of a small
#: table costs a task for each partition, and there are some hundred of them between steps.
FEW = 100_000


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewer matches among n values make similarity >= threshold less probable than tolerance."""
    total = 0.0
    for m in range(n + 1):  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def plausible(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of signatures (rows of longs, four values in each) survive the incremental comparison."""
    a, b = a.view(np.uint16).reshape(len(a), -1), b.view(np.uint16).reshape(len(b), -1)
    live, seen = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], STEP):
        seen[live] += (a[live, at : at + STEP] == b[live, at : at + STEP]).sum(1)
        live = live[seen[live] >= least_matches(min(at + STEP, a.shape[1]), threshold)]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def shingles(texts: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, end, hashes of all shingles, the offset of each row's. A text of fewer words than SHINGLE, but not none, is one."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for i, j in slices(texts):
        data, off = raw(pc.utf8_lower(texts.slice(i, j - i)))
        s, e, first, packed = runs(data, off, word_classes())
        words, idx = encoded(s, e, packed)
        h = lexicon(words)[idx] if words else np.zeros(0, np.uint64)
        n = np.diff(first)
        size = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        start = np.repeat(first[:-1] - ends[:-1], size) + np.arange(ends[-1])
        last = np.repeat(first[1:], size)
        out = np.zeros(len(start), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                at = start + k
                out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(at < last, h[np.minimum(at, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else out
            out = mix(out)
        yield i, j, out, ends


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, __t, node, sig) of each row. node names the set of shingles; without words a row is a node of its own, with an empty sig."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lexicon, (mul, add) = Lexicon(hashes), coefficients()
        for b in batches:
            for i, j, h, ends in shingles(b.column(2), lexicon):
                doc, tag = b.column(0).slice(i, j - i), b.column(1).slice(i, j - i)
                has = np.flatnonzero(np.diff(ends))
                sig = np.zeros((j - i, BANDS * ROWS), np.uint16)
                if len(has):
                    with np.errstate(over="ignore"):
                        for k in range(BANDS * ROWS):
                            sig[has, k] = np.minimum.reduceat(h * mul[k] ^ add[k], ends[:-1][has]) >> np.uint64(24) & np.uint64(0xFFFF)
                node = [xxhash.xxh128_digest(np.unique(h[s:e]).tobytes() if e > s else repr((d, t)).encode()) for s, e, d, t in zip(ends[:-1].tolist(), ends[1:].tolist(), doc.to_pylist(), tag.to_pylist(), strict=True)]
                size = np.where(np.diff(ends) > 0, BANDS, 0)
                longs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(sig[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([doc, tag, pa.array(node, pa.binary()), longs], names=["doc_id", "__t", "node", "sig"])

    return docs.select("doc_id", "__t", "text").mapInArrow(sketch, f"doc_id long, __t long, node {NODE}, sig array<long>")


def few(df: DataFrame) -> DataFrame:
    """df, a stored table of narrow rows, marked for broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, sig, grams) of docs (node, sig, text): the sorted distinct shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(hashes)
        for b in batches:
            for i, j, h, ends in shingles(b.column(2), lexicon):
                own = [np.unique(h[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                off = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["node", "sig", "grams"])

    return docs.select("node", "sig", "text").mapInArrow(sets, f"node {NODE}, sig array<long>, grams array<long>")


def rows_of(col: pa.Array) -> list[np.ndarray]:
    off, flat = col.offsets.to_numpy(), col.values.to_numpy()
    return [flat[s:e] for s, e in zip(off[:-1], off[1:], strict=True)]


def pruned(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The plausible ones of pairs (a, b)."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sa, sb = (np.stack(rows_of(b.column(k))) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(plausible(sa, sb, threshold)))

    sig = nodes.select("node", "sig")
    both = sig.withColumnsRenamed({"node": "b", "sig": "sb"}).join(few(stored(pairs, "pairs")), "b").join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(prune, f"a {NODE}, b {NODE}")


def linked(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, of those that are plausible. Many pairs may share their a."""
    left = stored(pruned(pairs, nodes, threshold), "plausible")
    grams = nodes.select("node", "grams")
    both = grams.withColumnsRenamed({"node": "b", "grams": "gb"}).join(few(left), "b").join(grams.withColumnsRenamed({"node": "a", "grams": "ga"}), "a")
    shared = F.size(F.array_intersect("ga", "gb"))  # shared >= t * (a + b - shared), with room for rounding
    return both.where(shared * (1 + threshold) + 1e-9 >= (F.size("ga") + F.size("gb")) * threshold).select("a", "b")


class Forest:
    """Which of the pairs offered so far were needed to connect what they connect."""

    def __init__(self, n: int):
        self.up, self.parts = list(range(n)), n

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def needs(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[y] = x
        self.parts -= 1
        return True


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b), a stored table: label is the lowest node that it is connected with. Lowest labels spread along links and jump to
    their own labels until both ends of every link have one."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    state = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        now = few(state)
        ends = links.join(now.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(now.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
        if ends.where("la != lb").isEmpty():
            return state
        heard = both.join(now.withColumnsRenamed({"node": "b", "label": "m"}), "b").groupBy("a").agg(F.min("m").alias("m")).withColumnRenamed("a", "node")
        low = heard.join(now, "node").select("node", F.least("label", "m").alias("mid"))
        jump = now.withColumnsRenamed({"node": "mid", "label": "far"})
        state = stored(low.join(jump, "mid").select("node", F.least("mid", "far").alias("label")), "labels")


def rejoined(links: DataFrame, labels: DataFrame) -> DataFrame:
    """components() of links (a, b), a stored table, and of those that made labels (node, label): components that more links join are nodes of a smaller graph."""
    now, pairs = few(labels), links
    for x in "ab":
        pairs = pairs.join(now.withColumnsRenamed({"node": x, "label": f"l{x}"}), x, "left").withColumn(f"l{x}", F.coalesce(f"l{x}", x))
    moved = few(components(stored(pairs.where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")), "links")))
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stored(old.unionByName(moved.join(now.select("node"), "node", "left_anti")), "labels")


def mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, key, node, label, top, n_top, n_rest) of the buckets with nodes of several components: the node's component, the bucket's
    largest one, its nodes and the others' in the bucket. A node without links is a component of its own."""
    rows = shared.select("band", "key", "node")
    return within_several(stored(rows.join(few(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "marked"))


def within_several(marked: DataFrame) -> DataFrame:
    """As mixed(), of rows (band, key, node, label)."""
    sizes = marked.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "label")).alias("t"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    tops = stored(tops.select("band", "key", F.col("t.label").alias("top"), F.col("t.n").alias("n_top"), (F.col("all") - F.col("t.n")).alias("n_rest")), "tops")
    return stored(marked.join(few(tops), ["band", "key"]), "mixed")


def blocks(rows: DataFrame, carried: list[str], size: int) -> DataFrame:
    """rows of mixed() with the columns carried, dealt to blocks: chunks of about `size` rows of a bucket meet two by two in a block, except two of its
    largest component's. Columns band, key, __i, __j (the block), __c (the row's chunk), node, label, carried, partitioned and sorted by block."""
    top = F.col("label") == F.col("top")
    k_top, k_rest = (F.ceil(F.col(c) / size).cast("int") for c in ("n_top", "n_rest"))
    at = F.xxhash64("node", F.lit(1))
    own = rows.withColumn("__c", F.when(top, F.pmod(at, k_top)).otherwise(k_top + F.pmod(at, k_rest)).cast("int"))
    dealt = own.withColumn("__o", F.explode(F.sequence(F.when(top, k_top).otherwise(F.lit(0)), k_top + k_rest - 1)))
    dealt = dealt.select("band", "key", F.least("__c", "__o").alias("__i"), F.greatest("__c", "__o").alias("__j"), "__c", "node", "label", *carried)
    return dealt.repartition("band", "key", "__i", "__j").sortWithinPartitions("band", "key", "__i", "__j", "__c", "node")


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the first `width` columns change; a group that spans batches comes whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(c.to_pylist() for c in b.columns[:width]), strict=True))
        cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if held and keys[s] != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(s, e - s))
            last = keys[s]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tested(sig: np.ndarray, x: np.ndarray, y: np.ndarray, ok: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The plausible pairs of rows of x with rows of y, of those that are ok."""
    for part in np.array_split(x, max(1, len(x) * len(y) >> 14)):
        p, q = np.repeat(part, len(y)), np.tile(y, len(part))
        keep = ok(p, q)
        p, q = p[keep], q[keep]
        if len(p):
            keep = plausible(sig[p], sig[q], threshold)
            yield p[keep], q[keep]


class Sets:
    """The sets of a block's rows, numbered within the block."""

    def __init__(self, grams: pa.Array):
        own = rows_of(grams)
        self.size = np.fromiter(map(len, own), np.int64, len(own))
        _, self.ids = np.unique(np.concatenate(own), return_inverse=True)
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.there = np.zeros(int(self.ids.max()) + 1, np.int64)

    def similar(self, p: np.ndarray, q: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each row of p with those of its partners in q whose sets are similar enough."""
        for k in np.unique(p).tolist():
            z = q[p == k]
            own = self.ids[self.off[k] : self.off[k + 1]]
            self.there[own] = 1
            n = self.size[z]
            both = np.add.reduceat(self.there[self.ids[gather(self.off[z], n)]], np.cumsum(n) - n)
            self.there[own] = 0
            yield k, z[both * (1 + threshold) + 1e-9 >= threshold * (self.size[k] + n)]


def candidates(b: pa.RecordBatch, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one block's plausible pairs of different components that share no earlier band."""
    band, i, j = (b.column(k)[0].as_py() for k in (0, 2, 3))
    sig = np.stack(rows_of(b.column(7)))
    label = pc.dictionary_encode(b.column(6)).indices.to_numpy()
    chunk = b.column(4).to_numpy()
    x = np.flatnonzero(chunk == i)
    y = x if i == j else np.flatnonzero(chunk == j)

    def ok(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((label[p] != label[q]) & (p < q if i == j else True))
        out = np.zeros(len(p), bool)
        out[at] = ~(sig[p[at], :band] == sig[q[at], :band]).any(1)
        return out

    yield from tested(sig, x, y, ok, threshold)


def partnered(rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(band, key, node, label) of the nodes in rows of mixed() with a plausible partner in the bucket, in another component."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 4):
            has = np.zeros(b.num_rows, bool)
            for p, q in candidates(b, threshold):
                has[p] = has[q] = True
            if has.any():
                yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 5, 6)], names=["band", "key", "node", "label"]).filter(pa.array(has))

    dealt = blocks(nodes.select("node", "sig").join(few(rows), "node"), ["sig"], BLOCK)
    return dealt.mapInArrow(test, f"band int, key long, node {NODE}, label {NODE}").distinct()


def crossing(rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components in a bucket, rows being of mixed(); of a block as many as connect the components that are linked there."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 4):
            sets = Sets(b.column(8))
            label = pc.dictionary_encode(b.column(6)).indices.to_numpy()
            forest, out = Forest(int(label.max()) + 1), []
            for p, q in candidates(b, threshold):
                for k, z in sets.similar(p, q, threshold):
                    out += [(k, w) for w in z.tolist() if forest.needs(int(label[k]), int(label[w]))]
            if out:
                yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array([x[k] for x in out])) for k in (0, 1)], names=["a", "b"])

    dealt = blocks(nodes.join(few(rows), "node"), ["sig", "grams"], BLOCK)
    return dealt.mapInArrow(test, f"a {NODE}, b {NODE}").distinct()


def degrees(labels: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links) of the nodes of components (node, label): with how many others a node is linked. Chunks of about BLOCK nodes of a component meet two by two in a block."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 3):
            i, j = (b.column(k)[0].as_py() for k in (1, 2))
            sig, chunk, sets = np.stack(rows_of(b.column(5))), b.column(3).to_numpy(), Sets(b.column(6))
            x = np.flatnonzero(chunk == i)
            y = x if i == j else np.flatnonzero(chunk == j)
            n = np.zeros(b.num_rows, np.int64)
            for p, q in tested(sig, x, y, np.less if i == j else np.not_equal, threshold):
                for k, z in sets.similar(p, q, threshold):
                    n[k] += len(z)
                    n[z] += 1
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array(n)], names=["node", "n"])

    chunks = stored(labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__k")), "chunks")
    own = nodes.join(few(labels), "node").join(few(chunks), "label").withColumn("__c", F.pmod(F.xxhash64("node", F.lit(1)), "__k").cast("int"))
    rows = own.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    rows = rows.select("label", F.least("__c", "__o").alias("__i"), F.greatest("__c", "__o").alias("__j"), "__c", "node", "sig", "grams")
    dealt = rows.repartition("label", "__i", "__j").sortWithinPartitions("label", "__i", "__j", "__c", "node")
    return dealt.mapInArrow(test, f"node {NODE}, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def links_of(shared: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), enough to connect all nodes that links connect, and the components (node, label) of the nodes that have one. shared: band, key, node and the
    bucket's lowest node, lead; nodes: node, sig, grams."""
    pairs = shared.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(linked(pairs, nodes, threshold), "links")
    labels = components(links)
    rows = mixed(shared, labels)
    # another leader, chosen by a hash: the first one may be linked with nobody
    leader = stored(rows.groupBy("band", "key").agg(F.max_by(F.struct("node", "label"), F.xxhash64("node", F.lit(2))).alias("l")), "leaders")
    pairs = rows.join(few(leader), ["band", "key"]).where("label != l.label").select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()
    more = stored(linked(pairs, nodes, threshold), "links")
    if not more.isEmpty():
        links = links.union(more)
        labels = rejoined(more, labels)
        rows = mixed(shared, labels)
    some = stored(partnered(rows, nodes, threshold), "partnered")
    if not some.isEmpty():
        more = stored(crossing(within_several(some), nodes, threshold), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = rejoined(more, labels)
    return links, labels


def join(docs: DataFrame, threshold: float = THRESHOLD, count: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, __t, class_id, rep_id, n_links, links, kept.

    Texts with one set of shingles (copies, or other case and signs) have one representative, the row of the largest doc_id among
    them (rep_id). Linked are pairs of representatives with a Jaccard similarity of at least threshold; a class holds what links
    connect, and class_id is its largest doc_id. n_links is the number of all representatives that the row's representative is linked
    with (null if they aren't to be counted). Links are listed as far as they connect classes, in proportion to the class's size: links
    has the rep_ids that the row's representative was linked with, each pair once, in the row of the end with fewer of them, and
    only in the representative's own row. Texts without
    words, and null, are linked with nothing. Rows that repeat a doc_id are told apart by their text (__t, a hash of it): of a class the
    row with the largest (doc_id, __t) is kept, null being smallest; rows that repeat both are kept together. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(F.col("text")).alias("__t"), "text")
    sketch = stored(sketches(rows), "sketches")
    nodes = stored(sketch.where(F.size("sig") > 0).groupBy("node").agg(F.min(F.struct("doc_id", "__t")).alias("first"), F.any_value("sig").alias("sig")), "nodes")
    banded = nodes.select("node", F.posexplode("sig").alias("band", "key"))
    full = stored(banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1").select("band", "key", "lead"), "full")
    shared = stored(banded.join(few(full), ["band", "key"]), "buckets")
    several = stored(shared.select("node").distinct(), "several")
    firsts = stored(nodes.join(few(several), "node", "left_semi").select("node", "first.doc_id", "first.__t"), "firsts")
    texts = by_row(rows, few(firsts)).select("node", "text").dropDuplicates(["node"])
    some = stored(sets_of(texts.join(nodes.select("node", "sig"), "node")), "sets")
    links, labels = links_of(shared, some, threshold)

    members = sketch.select("doc_id", "__t", "node").join(few(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = stored(members, "members")
    row = F.struct("doc_id", "__t")
    tops = stored(members.groupBy("label").agg(F.max(row).alias("top"), F.count("*").alias("n")).where("n > 1").select("label", "top"), "tops")
    reps = stored(members.groupBy("node").agg(F.max(row).alias("rep")), "representatives")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    ends = few(stored(ends.join(reps, "node").select("node", "n", F.col("rep.doc_id").alias("rep_id")), "ends"))
    both = links.distinct()
    for x in "ab":
        both = both.join(ends.select(F.col("node").alias(x), F.struct("n", F.col("node").alias(x)).alias(f"n{x}"), F.col("rep_id").alias(f"r{x}")), x)
    low = F.col("na") < F.col("nb")
    listed = both.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(low, F.col("rb")).otherwise(F.col("ra")).alias("other"))
    listed = stored(listed.groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("links")), "listed")
    about = reps.join(few(listed), "node", "left")
    about = stored(about.join(few(stored(degrees(labels, some, threshold), "degrees")), "node", "left") if count else about.withColumn("n_links", F.lit(None).cast("long")), "about")
    named = members.join(about, "node").join(few(tops), "label", "left")
    top, none = F.coalesce("top", row), F.array().cast("array<bigint>")
    own = row.eqNullSafe(F.col("rep"))
    return named.select(
        "doc_id",
        "__t",
        top["doc_id"].alias("class_id"),
        F.col("rep.doc_id").alias("rep_id"),
        (F.coalesce("n_links", F.lit(0).cast("long")) if count else F.col("n_links")).alias("n_links"),
        F.when(own, F.coalesce("links", none)).otherwise(none).alias("links"),
        row.eqNullSafe(top).alias("kept"),
    )


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each class of near duplicates, with all its columns; of rows that repeat doc_id and text one stays.

    Rows without words stay, those that repeat doc_id and text again once. An empty table stays empty."""
    judged = stored(join(docs, count=False).select("doc_id", "__t", "kept"), "judged")
    return without(docs, row_tag(F.col("text")), judged)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("__t")
