"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are the runs of characters that WORD matches, after lower-casing A-Z. A window of LENGTH words holds
LENGTH - K + 1 k-grams; the smallest hash among them is its fingerprint. The fingerprint depends on the window's words
alone, so a window of an item that occurs in a document has the same fingerprint there: no shared span of LENGTH words
is missed. Hits on fingerprints are extended to whole windows and compared word by word, so none is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.shared import ascii_lower, by_row, row_tag, small, stored, table, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing
LENGTH, K = 10, 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def with_fingerprints(df: DataFrame, sizes: list[int], k: int, keep: list[str]) -> DataFrame:
    """df's columns `keep` and, for each n of sizes, __f<n>: the fingerprint of the window of n words that begins at each word of __words
    (empty if there are fewer words)."""
    hashed = df.select(*keep, F.transform("__words", lambda x: F.xxhash64(x)).alias("__h"))
    none = F.array().cast("array<bigint>")

    def grams(of: int) -> Column:
        at = F.sequence(F.lit(0), F.size("__h") - of)
        return F.when(F.size("__h") >= of, F.transform(at, lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(of)]))).otherwise(none)

    def least(n: int) -> Column:
        of = min(k, n)
        g, span = F.col(f"__g{of}"), n - of + 1
        if span == 1:
            return g
        return F.when(F.size(g) >= span, F.transform(F.sequence(F.lit(0), F.size(g) - span), lambda i: F.least(*[F.get(g, i + j) for j in range(span)]))).otherwise(none)

    held = hashed.select(*keep, *[grams(of).alias(f"__g{of}") for of in sorted({min(k, n) for n in sizes})])
    return held.select(*keep, *[least(n).alias(f"__f{n}") for n in sizes])


def windows(bench: DataFrame, length: int = LENGTH) -> DataFrame:
    """(item_id, n, gram) of each item's windows: n words joined by a space. n is length, or less for a short item, which is one window."""
    items = bench.select("item_id", words(F.col("text")).alias("w")).where((F.size("w") > 0) & F.col("item_id").isNotNull())
    n = F.least(F.size("w"), F.lit(length))
    return items.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.concat_ws(" ", F.slice("w", i + 1, F.least(F.size("w"), F.lit(length)))))).alias("gram")).distinct()


def occurrences(docs: DataFrame, wins: DataFrame, sizes: list[int], k: int) -> DataFrame:
    """(doc_id, __t, start, n, gram): where windows occur. docs has doc_id, __t, text; wins has gram and n, one of sizes. The texts are read
    once for all sizes, and those with a hit once more."""
    distinct = wins.select("n", "gram").distinct()
    own = with_fingerprints(distinct.select("n", F.split("gram", " ").alias("__words")), sizes, k, ["n"])
    prints = small(own.select("n", F.explode(F.coalesce(*[F.when(F.col("n") == n, F.col(f"__f{n}")) for n in sizes])).alias("f")).distinct())

    def keyed(n: int) -> Column:
        return F.transform(F.array_distinct(f"__f{n}"), lambda f: F.struct(F.lit(n).alias("n"), f.alias("f")))

    def spans(n: int) -> Column:
        return F.transform(f"__f{n}", lambda f, i: F.struct(f.alias("f"), F.lit(n).alias("n"), i.alias("start"), F.concat_ws(" ", F.slice("__words", i + 1, n)).alias("gram")))

    tokens = with_fingerprints(docs.select("doc_id", "__t", words(F.col("text")).alias("__words")), sizes, k, ["doc_id", "__t"])
    found = tokens.select("doc_id", "__t", F.explode(F.concat(*map(keyed, sizes))).alias("x")).select("doc_id", "__t", "x.n", "x.f").join(prints, ["n", "f"]).select("doc_id", "__t").distinct()
    suspects = by_row(docs, stored(found, "suspects"), "left_semi").select("doc_id", "__t", words(F.col("text")).alias("__words"))
    marked = with_fingerprints(suspects, sizes, k, ["doc_id", "__t", "__words"])
    rows = marked.select("doc_id", "__t", F.explode(F.concat(*map(spans, sizes))).alias("x")).select("doc_id", "__t", "x.*")
    return rows.join(prints, ["n", "f"]).join(small(distinct), ["n", "gram"]).select("doc_id", "__t", "start", "n", "gram").distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, length: int = LENGTH, k: int = K, tagged: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings).

    docs: doc_id, text; bench: item_id, text; other columns are ignored. Null or empty texts have no words and no hit.
    An item of fewer than length words is one window of its own length; an item without words or id has none.
    Rows that repeat a doc_id are judged each by its own text. Empty tables give no rows, or rows without hits. tagged adds __t, the row tag.
    """
    docs = docs.select("doc_id", "text", row_tag(F.col("text")).alias("__t"))
    wins = stored(windows(bench, length), "windows")
    sizes = sorted(r.n for r in wins.select("n").distinct().collect())  # at most `length` of them
    counted = docs.select("doc_id", "__t", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE)).cast("long").alias("n_words"))
    if not sizes:
        found = docs.select("doc_id", "__t", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    else:
        hits = stored(occurrences(docs, wins, sizes, k), "hits")
        covered = hits.groupBy("doc_id", "__t").agg(F.collect_set(F.struct("start", "n")).alias("s"))
        covered = covered.select("doc_id", "__t", F.size(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))).cast("long").alias("n_hit"))
        named = hits.select("doc_id", "__t", "gram").distinct().join(small(wins.select("gram", F.col("item_id").cast("string").alias("item"))), "gram")
        named = named.groupBy("doc_id", "__t").agg(F.array_sort(F.collect_set("item")).alias("items"))
        found = by_row(covered, named)
    joined = by_row(counted, found, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        items.alias("items"),
        *["__t"] * tagged,
    )


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that share no window with the benchmark, with all their columns. Rows with null or empty text stay, and rows
    that repeat or lack a doc_id are judged each by its own text. An empty table stays empty."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"), tagged=True).select("doc_id", "__t", (~F.col("contaminated")).alias("kept"))
    return without(docs, row_tag(F.col("text")), judged, once=False)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT dg.doc_id, dg.i, dg.n, win.item_id FROM dg JOIN win ON dg.gram = win.gram AND dg.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
