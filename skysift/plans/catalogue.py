"""Queries on the driver's tables, each beside the SQL that it must agree with.

Bindings: embeddings are the vectors; those whose id is divisible by 50 are phrases (five to a question), and all of them are
the patches or labelled images searched, so a phrase finds its own row first. part rows are images, lineitem rows boxes, documents answers, events runs of a sweep.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.functions import geometry as G
from skysift.functions import text as X
from skysift.functions import vectors as V
from skysift.operators import evaluation as E
from skysift.operators import models as M
from skysift.operators import modes as O
from skysift.operators import patches as P
from skysift.operators import retrieval as R
from skysift.operators import waterfall as W
from skysift.session import scratch_dir, stored
from skysift.sources import results as RF
from skysift.sources import tables as S
from skysift.sources import vector_index as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- vectors

LRSD_T, CRSD_T, PATH_T = 1.2, 1.3, 0.7


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def phrases(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("vec_id % 50 = 0").select(F.expr("vec_id div 250").alias("question_id"), F.expr("(vec_id div 50) % 5").alias("pos"), "vec_id", "vec")


def patches(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("patch_idx"), "label", "vec")


VEC = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT vec_id // 250 AS question_id, (vec_id // 50) % 5 AS pos, v FROM e WHERE vec_id % 50 = 0),
p AS (SELECT vec_id AS patch_idx, label, v FROM e)"""


def softmax_sql(texts: str, unit: bool = True, name: str = "s", patches: str = "p", own: bool = False) -> str:
    by = "sqrt(list_inner_product(a.v, a.v)) * " if unit else ""
    on = "JOIN {} p ON p.question_id = a.question_id".format(patches) if own else f"CROSS JOIN {patches} p"
    return f"""
{name}l AS (SELECT a.question_id, pos, patch_idx, 100 * list_inner_product(a.v, p.v) / ({by}sqrt(list_inner_product(p.v, p.v))) AS x FROM {texts} a {on}),
{name}m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY question_id, pos)) AS z FROM {name}l),
{name} AS (SELECT question_id, pos, patch_idx, z / sum(z) OVER (PARTITION BY question_id, pos) AS prob FROM {name}m)"""


def vote_sql(sims: str = "s", name: str = "c", k: int = 2) -> str:
    return f"""
{name}r AS (SELECT *, row_number() OVER (PARTITION BY question_id, pos ORDER BY prob DESC, patch_idx) AS rank FROM {sims}),
{name}e AS (SELECT *, pos * {k} + rank - 1 AS slot FROM {name}r WHERE rank <= {k}),
{name}g AS (SELECT question_id, patch_idx, count(*) AS votes, min(slot) AS first, max(prob) AS confidence FROM {name}e GROUP BY ALL),
{name}k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first) AS n FROM {name}g),
{name}u AS (
  SELECT question_id, patch_idx, confidence, votes, false AS is_extra, n - 1 AS place FROM {name}k WHERE n <= {k}
  UNION ALL
  SELECT x.question_id, x.patch_idx, x.prob, 1, true, x.pos + {k} FROM {name}e x WHERE rank = 1 AND NOT EXISTS (SELECT 1 FROM {name}k y WHERE n <= {k} AND y.question_id = x.question_id AND y.patch_idx = x.patch_idx)),
{name} AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY place) - 1 AS cue_pos, patch_idx, confidence, votes, is_extra FROM {name}u)"""


SIX = "round(confidence, 6) AS confidence"


@query(f"WITH {VEC}, {softmax_sql('t')} SELECT question_id, pos, patch_idx, round(prob, 6) AS prob, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id, pos ORDER BY prob DESC, patch_idx) AS rank FROM s) WHERE rank <= 2")
def q01_cosine_softmax_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.best(phrases(spark, d), patches(spark, d), 2).withColumn("prob", F.round("prob", 6))


def fast_cues(spark: SparkSession, d: str) -> DataFrame:
    return R.vote(R.best(phrases(spark, d), patches(spark, d), 2))


@query(f"WITH {VEC}, {softmax_sql('t')}, {vote_sql()} SELECT question_id, cue_pos, patch_idx, {SIX}, votes, is_extra FROM c")
def q02_vote_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fast_cues(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {VEC}, {softmax_sql('t')}, {vote_sql()} SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, cue_pos) - 1 AS cue_pos, patch_idx, {SIX} FROM c WHERE confidence > 0.5")
def q03_threshold_filter_sort(spark: SparkSession, d: str) -> DataFrame:
    return R.above(fast_cues(spark, d), 0.5).select("question_id", "cue_pos", "patch_idx", F.round("confidence", 6).alias("confidence"))


NEAR = """
n AS (SELECT question_id, pos, patch_idx AS label_id, label, list_distance(t.v, p.v) ^ 2 AS dist FROM t, p),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, pos ORDER BY dist, label_id) AS rank FROM n)"""


def near_labels(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    return R.nearest(phrases(spark, d), patches(spark, d).withColumnRenamed("patch_idx", "label_id"), 3, threshold)


@query(f"WITH {VEC}, {NEAR} SELECT question_id, pos, label_id, round(dist, 6) AS dist, rank FROM k WHERE rank <= 3 AND dist <= {LRSD_T}")
def q04_knn_l2_join_k3(spark: SparkSession, d: str) -> DataFrame:
    return near_labels(spark, d, LRSD_T).withColumn("dist", F.round("dist", 6))


@query(f"WITH {VEC}, {NEAR} SELECT question_id, pos, label_id, round(dist, 6) AS dist, rank FROM k WHERE rank <= 3 AND dist <= {LRSD_T}")
def q54_index_search(spark: SparkSession, d: str) -> DataFrame:
    """What q04 finds, from a stored index that is made of the even vectors, appended the odd ones, and opened."""
    path, labels = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}", patches(spark, d).withColumnRenamed("patch_idx", "label_id")
    I.create(labels.where("label_id % 2 = 0"), path)
    I.append(labels.where("label_id % 2 = 1"), path)
    return I.nearest(phrases(spark, d), I.open_index(spark, path), 3, LRSD_T).near.withColumn("dist", F.round("dist", 6))


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """Vectors as rows (by, i, x), rounded."""
    return df.select(*by, F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 6))


UNIT = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"


@query(f"WITH {VEC} SELECT label, i - 1 AS i, round(avg(v[i]), 6) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT label, {UNIT} AS v FROM e)) GROUP BY ALL")
def q05_reduce_mean(spark: SparkSession, d: str) -> DataFrame:
    return spread(R.mean(vectors(spark, d), ["label"]), ["label"])


@query(f"""
WITH RECURSIVE {VEC},
u AS (SELECT vec_id AS id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e),
g AS (SELECT a.label, a.id, b.id AS id2 FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id AND list_distance(a.v, b.v) <= 1.2),
c AS (SELECT label, id AS root, id FROM g UNION SELECT c.label, c.root, g.id2 FROM c JOIN g ON c.id = g.id),
m AS (SELECT label, id, min(root) AS cluster FROM c GROUP BY ALL),
z AS (SELECT label, cluster, count(*) AS size FROM m GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, cluster) AS r FROM z),
w AS (SELECT u.label, u.v FROM u LEFT JOIN b ON b.label = u.label AND r = 1 LEFT JOIN m ON m.id = u.id WHERE b.label IS NULL OR m.cluster = b.cluster)
SELECT label, i - 1 AS i, round(avg(v[i]), 6) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM w) GROUP BY ALL""")
def q06_reduce_cluster(spark: SparkSession, d: str) -> DataFrame:
    return spread(R.cluster_mean(vectors(spark, d).withColumnRenamed("vec_id", "id"), ["label"], 1.2), ["label"])


@query(f"""
WITH {VEC}, {NEAR}, lm AS (SELECT question_id, label, max(pos) AS pos FROM k WHERE rank <= 3 AND dist <= {CRSD_T} GROUP BY ALL),
r AS (SELECT lm.question_id, lm.label, p.v, row_number() OVER (PARTITION BY lm.question_id, lm.label ORDER BY list_inner_product(p.v, t.v) / sqrt(list_inner_product(p.v, p.v)) / sqrt(list_inner_product(t.v, t.v)) DESC, patch_idx) AS k
      FROM lm JOIN p ON p.label = lm.label JOIN t ON t.question_id = lm.question_id AND t.pos = lm.pos)
SELECT question_id, label, i - 1 AS i, round(avg(v[i]), 6) AS x FROM (SELECT question_id, label, v, unnest(range(1, len(v) + 1)) AS i FROM r WHERE k <= 3) GROUP BY ALL""")
def q07_reduce_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The labels near each question's phrases, each reduced to its three images most like the last phrase that found it."""
    images = patches(spark, d)
    near = near_labels(spark, d, CRSD_T).join(images.select(F.col("patch_idx").alias("label_id"), "label"), "label_id")
    found = R.reverse_map(near.select("question_id", F.col("label").alias("label_id"), "pos")).withColumnRenamed("label_id", "label")
    asked = found.join(phrases(spark, d).select("question_id", "pos", "vec"), ["question_id", "pos"])
    return spread(R.reranked(asked, images.withColumnRenamed("patch_idx", "image")), ["question_id", "label"])


CUES = """
k3 AS (SELECT * FROM k WHERE rank <= 3 AND dist <= {t}),
lm AS (SELECT question_id, label, max(pos) AS pos FROM k3 GROUP BY ALL),
we AS (SELECT question_id, label, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT question_id, lm.label, {unit} AS v FROM lm JOIN p ON p.label = lm.label)),
wa AS (SELECT question_id, label, i, avg(v[i]) AS x FROM we GROUP BY ALL),
wv AS (SELECT question_id, label AS pos, list(x ORDER BY i) AS v FROM wa GROUP BY ALL)"""


def slow_cues(spark: SparkSession, d: str, threshold: float, how: str = "mean") -> DataFrame:
    """Cues of the labels near each question's phrases: the labels' images reduced to a vector, compared with the patches. Both depend on the label alone, so they are worked out once for each label, however many
    questions found it."""
    images = patches(spark, d)
    near = near_labels(spark, d, threshold).join(images.select(F.col("patch_idx").alias("label_id"), "label"), "label_id")
    labels = stored(near.select("question_id", "label").distinct(), "labels")
    made = R.reduced(images.join(labels.select("label").distinct(), "label", "left_semi").withColumnRenamed("patch_idx", "id"), ["label"], how)
    texts = made.select(F.lit(0).cast("long").alias("question_id"), F.col("label").alias("pos"), "vec")
    best = R.best(texts, images, 2, normalise_texts=False).drop("question_id")
    return R.vote(stored(best.join(labels.withColumnRenamed("label", "pos"), "pos"), "best"))


@query(f"WITH {VEC}, {NEAR}, {CUES.format(t=LRSD_T, unit=UNIT)}, {softmax_sql('wv', False)}, {vote_sql()} SELECT question_id, cue_pos, patch_idx, {SIX}, votes FROM c")
def q08_select_visual_cue(spark: SparkSession, d: str) -> DataFrame:
    return slow_cues(spark, d, LRSD_T).select("question_id", "cue_pos", "patch_idx", F.round("confidence", 6).alias("confidence"), "votes")


# each phrase asks by itself here, with its vector read backwards, so that no phrase is its own row and several tiers are met
SOLO = "t AS (SELECT * REPLACE (question_id * 5 + pos AS question_id, list_reverse(v) AS v) FROM t0)"
VEC_SOLO = VEC.replace("\nt AS", "\nt0 AS") + ", " + SOLO


def solo(spark: SparkSession, d: str) -> DataFrame:
    return phrases(spark, d).withColumns({"question_id": F.col("question_id") * 5 + F.col("pos"), "vec": F.reverse("vec")})


def tiers(spark: SparkSession, d: str, path_t: float, lrsd_t: float, crsd_t: float) -> DataFrame:
    q = solo(spark, d)
    fast = stored(R.above(R.vote(R.best(q, patches(spark, d), 2)), path_t), "fast")
    left = q.join(fast.select("question_id").distinct(), "question_id", "left_anti")
    near = stored(R.nearest(left, patches(spark, d).withColumnRenamed("patch_idx", "label_id"), 3, max(lrsd_t, crsd_t)), "near")
    return R.routed(q, fast, near.where(F.col("dist") <= lrsd_t), near.where(F.col("dist") <= crsd_t))


@query(f"""
WITH {VEC_SOLO}, {softmax_sql('t')}, {vote_sql()}, {NEAR},
b AS (SELECT question_id, max(confidence) AS conf FROM c GROUP BY ALL), n1 AS (SELECT question_id, min(dist) AS dist FROM k WHERE rank <= 3 GROUP BY ALL)
SELECT t.question_id, CASE WHEN conf > 0.9 THEN 'Fast' WHEN dist <= {LRSD_T} THEN 'Slow-LRSD' WHEN dist <= {CRSD_T} THEN 'Slow-CRSD' ELSE 'Zero-shot' END AS path
FROM t JOIN b USING (question_id) JOIN n1 USING (question_id)""")
def q09_waterfall_paths(spark: SparkSession, d: str) -> DataFrame:
    return tiers(spark, d, 0.9, LRSD_T, CRSD_T)


@query(f"WITH {VEC}, {NEAR} SELECT question_id, label, max(pos) AS pos FROM k WHERE rank <= 3 AND dist <= {CRSD_T} GROUP BY ALL")
def q10_reverse_map_last_wins(spark: SparkSession, d: str) -> DataFrame:
    images = patches(spark, d).select(F.col("patch_idx").alias("label_id"), "label")
    near = near_labels(spark, d, CRSD_T).join(images, "label_id").select("question_id", F.col("label").alias("label_id"), "pos")
    return R.reverse_map(near).withColumnRenamed("label_id", "label")


@query("SELECT label, count(*) AS n, array_to_string(list(vec_id ORDER BY vec_id), ',') AS members FROM embeddings GROUP BY label")
def q28_label_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Each label's images; the list is the result, as in the index itself."""
    lists = vectors(spark, d).groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("l"))
    return lists.select("label", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 NOT IN (0, 3)")
def q39_cache_antijoin(spark: SparkSession, d: str) -> DataFrame:
    all_of = vectors(spark, d).select("vec_id", "label")
    return S.missing(all_of, all_of.where("vec_id % 7 IN (0, 3)"), ["vec_id"])


@query(f"""
WITH {VEC_SOLO}, {softmax_sql('t')}, {vote_sql()}, {NEAR},
b AS (SELECT question_id, max(confidence) AS conf FROM c GROUP BY ALL), n1 AS (SELECT question_id, min(dist) AS dist FROM k WHERE rank <= 3 GROUP BY ALL),
w AS (SELECT * FROM (VALUES (0.3), (0.5), (0.7)) a(path_t), (VALUES (1.1), (1.15), (1.2)) b(lrsd_t), (VALUES (1.2), (1.25), (1.3)) c(crsd_t))
SELECT CAST(path_t AS DOUBLE) AS path_t, CAST(lrsd_t AS DOUBLE) AS lrsd_t, CAST(crsd_t AS DOUBLE) AS crsd_t, CASE WHEN conf > path_t THEN 'Fast' WHEN dist <= lrsd_t THEN 'Slow-LRSD' WHEN dist <= crsd_t THEN 'Slow-CRSD' ELSE 'Zero-shot' END AS path, count(*) AS n
FROM t JOIN b USING (question_id) JOIN n1 USING (question_id), w GROUP BY ALL""")
def q40_sweep_all_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """All 27 points of a sweep from one table of similarities."""
    q = solo(spark, d)
    best = R.vote(R.best(q, patches(spark, d), 2)).groupBy("question_id").agg(F.max("confidence").alias("conf"))
    near = R.nearest(q, patches(spark, d).withColumnRenamed("patch_idx", "label_id"), 3).groupBy("question_id").agg(F.min("dist").alias("dist"))
    levels = [(p, l, c) for p in (0.3, 0.5, 0.7) for l in (1.1, 1.15, 1.2) for c in (1.2, 1.25, 1.3)]  # noqa: E741
    points = spark.createDataFrame(levels, "path_t double, lrsd_t double, crsd_t double").coalesce(1)
    path = F.when(F.col("conf") > F.col("path_t"), "Fast").when(F.col("dist") <= F.col("lrsd_t"), "Slow-LRSD").when(F.col("dist") <= F.col("crsd_t"), "Slow-CRSD").otherwise("Zero-shot")
    return best.join(near, "question_id").crossJoin(F.broadcast(points)).groupBy("path_t", "lrsd_t", "crsd_t", path.alias("path")).agg(F.count("*").alias("n"))


@query("SELECT label, pos, x FROM (SELECT label, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS x FROM (SELECT label, list(vec_id ORDER BY vec_id) AS l FROM embeddings GROUP BY label))")
def q43_positional_zip_explode(spark: SparkSession, d: str) -> DataFrame:
    lists = vectors(spark, d).groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("l"))
    zipped = lists.select("label", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("l") - 1).alias("pos"), F.col("l").alias("x"))).alias("z"))
    return zipped.select("label", F.col("z")["pos"].alias("pos"), F.col("z")["x"].alias("x"))


# ---------------------------------------------------------------- images and boxes


def images(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("image"), (F.col("p_partkey") * 37 % 4000 + 20).alias("width"), (F.col("p_size") * 61 + 15).cast("bigint").alias("height"))


IMG = "i AS (SELECT p_partkey AS image, p_partkey * 37 % 4000 + 20 AS width, CAST(p_size * 61 + 15 AS BIGINT) AS height FROM part)"
SUMS = """
f AS (SELECT image, x1, y1, x2, y2, min((level, r, c)) AS o FROM b GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY o) - 1 AS patch_idx FROM f)
SELECT image, count(*) AS n, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(y1) AS BIGINT) AS y1, CAST(sum(x2) AS BIGINT) AS x2, CAST(sum(y2) AS BIGINT) AS y2, CAST(sum(patch_idx * (x1 + 3 * y1)) AS BIGINT) AS places FROM z GROUP BY image"""


def sums(df: DataFrame) -> DataFrame:
    return df.groupBy("image").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.sum(F.col("patch_idx") * (F.col("x1") + 3 * F.col("y1"))).alias("places"))


@query(f"""
WITH {IMG}, s AS (SELECT *, CAST(ceil(width / 448) * 448 AS BIGINT) AS w, CAST(ceil(height / 448) * 448 AS BIGINT) AS h FROM i),
g AS (SELECT *, unnest(range(0, w // 448)) AS c FROM (SELECT *, unnest(range(0, h // 448)) AS r FROM s)),
b AS (SELECT image, 0 AS level, r, c, c * 448 * width // w AS x1, r * 448 * height // h AS y1, (c + 1) * 448 * width // w AS x2, (r + 1) * 448 * height // h AS y2 FROM g), {SUMS}""")
def q11_vit_patches(spark: SparkSession, d: str) -> DataFrame:
    return sums(P.vit(images(spark, d)))


@query(f"""
WITH {IMG}, s AS (SELECT *, CAST(ceil(width / level) * level AS BIGINT) AS w, CAST(ceil(height / level) * level AS BIGINT) AS h FROM (SELECT *, unnest(range(1, 11)) AS level FROM i)),
g AS (SELECT *, unnest(range(0, level)) AS c FROM (SELECT *, unnest(range(0, level)) AS r FROM s)),
b AS (SELECT image, level, r, c, c * (w // level) * width // w AS x1, r * (h // level) * height // h AS y1, (c + 1) * (w // level) * width // w AS x2, (r + 1) * (h // level) * height // h AS y2 FROM g), {SUMS}""")
def q12_grid_patches(spark: SparkSession, d: str) -> DataFrame:
    return sums(P.grid(images(spark, d)))


@query(f"""
WITH {IMG}, s AS (SELECT *, CAST(ceil(width / 20) * 20 AS BIGINT) AS w, CAST(ceil(height / 20) * 20 AS BIGINT) AS h FROM i),
l AS (SELECT *, unnest(range(1, 21)) AS k FROM s),
a AS (SELECT *, k * (w // 20) AS kw, k * (h // 20) AS kh, CASE WHEN k = 20 THEN 1 ELSE k * (w // 20 - 1) + 1 END AS sw, CASE WHEN k = 20 THEN 1 ELSE k * (h // 20 - 1) + 1 END AS sh FROM l),
m AS (SELECT *, CAST(CASE WHEN k = 20 THEN 1 ELSE ceil((w - kw) / sw) + 1 END AS BIGINT) AS mw, CAST(CASE WHEN k = 20 THEN 1 ELSE ceil((h - kh) / sh) + 1 END AS BIGINT) AS mh FROM a),
u AS (SELECT *, row_number() OVER (PARTITION BY image, mw * mh ORDER BY k) AS q FROM m),
g AS (SELECT *, unnest(range(0, mw)) AS c FROM (SELECT *, unnest(range(0, mh)) AS r FROM u WHERE q = 1)),
v AS (SELECT *, least(c * sw, w - kw) AS x, least(r * sh, h - kh) AS y FROM g),
b AS (SELECT image, 20 - k AS level, r, c, x * width // w AS x1, y * height // h AS y1, (x + kw) * width // w AS x2, (y + kh) * height // h AS y2 FROM v), {SUMS}""")
def q13_cc_patches(spark: SparkSession, d: str) -> DataFrame:
    return sums(P.cc(images(spark, d)))


GRIDS = "[" + ", ".join(f"{{'i': {i}, 'j': {j}}}" for i, j in G.TILE_GRIDS) + "]"


@query(f"""
WITH RECURSIVE {IMG}, g AS (SELECT {GRIDS} AS l),
f AS (
  SELECT image, width, height, 0 AS n, CAST('inf' AS DOUBLE) AS dist, 1 AS bi, 1 AS bj FROM i
  UNION ALL
  SELECT image, width, height, n + 1, CASE WHEN ok THEN d2 ELSE dist END, CASE WHEN ok THEN l[n + 1].i ELSE bi END, CASE WHEN ok THEN l[n + 1].j ELSE bj END
  FROM (SELECT *, d2 < dist OR (d2 = dist AND width * height > 0.5 * 448 * 448 * l[n + 1].i * l[n + 1].j) AS ok FROM (SELECT f.*, l, abs(width / height - l[n + 1].i / l[n + 1].j) AS d2 FROM f, g WHERE n < 14))),
h AS (SELECT image, bi AS cols, bj AS rows, unnest(range(0, bi * bj + CASE WHEN bi * bj > 1 THEN 1 ELSE 0 END)) AS tile FROM f WHERE n = 14)
SELECT image, cols, rows, tile, tile = cols * rows AS is_thumbnail,
  CASE WHEN tile = cols * rows THEN 0 ELSE tile % cols * 448 END AS x1, CASE WHEN tile = cols * rows THEN 0 ELSE tile // cols * 448 END AS y1,
  CASE WHEN tile = cols * rows THEN 448 ELSE tile % cols * 448 + 448 END AS x2, CASE WHEN tile = cols * rows THEN 448 ELSE tile // cols * 448 + 448 END AS y2 FROM h""")
def q14_dynamic_tiles(spark: SparkSession, d: str) -> DataFrame:
    return P.tiles(images(spark, d))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_partkey") % 900, F.col("l_suppkey") * 7 % 600
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity").cast("bigint") * 3).alias("x2"), (y + F.col("l_quantity").cast("bigint") * 2).alias("y2"), F.lit(1000).cast("bigint").alias("width"), F.lit(700).cast("bigint").alias("height"), "l_discount", "l_quantity")


BOX = "x AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 AS x1, l_suppkey * 7 % 600 AS y1, l_partkey % 900 + CAST(l_quantity AS BIGINT) * 3 AS x2, l_suppkey * 7 % 600 + CAST(l_quantity AS BIGINT) * 2 AS y2, 1000 AS width, 700 AS height, l_discount, l_quantity FROM lineitem)"


@query(f"WITH {BOX} SELECT l_orderkey, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, least(min(x1), arg_max(y1, l_linenumber * 100000 + y1)) AS y1_compat, round(avg(l_discount), 6) AS confidence, count(*) AS n FROM x GROUP BY l_orderkey")
def q15_bbox_union(spark: SparkSession, d: str) -> DataFrame:
    """y1_compat reproduces a known slip of earlier results: the last row's y1, if it is below all x1."""
    return boxes(spark, d).groupBy("l_orderkey").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.least(F.min("x1"), F.max_by("y1", F.col("l_linenumber") * 100000 + F.col("y1"))).alias("y1_compat"), F.round(F.avg("l_discount"), 6).alias("confidence"), F.count("*").alias("n"))


REGION_ROWS = ", ".join(f"({k}, '{n}')" for k, n in enumerate(G.REGIONS))


@query(f"""
WITH {BOX}, g AS (SELECT * FROM (VALUES {REGION_ROWS}) g(k, region)), y AS (SELECT *, row_number() OVER () AS rid FROM x),
a AS (SELECT rid, l_orderkey, l_linenumber, region, k, greatest(0, least(x2, 1000 / 3 * (k % 3) + 1000 / 3) - greatest(x1, 1000 / 3 * (k % 3))) * greatest(0, least(y2, 700 / 3 * (k // 3) + 700 / 3) - greatest(y1, 700 / 3 * (k // 3))) AS area FROM y, g)
SELECT l_orderkey, l_linenumber, region FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY area DESC, k) AS r FROM a) WHERE r = 1""")
def q16_bbox_region_3x3(spark: SparkSession, d: str) -> DataFrame:
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return boxes(spark, d).select("l_orderkey", "l_linenumber", G.region(b, F.col("width"), F.col("height")).alias("region"))


@query(f"""
WITH {BOX} SELECT l_orderkey, l_linenumber, CAST(trunc(greatest(0, (x1 + x2) / 2 - (x2 - x1) * 1.5 / 2)) AS INT) AS x1, CAST(trunc(greatest(0, (y1 + y2) / 2 - (y2 - y1) * 1.5 / 2)) AS INT) AS y1,
  CAST(trunc(least(width, (x1 + x2) / 2 + (x2 - x1) * 1.5 / 2)) AS INT) AS x2, CAST(trunc(least(height, (y1 + y2) / 2 + (y2 - y1) * 1.5 / 2)) AS INT) AS y2,
  round(least(greatest((x1 + x2) / 2 - (x2 - x1) * 2 / 2, 0), 800), 6) AS sx1 FROM x""")
def q17_bbox_enlarge_clamp(spark: SparkSession, d: str) -> DataFrame:
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    big = G.enlarged(b, 1.5, F.col("width"), F.col("height"))
    wide = G.scaled(b, 2.0, F.lit(0.0), F.lit(800.0))
    return boxes(spark, d).select("l_orderkey", "l_linenumber", *[v.alias(n) for v, n in zip(big, ("x1", "y1", "x2", "y2"), strict=True)], F.round(wide[0], 6).alias("sx1"))


@query(f"""
WITH {BOX}, o AS (SELECT l_orderkey, l_linenumber, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, radians(l_discount * 900) AS a FROM x),
q AS (SELECT *, abs(w / 2 * cos(a)) + abs(h / 2 * sin(a)) AS dx, abs(w / 2 * sin(a)) + abs(h / 2 * cos(a)) AS dy FROM o)
SELECT l_orderkey, l_linenumber, round(cx, 4) AS cx, round(cy, 4) AS cy, round(2 * dx, 4) AS w, round(2 * dy, 4) AS h FROM q""")
def q18_obb_to_hbb(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    out = G.enclosing(cx, cy, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("l_discount") * 900)
    return boxes(spark, d).select("l_orderkey", "l_linenumber", *[F.round(v, 4).alias(n) for v, n in zip(out, ("cx", "cy", "w", "h"), strict=True)])


@query(f"WITH {BOX}, n AS (SELECT l_orderkey, l_linenumber, CAST(trunc(x1 / width * 1000) AS INT) AS nx, CAST(trunc(y1 / height * 1000) AS INT) AS ny, width, height FROM x) SELECT l_orderkey, l_linenumber, nx, ny, CAST(trunc(nx / 1000 * width) AS INT) AS px, CAST(trunc(ny / 1000 * height) AS INT) AS py FROM n")
def q19_bbox_normalise_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = boxes(spark, d).select("l_orderkey", "l_linenumber", G.permille(F.col("x1"), F.col("width")).alias("nx"), G.permille(F.col("y1"), F.col("height")).alias("ny"), "width", "height")
    return n.select("l_orderkey", "l_linenumber", "nx", "ny", G.pixels(F.col("nx"), F.col("width")).alias("px"), G.pixels(F.col("ny"), F.col("height")).alias("py"))


def drawn_sql() -> str:
    """The generator's first words follow from its seed; a number below n is the next word's first bits, as many as n has, that say less than n. d: image, x1, y1, x2, y2."""
    import random

    draw = random.Random(2024)
    words = ", ".join(str(draw.getrandbits(32)) for _ in range(200))
    at = lambda n, since: f"list_filter(range({since}, 200), lambda j: (u[j + 1] >> (32 - length(bin({n})))) < {n})[1]"
    value = lambda n, k: f"(u[{k} + 1] >> (32 - length(bin({n}))))"
    return f"""
u AS (SELECT CAST([{words}] AS BIGINT[]) AS u),
d1 AS (SELECT *, {at("width", "0")} AS k1 FROM i, u), d2 AS (SELECT *, 1 + {value("width", "k1")} AS w, {at("height", "k1 + 1")} AS k2 FROM d1),
d3 AS (SELECT *, 1 + {value("height", "k2")} AS h, width - w + 1 AS across, {at("(width - w + 1)", "k2 + 1")} AS k3 FROM d2),
d4 AS (SELECT *, {value("across", "k3")} AS x, height - h + 1 AS down, {at("(height - h + 1)", "k3 + 1")} AS k4 FROM d3),
d AS (SELECT image, x AS x1, {value("down", "k4")} AS y1, x + w AS x2, {value("down", "k4")} + h AS y2 FROM d4)"""


@query(f"WITH {IMG}, {drawn_sql()} SELECT * FROM d")
def q41_random_subpatch(spark: SparkSession, d: str) -> DataFrame:
    """A box that depends on the image's size alone."""
    made = G.random_subpatch(images(spark, d))
    return made.select("image", *[F.col(f"sub_{n}").alias(n) for n in ("x1", "y1", "x2", "y2")])


# ---------------------------------------------------------------- answers, prompts, sweeps

CHOICES = ["(A) the first", "(B) other", "(C) in between", "(D) on top", "(E) none of these"]


def answers(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    n = F.col("doc_id") % 10
    output = F.when(n == 0, F.concat(F.lit("The best answer is ("), F.substring(F.lit("ABCDE"), F.col("doc_id").cast("int") % 5 + 1, F.lit(1)), F.lit(").")))
    output = output.when(n == 1, "the answer is other").when(n == 2, "").when(n == 3, "so so so so so so so so so so so so").when(n == 4, "Answer: D").when(n == 5, "best answer:best option: on top").otherwise(F.col("text"))
    return docs.select(
        "doc_id", output.alias("output"), F.array(*[F.lit(c) for c in CHOICES]).alias("choices"),
        F.when(F.col("doc_id") % 3 == 0, "Reasoning").otherwise("Perception").alias("task"), F.lit("Remote Sensing").alias("subtask"),
        F.element_at(F.array(*[F.lit(c) for c in ("position", "Color", "count", "person/attribute/x")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("category"),
        F.array(F.substring(F.lit("ABCDE"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1)), F.lit("A")).alias("truth"),
    )


def letter_sql() -> str:
    cut = "o"
    for p in reversed(X.PREFIXES):
        cut = f"CASE WHEN contains(o, '{p}') THEN list_last(string_split(o, '{p}')) WHEN contains(o, '{p.lower()}') THEN list_last(string_split(o, '{p.lower()}')) ELSE {cut} END"
    choices = "[" + ", ".join(f"'{c}'" for c in CHOICES) + "]"
    return f"""
o AS (SELECT doc_id, regexp_replace(regexp_replace(CASE doc_id % 10 WHEN 0 THEN 'The best answer is (' || substr('ABCDE', doc_id % 5 + 1, 1) || ').' WHEN 1 THEN 'the answer is other' WHEN 2 THEN '' WHEN 3 THEN 'so so so so so so so so so so so so' WHEN 4 THEN 'Answer: D' WHEN 5 THEN 'best answer:best option: on top' ELSE text END, '^\\s+', ''), '\\s+$', '') AS o FROM documents),
s AS (SELECT doc_id, {cut} AS s FROM o),
l AS (SELECT doc_id, CASE WHEN regexp_extract(s, '[ABCDE]') <> '' THEN regexp_extract(s, '[ABCDE]')
  WHEN len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) > 10 THEN ''
  ELSE coalesce(substr(list_filter({choices}, lambda c: contains(lower(c), lower(s)))[1], 2, 1), '') END AS letter FROM s)"""


@query(f"WITH {letter_sql()} SELECT doc_id, letter FROM l")
def q20_answer_extract(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("doc_id", X.answer_letter(F.col("output"), F.col("choices")).alias("letter"))


@query(f"""
WITH {letter_sql()},
j AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'Reasoning' ELSE 'Perception' END AS task, 'Remote Sensing' AS subtask, ['position', 'color', 'count', 'person/attribute'][doc_id % 4 + 1] AS category,
  CAST(letter IN (substr('ABCDE', doc_id % 5 + 1, 1), 'A') AS BIGINT) AS ok, CAST(letter = 'E' AS BIGINT) AS e FROM l)
SELECT CAST(grouping(task, subtask, category) AS BIGINT) AS level, task, subtask, category, count(*) AS n, CAST(sum(ok) AS BIGINT) AS n_true, CAST(sum(e) AS BIGINT) AS n_e, round(sum(ok) / count(*), 6) AS accuracy FROM j GROUP BY ROLLUP (task, subtask, category)""")
def q21_accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return E.accuracy(E.judged(answers(spark, d).where("subtask = 'Remote Sensing'"))).withColumn("accuracy", F.round("accuracy", 6))


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Each event is a run: its parameters follow from its id, its metrics from its value."""
    e = S.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))
    return e.select(
        "event_id", "event_type", "value", pick(("cc", "vit", "grid"), F.col("event_id")).alias("patch_method"), pick(("clip", "georsclip", "remoteclip", "mcipclip"), F.col("user_id")).alias("encoder_name"), pick(("mean", "cluster", "rerank"), F.col("event_id") + F.col("user_id")).alias("reduce_fn"),
        pick((0.3, 0.5, 0.7), F.col("event_id")).alias("path_T"), pick((0.1, 0.2, 0.3), F.expr("event_id div 3")).alias("lrsd_T"), pick((0.1, 0.3, 0.5), F.expr("event_id div 9")).alias("crsd_T"),
    )


RUNS = """r AS (SELECT event_id, event_type, value, ['cc', 'vit', 'grid'][event_id % 3 + 1] AS patch_method, ['clip', 'georsclip', 'remoteclip', 'mcipclip'][user_id % 4 + 1] AS encoder_name, ['mean', 'cluster', 'rerank'][(event_id + user_id) % 3 + 1] AS reduce_fn,
  CAST([0.3, 0.5, 0.7][event_id % 3 + 1] AS DOUBLE) AS path_T, CAST([0.1, 0.2, 0.3][event_id // 3 % 3 + 1] AS DOUBLE) AS lrsd_T, CAST([0.1, 0.3, 0.5][event_id // 9 % 3 + 1] AS DOUBLE) AS crsd_T FROM events)"""


@query(f"WITH {RUNS} SELECT encoder_name, reduce_fn, patch_method, max(value) AS best, count(*) AS n FROM r GROUP BY ALL")
def q22_sweep_group_max(spark: SparkSession, d: str) -> DataFrame:
    return sweep(spark, d).groupBy("encoder_name", "reduce_fn", "patch_method").agg(F.max("value").alias("best"), F.count("*").alias("n"))


@query(f"WITH {RUNS} SELECT path_T, lrsd_T, crsd_T, round(avg(value), 6) AS average FROM r GROUP BY ALL")
def q23_sweep_group_mean(spark: SparkSession, d: str) -> DataFrame:
    return sweep(spark, d).groupBy("path_T", "lrsd_T", "crsd_T").agg(F.round(F.avg("value"), 6).alias("average"))


@query(f"WITH {RUNS} SELECT event_id, value, value = (SELECT max(value) FROM r) AS is_best FROM r ORDER BY value DESC, event_id LIMIT 20")
def q24_sweep_best_rows(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best runs, as a report."""
    runs = sweep(spark, d)
    best = E.best_rows(runs, "value").select(F.col("event_id").alias("b"))
    top = runs.orderBy(F.desc("value"), "event_id").limit(20)
    return top.join(best, F.col("event_id") == F.col("b"), "left").select("event_id", "value", F.col("b").isNotNull().alias("is_best"))


@query(f"""
WITH {RUNS}, c AS (SELECT encoder_name, patch_method, reduce_fn, path_T, lrsd_T, crsd_T, count(*) AS n, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM r GROUP BY ALL)
SELECT concat_ws('_', 'questions', 'store', 'retrieval', patch_method, encoder_name, CAST(path_T AS VARCHAR), CAST(lrsd_T AS VARCHAR), CAST(crsd_T AS VARCHAR), reduce_fn) || '.jsonl' AS name, n, click, view FROM c WHERE n >= 2""")
def q25_result_pivot_complete(spark: SparkSession, d: str) -> DataFrame:
    key = ["encoder_name", "patch_method", "reduce_fn", "path_T", "lrsd_T", "crsd_T"]
    mean = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6).alias(kind)
    runs = sweep(spark, d).groupBy(*key).agg(F.count("*").alias("n"), mean("click"), mean("view")).where("n >= 2")
    text = lambda c: F.col(c).cast("string")
    name = X.result_name(F.lit("questions"), F.lit("store"), F.lit("retrieval"), F.col("patch_method"), F.col("encoder_name"), text("path_T"), text("lrsd_T"), text("crsd_T"), F.col("reduce_fn"))
    return runs.select(name.alias("name"), "n", "click", "view")


# Result files: seven runs share the answers out; one has broken lines, one a name that says nothing. A file counts if it has as many items as the second run.
RUN_NAMES = [f"d_s_m_cc_clip_0.{k}_0.1_0.5_mean.jsonl" for k in range(6)] + ["notes.jsonl"]
BROKEN = "doc_id % 7 = 5 AND doc_id % 10 = 5"


@query(f"""
WITH {letter_sql()},
r AS (SELECT doc_id, [{", ".join(f"'{n}'" for n in RUN_NAMES)}][doc_id % 7 + 1] AS file, {BROKEN} AS broken, NOT ({BROKEN}) AND doc_id % 3 <> 0 AS own, ['position', 'color', 'count', ''][doc_id % 4 + 1] AS category, CAST(letter IN (substr('ABCDE', doc_id % 5 + 1, 1), 'A') AS BIGINT) AS ok FROM l),
w AS (SELECT count(*) AS items FROM r WHERE own AND doc_id % 7 = 1),
f AS (SELECT file, count(*) FILTER (broken) AS bad, count(*) FILTER (own) AS n, avg(ok) FILTER (own) AS accuracy, {", ".join(f"avg(ok) FILTER (own AND category = '{c}') AS {c}" for c in ("position", "color", "count"))} FROM r GROUP BY file)
SELECT file, round(position, 6) AS position, round(color, 6) AS color, round("count", 6) AS "count", round(accuracy, 6) AS accuracy, n,
  CASE WHEN bad > 0 THEN bad || ' unreadable lines' WHEN file = 'notes.jsonl' THEN 'no parameters in its name' WHEN n <> items THEN n || ' items, not ' || items END AS reason FROM f, w""")
def q56_result_files(spark: SparkSession, d: str) -> DataFrame:
    """Result files are written, read back as a folder, and judged whole."""
    folder = f"{scratch_dir(spark)}/results-{uuid.uuid4().hex}"
    given = answers(spark, d)
    line = F.to_json(F.struct(F.col("task").alias("Task"), F.col("subtask").alias("Subtask"), F.col("category").alias("Category"), F.col("choices").alias("Answer choices"), F.to_json("truth").alias("Ground truth"), F.coalesce("output", F.lit("")).alias("output")))
    name = F.element_at(F.array(*map(F.lit, RUN_NAMES)), (F.col("doc_id") % 7 + 1).cast("int"))
    lines = given.select(F.when(F.expr(BROKEN), F.lit('{"Task": "Perc')).otherwise(line).alias("value"), name.alias("file"))
    lines.write.partitionBy("file").text(folder)
    items = given.where(f"doc_id % 7 = 1 AND doc_id % 3 != 0 AND NOT ({BROKEN})").count()
    made = RF.sweep(RF.read_results(spark, folder), items)
    return made.select("file", *(F.round(c, 6).alias(c) for c in ("position", "color", "count", "accuracy")), "n", "reason")


@query("SELECT label, count(*) AS n, count(DISTINCT p_name) AS spellings FROM (SELECT p_name, translate(lower(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '_' END)), '-_', '  ') AS label FROM part) GROUP BY label")
def q26_label_normalise_distinct(spark: SparkSession, d: str) -> DataFrame:
    part = S.table(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.translate("p_name", " ", "-")).otherwise(F.translate("p_name", " ", "_"))
    return part.select("p_name", X.label(raw).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("spellings"))


@query("""
WITH m AS (SELECT doc_id % 500 AS k, arg_max(quality, doc_id) AS quality, max(doc_id) AS last FROM labels GROUP BY ALL)
SELECT doc_id, quality, last FROM documents JOIN m ON doc_id % 500 = k""")
def q27_shard_metadata_join(spark: SparkSession, d: str) -> DataFrame:
    last = S.table(spark, d, "labels").groupBy((F.col("doc_id") % 500).alias("k")).agg(F.max_by("quality", "doc_id").alias("quality"), F.max("doc_id").alias("last"))
    docs = S.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 500).alias("k"))
    return docs.join(last, "k").select("doc_id", "quality", "last")


@query("""
WITH a AS (SELECT p_partkey, p_name, [p_name, p_brand, p_type] AS l, '(A) ' || p_brand AS c1, '(B) ' || p_type AS c2, p_size FROM part)
SELECT p_partkey, 'What is ' || p_name || '?' || ' The choices are listed below: ' || chr(10) || c1 || chr(10) || c2 || chr(10) || 'Select one.' || chr(10) || 'The best answer is:' AS prompt,
  '<image>' || chr(10) || 'Additional information:' || chr(10) || 'Sub-patch 1 at location <box>[[' || printf('%.2f', p_size::DOUBLE) || ', ' || printf('%.2f', 2.0) || ', ' || printf('%.2f', p_size * 3::DOUBLE) || ', ' || printf('%.2f', 999.0) || ']]</box>: <image>' || chr(10) AS evidence,
  l[1] || ', ' || l[2] || ', and ' || l[3] AS summary, 'a photo of a ' || p_name || '.' AS template FROM a""")
def q29_prompt_build(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    ask = X.question_prompt(F.concat(F.lit("What is "), "p_name", F.lit("?")), F.array(F.concat(F.lit("(A) "), "p_brand"), F.concat(F.lit("(B) "), "p_type")), "Select one.")
    box = F.struct(F.col("p_size").cast("double").alias("x1"), F.lit(2.0).alias("y1"), (F.col("p_size") * 3).cast("double").alias("x2"), F.lit(999.0).alias("y2"))
    return p.select("p_partkey", ask.alias("prompt"), X.evidence_prompt(F.array(box)).alias("evidence"), X.summary_phrase(F.array("p_name", "p_brand", "p_type")).alias("summary"), F.replace(F.lit("a photo of a {}."), F.lit("{}"), F.col("p_name")).alias("template"))


REPLY = "SELECT conv_id, turn, 'see [' || role || '] then [\"' || role || '\", \"x' || turn || '\"] end' AS reply FROM conversations"


def replies(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("see ["), "role", F.lit('] then ["'), "role", F.lit('", "x'), F.col("turn").cast("string"), F.lit('"] end'))
    return S.table(spark, d, "conversations").select("conv_id", "turn", made.alias("reply"))


@query(f"SELECT conv_id, turn, array_to_string(CAST(regexp_extract_all(reply, '\\[[^\\]]*\\]')[-1]::JSON AS VARCHAR[]), '|') AS phrases FROM ({REPLY})")
def q30_last_bracket_list(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("conv_id", "turn", F.array_join(X.last_list(F.col("reply")), "|").alias("phrases"))


@query("""
WITH a AS (SELECT o_orderkey, '<box>[[' || o_orderkey % 100 || ', ' || o_custkey % 90 || ',' || o_orderkey % 7 || '.5,' || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '9' END || ']]</box>' AS s FROM orders),
b AS (SELECT o_orderkey, regexp_extract(s, '\\[*\\[(.*?),(.*?),(.*?),(.*?)\\]\\]*', ['a', 'b', 'c', 'd']) AS m FROM a)
SELECT o_orderkey, try_cast(trim(m.a) AS DOUBLE) AS x1, try_cast(trim(m.b) AS DOUBLE) AS y1, try_cast(trim(m.c) AS DOUBLE) AS x2, try_cast(trim(m.d) AS DOUBLE) AS y2 FROM b""")
def q31_bbox_parse(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders")
    made = F.concat(F.lit("<box>[["), (F.col("o_orderkey") % 100).cast("string"), F.lit(", "), (F.col("o_custkey") % 90).cast("string"), F.lit(","), (F.col("o_orderkey") % 7).cast("string"), F.lit(".5,"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("9"), F.lit("]]</box>"))
    return o.select("o_orderkey", *[v.alias(n) for v, n in zip(X.box_of(made), ("x1", "y1", "x2", "y2"), strict=True)])


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS c FROM documents) SELECT doc_id, CAST(r // CAST(ceil(c / 7) AS BIGINT) AS INT) AS chunk FROM n")
def q32_chunk_ceil(spark: SparkSession, d: str) -> DataFrame:
    return E.chunk(S.table(spark, d, "documents").select("doc_id"), ["doc_id"], 7)


@query("SELECT doc_id, CAST(ntile(9) OVER (ORDER BY doc_id) - 1 AS INT) AS runner FROM documents")
def q33_balanced_assignment(spark: SparkSession, d: str) -> DataFrame:
    return E.assign(S.table(spark, d, "documents").select("doc_id"), ["doc_id"], 9)


@query("""
WITH a AS (SELECT DISTINCT p_name AS x, p_size % 5 AS s FROM part WHERE p_size % 2 = 0), b AS (SELECT DISTINCT p_name AS x, p_size % 5 AS s FROM part WHERE p_size % 3 = 0)
SELECT x, s, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT x, s, 'rest' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def q34_setops_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    pairs = lambda n: p.where(F.col("p_size") % n == 0).select(F.col("p_name").alias("x"), (F.col("p_size") % 5).alias("s"))
    a, b = pairs(2), pairs(3)
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(b.subtract(a).withColumn("kind", F.lit("rest")))


@query("""
WITH f AS (SELECT page_id, url, 'dir/p' || page_id || '_' || page_id % 7 || '-' || page_id % 5 || '-' || page_id % 7 + 10 || '-' || page_id % 5 + 20 || '.png' AS path FROM pages)
SELECT page_id, list_last(string_split(path, '/')) AS base, regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') AS stem, CAST(page_id % 7 AS INT) AS x1, CAST(page_id % 5 AS INT) AS y1, CAST(page_id % 7 + 10 AS INT) AS x2, CAST(page_id % 5 + 20 AS INT) AS y2, list_last(string_split(url, '/')) AS tail FROM f""")
def q35_filename_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k, add=0: (F.col("page_id") % k + add).cast("string")
    path = F.concat(F.lit("dir/p"), F.col("page_id").cast("string"), F.lit("_"), n(7), F.lit("-"), n(5), F.lit("-"), n(7, 10), F.lit("-"), n(5, 20), F.lit(".png"))
    return S.table(spark, d, "pages").select("page_id", X.basename(path).alias("base"), X.stem(path).alias("stem"), *[v.alias(k) for v, k in zip(X.patch_box(path), ("x1", "y1", "x2", "y2"), strict=True)], X.basename(F.col("url")).alias("tail"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT lang, source FROM documents UNION ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 0) GROUP BY lang")
def q36_union_all_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.unionByName(docs.where("doc_id % 2 = 0")).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query()
def q37_mmr_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    return E.key_phrases(S.table(spark, d, "documents"))


@query()
def q57_key_texts(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of each document that are keywords as well, then its other keywords."""
    return E.key_texts(S.table(spark, d, "documents"))


def hashed(text: Column, dim: int = 16) -> Column:
    """Counts of the words' hashes: a text encoder without weights."""
    slots = F.transform(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


@query(f"""
WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT unnest([{", ".join(f"'{t}'" for t in X.TEMPLATES)}]) AS t),
w AS (SELECT p_name, t, unnest(list_filter(string_split_regex(lower(replace(t, '{{}}', p_name)), '\\W+'), lambda x: x <> '')) AS w FROM n, t),
h AS (SELECT p_name, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 16 AS i FROM w)
SELECT p_name, CAST(i AS INT) AS i, round(count(*) / {len(X.TEMPLATES)}, 6) AS x FROM h GROUP BY ALL""")
def q38_hash_encode_template_mean(spark: SparkSession, d: str) -> DataFrame:
    names = S.table(spark, d, "part").select("p_name").distinct()
    texts = names.select("p_name", F.explode(X.templated(F.col("p_name"), X.TEMPLATES)).alias("t"))
    return spread(R.mean(texts.select("p_name", hashed(F.col("t")).alias("vec")), ["p_name"], normalise=False), ["p_name"]).where("x > 0")


@query(f"""
WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT unnest([{", ".join(f"'{t}'" for t in X.TEMPLATES)}]) AS t),
w AS (SELECT p_name, t, unnest(list_filter(string_split_regex(lower(replace(t, '{{}}', p_name)), '\\W+'), lambda x: x <> '')) AS w FROM n, t),
h AS (SELECT p_name, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 16 AS i FROM w)
SELECT p_name, CAST(i AS INT) AS i, round(count(*) / {len(X.TEMPLATES)}, 6) AS x FROM h GROUP BY ALL""")
def q55_cached_features(spark: SparkSession, d: str) -> DataFrame:
    """What q38 finds, by an encoder behind a cache: some names are encoded and written back, then all are asked for."""
    path = f"{scratch_dir(spark)}/features-{uuid.uuid4().hex}"
    names = S.table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.array("p_name").alias("phrases"))
    M.phrase_features(names.where("question_id % 3 = 0"), path, "hashed", X.TEMPLATES)
    found = M.phrase_features(names, path, "hashed", X.TEMPLATES).vectors.select(F.col("phrase").alias("p_name"), "vec")
    return spread(found.dropDuplicates(["p_name"]), ["p_name"]).where("x > 0")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def q44_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    read = S.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return read.select("event_id", "p.k", F.to_json("p").alias("again"))


@query(f"""
WITH {VEC}, {softmax_sql('t')}, {vote_sql()},
b AS (SELECT question_id, cue_pos, confidence, patch_idx % 40 * 20 AS x1, patch_idx % 30 * 20 AS y1 FROM c)
SELECT question_id, min(x1) AS x1, min(y1) AS y1, max(x1 + 100) AS x2, max(y1 + 80) AS y2, round(avg(confidence), 6) AS confidence, CAST(trunc(min(x1) / 900 * 1000) AS INT) AS nx1, CAST(trunc(max(y1 + 80) / 700 * 1000) AS INT) AS ny2, count(*) AS n FROM b GROUP BY question_id""")
def q45_cue_assembly(spark: SparkSession, d: str) -> DataFrame:
    cues = R.above(fast_cues(spark, d), 0.0).withColumns({"x1": F.col("patch_idx") % 40 * 20, "y1": F.col("patch_idx") % 30 * 20})
    union = cues.groupBy("question_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max(F.col("x1") + 100).alias("x2"), F.max(F.col("y1") + 80).alias("y2"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("n"))
    return union.select("*", G.permille(F.col("x1"), F.lit(900)).alias("nx1"), G.permille(F.col("y2"), F.lit(700)).alias("ny2"))


# ---------------------------------------------------------------- modes

INSTRUCTION = "Select one."


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions about part rows: the true box follows from the row, every fourth one counts."""
    p = images(spark, d).join(S.table(spark, d, "part").select(F.col("p_partkey").alias("image"), "p_name", "p_brand", "p_type", "p_size"), "image")
    x, y, n = F.col("image") % 19, F.col("image") % 7, F.col("p_size")
    return p.select(
        F.col("image").alias("question_id"), F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("text"), F.array(F.concat(F.lit("(A) "), "p_brand"), F.concat(F.lit("(B) "), "p_type")).alias("choices"),
        F.when(F.col("image") % 4 == 0, "count").otherwise("color").alias("category"), "width", "height", F.array(*[v.cast("double") for v in (x, y, x + n / 7, y + n)]).alias("gt_toi"),
    )


ASKED = f"""{IMG.replace("i AS (", "i0 AS (")},
q AS (SELECT p_partkey AS question_id, i0.width, i0.height, CASE WHEN p_partkey % 4 = 0 THEN 'count' ELSE 'color' END AS category, CAST(p_partkey % 19 AS DOUBLE) AS x1, CAST(p_partkey % 7 AS DOUBLE) AS y1, p_partkey % 19 + p_size / 7 AS x2, CAST(p_partkey % 7 + p_size AS DOUBLE) AS y2,
  'What is ' || p_name || '? The choices are listed below: ' || chr(10) || '(A) ' || p_brand || chr(10) || '(B) ' || p_type || chr(10) || 'Select one.' || chr(10) || 'The best answer is:' AS plain FROM part JOIN i0 ON image = p_partkey)"""
HEAD, LOOKING = "'<image>' || chr(10) || 'Additional information:' || chr(10)", "'" + X.LOOK.replace("\n", "' || chr(10) || '") + "'"


def patch_sql(n: str, box: str) -> str:
    return f"'Sub-patch ' || {n} || ' at location <box>[[' || " + " || ', ' || ".join(f"printf('%.2f', {box.format(c)}::DOUBLE)" for c in ("x1", "y1", "x2", "y2")) + " || ']]</box>: <image>' || chr(10)"


@query(f"WITH {ASKED} SELECT question_id, plain AS prompt, 'baseline' AS path FROM q")
def q46_mode_baseline(spark: SparkSession, d: str) -> DataFrame:
    return O.prompts("baseline", asked(spark, d), INSTRUCTION).select("question_id", "prompt", "path")


@query(f"""
WITH {ASKED}, g AS (SELECT *, trunc(greatest(0, (x1 + x2) / 2 - (x2 - x1) * 1.5 / 2)) / width * 1000 AS bx1, trunc(greatest(0, (y1 + y2) / 2 - (y2 - y1) * 1.5 / 2)) / height * 1000 AS by1,
  trunc(least(width, (x1 + x2) / 2 + (x2 - x1) * 1.5 / 2)) / width * 1000 AS bx2, trunc(least(height, (y1 + y2) / 2 + (y2 - y1) * 1.5 / 2)) / height * 1000 AS by2 FROM q)
SELECT question_id, {HEAD} || {patch_sql("1", "b{}")} || {LOOKING} || plain AS prompt, CAST(trunc(bx1 / 1000 * width) AS INT) AS crop_x1, CAST(trunc(by2 / 1000 * height) AS INT) AS crop_y2 FROM g""")
def q47_mode_detection_gt(spark: SparkSession, d: str) -> DataFrame:
    """The true box, half as large again."""
    made = O.prompts("detection_gt", asked(spark, d), INSTRUCTION, factor=1.5)
    return made.select("question_id", "prompt", F.col("crops")[0]["x1"].alias("crop_x1"), F.col("crops")[0]["y2"].alias("crop_y2"))


def cue_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Two or three cues of two questions in three."""
    some = images(spark, d).where("image % 3 != 0").select(F.col("image").alias("question_id"), F.explode(F.sequence(F.lit(0), (F.col("image") % 3).cast("int"))).alias("cue_pos"), "width", "height")
    x, y = F.col("cue_pos") * 3 + F.col("question_id") % 11, (2 - F.col("cue_pos")) * 2 + F.col("question_id") % 5
    return some.select("question_id", F.lit("Fast").alias("path"), "cue_pos", ((F.col("cue_pos") * 7 + F.col("question_id")) % 10 / 10.0).alias("confidence"), x.alias("x1"), y.alias("y1"), (x + 9).alias("x2"), (y + 8).alias("y2"))


@query(f"""
WITH {ASKED}, c0 AS (SELECT question_id, width, height, category, plain, unnest(range(0, question_id % 3 + 1)) AS pos FROM q WHERE question_id % 3 <> 0),
c AS (SELECT *, (pos * 7 + question_id) % 10 / 10.0::DOUBLE AS conf, pos * 3 + question_id % 11 AS x1, (2 - pos) * 2 + question_id % 5 AS y1, pos * 3 + question_id % 11 + 9 AS x2, (2 - pos) * 2 + question_id % 5 + 8 AS y2 FROM c0),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY conf DESC, pos) AS n, count(*) OVER (PARTITION BY question_id) AS m FROM c WHERE conf > 0),
u AS (SELECT question_id, any_value(width) AS width, any_value(height) AS height, any_value(category) AS category, count(*) AS m, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, avg(conf) AS conf FROM k GROUP BY question_id),
b AS (
  SELECT question_id, width, height, n, x1, y1, x2, y2, conf FROM k WHERE m = 1 OR category <> 'count'
  UNION ALL SELECT question_id, width, height, CASE WHEN category = 'count' THEN 1 ELSE m + 1 END, x1, y1, x2, y2, conf FROM u WHERE m > 1),
s AS (SELECT question_id, n, conf, trunc(x1 / width * 1000) AS x1, trunc(y1 / height * 1000) AS y1, trunc(x2 / width * 1000) AS x2, trunc(y2 / height * 1000) AS y2 FROM b),
a AS (SELECT question_id, string_agg({patch_sql("n", "{}")}, '' ORDER BY n) AS said, array_to_string(list(round(conf, 6) ORDER BY n), ',') AS confidence FROM s GROUP BY question_id)
SELECT q.question_id, CASE WHEN said IS NULL THEN plain ELSE {HEAD} || said || {LOOKING} || plain END AS prompt, coalesce(confidence, '') AS confidence, CASE WHEN said IS NULL THEN 'Zero-shot' ELSE 'Fast' END AS path FROM q LEFT JOIN a USING (question_id)""")
def q48_mode_retrieval(spark: SparkSession, d: str) -> DataFrame:
    made = O.prompts("retrieval", asked(spark, d), INSTRUCTION, cues=cue_boxes(spark, d))
    return made.select("question_id", "prompt", F.array_join(F.transform("confidence", lambda x: F.round(x, 6).cast("string")), ",").alias("confidence"), "path")


# Retrieval in tiers: every 25 vectors are one question's patches, its first three, read backwards, its phrases. The labels of the first store are those of the table,
# the captions of the second finer; the vector of a label is its first image's.
TIERED = {"path_t": 0.9995, "lrsd_t": 1.45, "crsd_t": 1.32, "eps": 1.2}


def own_phrases(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("vec_id % 25 < 3").select(F.expr("vec_id div 25").alias("question_id"), F.expr("vec_id % 25").alias("pos"), F.reverse("vec").alias("vec"))


def own_patches(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("vec_id") % 40 * 20, F.col("vec_id") % 30 * 20
    return vectors(spark, d).select(F.expr("vec_id div 25").alias("question_id"), F.col("vec_id").alias("patch_idx"), "vec", x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 80).alias("y2"))


def own_store(spark: SparkSession, d: str, label: Column) -> W.Store:
    v = vectors(spark, d).withColumn("label", label)
    labels = v.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec"))
    return W.store(v.select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("img_name"), "label", "vec"), labels)


def tiered(spark: SparkSession, d: str, reduce: str) -> tuple[DataFrame, DataFrame, W.Store, W.Store, W.Settings]:
    caption = F.col("label") * 7 + F.col("vec_id") % 7
    return own_phrases(spark, d), own_patches(spark, d), own_store(spark, d, F.col("label")), own_store(spark, d, caption), W.Settings(**TIERED, reduce=reduce)


def reduced_sql(name: str, how: str) -> str:
    """(question_id, pos, v) of the labels found in {name}f: their images in {name}i as one vector."""
    if how == "rerank":
        chosen = f"""
{name}o AS (SELECT f.question_id, f.place, i.v FROM {name}f f JOIN t ON t.question_id = f.question_id AND t.pos = f.pos JOIN {name}i i ON i.label = f.label
  QUALIFY row_number() OVER (PARTITION BY f.question_id, f.label ORDER BY list_inner_product(i.v, t.v) / sqrt(list_inner_product(i.v, i.v)) / sqrt(list_inner_product(t.v, t.v)) DESC, i.vec_id) <= 3),"""
    elif how == "mean":
        chosen = f"""
{name}o AS (SELECT question_id, place, {UNIT} AS v FROM {name}f JOIN {name}i USING (label)),"""
    else:
        chosen = f"""
{name}u AS (SELECT vec_id AS id, label, {UNIT} AS v FROM {name}i),
{name}g AS (SELECT a.label, a.id, b.id AS id2 FROM {name}u a JOIN {name}u b ON a.label = b.label AND a.id <> b.id AND list_distance(a.v, b.v) <= {TIERED["eps"]}),
{name}c AS (SELECT label, id AS root, id FROM {name}g UNION SELECT c.label, c.root, g.id2 FROM {name}c c JOIN {name}g g ON c.id = g.id),
{name}m AS (SELECT label, id, min(root) AS cluster FROM {name}c GROUP BY ALL),
{name}b AS (SELECT label, cluster FROM (SELECT label, cluster, count(*) AS size FROM {name}m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY label ORDER BY size DESC, cluster) = 1),
{name}o AS (SELECT question_id, place, u.v FROM {name}f JOIN {name}u u USING (label) LEFT JOIN {name}b b ON b.label = u.label LEFT JOIN {name}m m ON m.id = u.id WHERE b.label IS NULL OR m.cluster = b.cluster),"""
    return f"""{chosen}
{name}e AS (SELECT question_id, place, v, unnest(range(1, len(v) + 1)) AS i FROM {name}o),
{name}v AS (SELECT question_id, place AS pos, list(x ORDER BY i) AS v FROM (SELECT question_id, place, i, avg(v[i]) AS x FROM {name}e GROUP BY ALL) GROUP BY ALL)"""


def tier_sql(name: str, label: str, threshold: float, how: str) -> str:
    """{name}x: the votes of the labels near each question's phrases."""
    return f"""
{name}i AS (SELECT vec_id, {label} AS label, v FROM e), {name}l AS (SELECT label, arg_min(v, vec_id) AS v FROM {name}i GROUP BY label),
{name}k AS (SELECT question_id, pos, l.label, list_distance(t.v, l.v) ^ 2 AS dist, row_number() OVER (PARTITION BY question_id, pos ORDER BY list_distance(t.v, l.v) ^ 2, l.label) AS rank FROM t, {name}l l),
{name}f AS (SELECT question_id, label, max(pos) AS pos, min(pos * 3 + rank - 1) AS place FROM {name}k WHERE rank <= 3 AND dist <= {threshold} GROUP BY ALL), {reduced_sql(name, how)},
{softmax_sql(f"{name}v", False, f"{name}s", own=True)}, {vote_sql(f"{name}s", f"{name}x")}"""


def waterfall_sql(how: str) -> str:
    """w: question_id, path, cue_pos, patch_idx, confidence."""
    return f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT vec_id // 25 AS question_id, vec_id % 25 AS pos, list_reverse(v) AS v FROM e WHERE vec_id % 25 < 3),
p AS (SELECT vec_id // 25 AS question_id, vec_id AS patch_idx, v FROM e),
{softmax_sql("t", own=True)}, {vote_sql()}, {tier_sql("y", "label", TIERED["lrsd_t"], how)}, {tier_sql("z", "label * 7 + vec_id % 7", TIERED["crsd_t"], how)},
a AS (
  SELECT question_id, 0 AS tier, '{W.FAST}' AS path, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, cue_pos) - 1 AS cue_pos, patch_idx, confidence FROM c WHERE confidence > {TIERED["path_t"]}
  UNION ALL SELECT question_id, 1, '{W.LRSD}', cue_pos, patch_idx, confidence FROM yx
  UNION ALL SELECT question_id, 2, '{W.CRSD}', cue_pos, patch_idx, confidence FROM zx),
w AS (SELECT * EXCLUDE (tier, first) FROM (SELECT *, min(tier) OVER (PARTITION BY question_id) AS first FROM a) WHERE tier = first)"""


def evidence(spark: SparkSession, d: str, reduce: str) -> DataFrame:
    phrases, *given = tiered(spark, d, reduce)
    return W.retrieve(phrases.select("question_id"), phrases, *given).evidence.withColumns({"cue_pos": F.col("cue_pos").cast("int"), "confidence": F.round("confidence", 6)})


@query(f"WITH {waterfall_sql('mean')} SELECT question_id, path, CAST(cue_pos AS INT) AS cue_pos, patch_idx, {SIX} FROM w")
def q49_tier_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What the first tier with evidence has for each question; labels are reduced to their images' mean."""
    return evidence(spark, d, "mean")


@query(f"WITH {waterfall_sql('rerank')} SELECT question_id, path, CAST(cue_pos AS INT) AS cue_pos, patch_idx, {SIX} FROM w")
def q51_tier_evidence_rerank(spark: SparkSession, d: str) -> DataFrame:
    """As q49, labels reduced to the mean of the three images most like the phrase: raw vectors, not of unit length."""
    return evidence(spark, d, "rerank")


@query(f"WITH RECURSIVE {waterfall_sql('cluster')} SELECT question_id, path, CAST(cue_pos AS INT) AS cue_pos, patch_idx, {SIX} FROM w")
def q52_tier_evidence_cluster(spark: SparkSession, d: str) -> DataFrame:
    """As q49, labels reduced to the mean of their largest cluster."""
    return evidence(spark, d, "cluster")


def cued_sql(boxes: str) -> str:
    """a: question_id, said (the evidence's part of the prompt), confidence, path; from boxes (question_id, path, category, width, height, pos, conf, x1, y1, x2, y2)."""
    return f"""
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY conf DESC, pos) AS n, count(*) OVER (PARTITION BY question_id) AS m FROM {boxes} WHERE conf > 0),
u AS (SELECT question_id, any_value(path) AS path, any_value(width) AS width, any_value(height) AS height, any_value(category) AS category, count(*) AS m, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, avg(conf) AS conf FROM k GROUP BY question_id),
b AS (
  SELECT question_id, path, width, height, n, x1, y1, x2, y2, conf FROM k WHERE m = 1 OR category <> 'count'
  UNION ALL SELECT question_id, path, width, height, CASE WHEN category = 'count' THEN 1 ELSE m + 1 END, x1, y1, x2, y2, conf FROM u WHERE m > 1),
s2 AS (SELECT question_id, path, n, conf, trunc(x1 / width * 1000) AS x1, trunc(y1 / height * 1000) AS y1, trunc(x2 / width * 1000) AS x2, trunc(y2 / height * 1000) AS y2 FROM b),
a2 AS (SELECT question_id, any_value(path) AS path, string_agg({patch_sql("n", "{}")}, '' ORDER BY n) AS said, array_to_string(list(round(conf, 6) ORDER BY n), ',') AS confidence FROM s2 GROUP BY question_id)"""


def numbered_questions(spark: SparkSession, d: str) -> DataFrame:
    """The questions of the tiers, in words."""
    n = F.col("question_id").cast("string")
    asked = vectors(spark, d).select(F.expr("vec_id div 25").alias("question_id")).distinct()
    return asked.select(
        "question_id", F.concat(F.lit("What is in region "), n, F.lit("?")).alias("text"), F.array(F.concat(F.lit("(A) number "), n), F.lit("(B) nothing")).alias("choices"),
        F.when(F.col("question_id") % 4 == 0, "count").otherwise("color").alias("category"), F.lit(900).alias("width"), F.lit(700).alias("height"),
    )


@query(f"""
WITH {waterfall_sql("mean")},
q AS (SELECT question_id, CASE WHEN question_id % 4 = 0 THEN 'count' ELSE 'color' END AS category, 'What is in region ' || question_id || '? The choices are listed below: ' || chr(10) || '(A) number ' || question_id || chr(10) || '(B) nothing' || chr(10) || 'Select one.' || chr(10) || 'The best answer is:' AS plain FROM (SELECT DISTINCT vec_id // 25 AS question_id FROM e)),
x0 AS (SELECT question_id, path, category, 900 AS width, 700 AS height, cue_pos AS pos, confidence AS conf, patch_idx % 40 * 20 AS x1, patch_idx % 30 * 20 AS y1, patch_idx % 40 * 20 + 100 AS x2, patch_idx % 30 * 20 + 80 AS y2 FROM w JOIN q USING (question_id)),
{cued_sql("x0")}
SELECT q.question_id, CASE WHEN said IS NULL THEN plain ELSE {HEAD} || said || {LOOKING} || plain END AS prompt, coalesce(path, '{W.ZERO}') AS path FROM q LEFT JOIN a2 USING (question_id)""")
def q53_retrieval_prompts(spark: SparkSession, d: str) -> DataFrame:
    """From vectors, stores and questions to prompts, tier by tier."""
    return W.retrieved_prompts(numbered_questions(spark, d), *tiered(spark, d, "mean"), INSTRUCTION)[0].select("question_id", "prompt", "path")


# ---------------------------------------------------------------- boxes of patches in words, detected and drawn boxes, files

OWN_BOX = "b AS (SELECT vec_id AS patch_idx, vec_id // 25 AS question_id, vec_id % 40 * 20 AS x1, vec_id % 30 * 20 AS y1, vec_id % 40 * 20 + 100 AS x2, vec_id % 30 * 20 + 80 AS y2 FROM embeddings)"


@query(f"""
WITH {OWN_BOX}, c AS (SELECT *, x1 - 30.5 AS l, y1 - 20.25 AS t, least(greatest(x1 + 50.0 - 75, 0), 900) AS sx, least(greatest(y1 + 40.0 - 60, 0), 900) AS sy FROM b)
SELECT patch_idx, '<' || CAST(trunc(greatest(l, 0)) AS INT) || '><' || CAST(trunc(greatest(t, 0)) AS INT) || '><' || x2 || '><' || y2 || '>|<' || patch_idx % 90 || '>' AS region, x2 - x1 AS w, y2 - y1 AS h,
  CAST(trunc(sx / 900 * 1800) AS INT) AS px, CAST(trunc(sy / 900 * 700) AS INT) AS py, CAST(trunc(l) AS INT) AS whole FROM c""")
def q58_box_texts(spark: SparkSession, d: str) -> DataFrame:
    """Boxes and angles in words, sides from ranges, whole numbers, and cues scaled and brought to an image's pixels."""
    p = own_patches(spark, d).withColumns({"l": F.col("x1") - 30.5, "t": F.col("y1") - 20.25})
    ranges = G.sides_of_ranges(F.array("x1", "x2"), F.array("y1", "y2"))
    text = X.region_text(F.col("l"), F.col("t"), F.col("x2"), F.col("y2"), F.col("patch_idx") % 90)
    side = lambda v: F.lit(float(v))
    _, pixels = G.cue_boxes(F.col("x1") + 50.0, F.col("y1") + 40.0, side(100), side(80), 1.5, side(0), side(900), F.lit(1800), F.lit(700))
    return p.select("patch_idx", text.alias("region"), ranges[2].alias("w"), ranges[3].alias("h"), pixels[0].alias("px"), pixels[1].alias("py"), G.whole(F.array(F.array("l", "t")))[0][0].alias("whole"))


QUESTIONS_SQL = """
e AS (SELECT DISTINCT vec_id // 25 AS question_id FROM embeddings),
q AS (SELECT question_id, 'What is in region ' || question_id || '?' AS text, 'What is in region ' || question_id || '? The choices are listed below: ' || chr(10) || '(A) number ' || question_id || chr(10) || '(B) nothing' || chr(10) || 'Select one.' || chr(10) || 'The best answer is:' AS plain FROM e)"""


def naming() -> M.Ask:
    """A language model that names the region in the question."""
    return lambda prompts: [f" region {p.partition('region ')[2].partition('?')[0]} " for p in prompts]


def pointing() -> M.Ask:
    """A vision model that finds every third region, where its number says."""

    def point(prompt: str) -> str:
        n = int(prompt.partition("<ref>region ")[2].partition("<")[0])
        return f"there: <box>[[{n % 100}, {n % 90}, {n % 100 + 300}, {n % 90 + 400}]]</box>" if n % 3 == 0 else "nothing"

    return lambda prompts: list(map(point, prompts))


@query(f"""
WITH {QUESTIONS_SQL}, p AS (SELECT *, question_id % 100 AS x1, question_id % 90 AS y1, question_id % 100 + 300 AS x2, question_id % 90 + 400 AS y2 FROM q)
SELECT question_id, CASE WHEN question_id % 3 = 0 THEN {HEAD} || {patch_sql("1", "{}")} || {LOOKING} || plain ELSE plain END AS prompt, 'region ' || question_id AS target_of_interest, CASE WHEN question_id % 3 = 0 THEN CAST(trunc(x2 / 1000 * 900) AS INT) END AS crop_x2 FROM p""")
def q59_mode_detection(spark: SparkSession, d: str) -> DataFrame:
    """Targets named and boxes found by models behind callables."""
    made = O.prompts("baseline_detection", numbered_questions(spark, d), INSTRUCTION, language=naming, vision=pointing)
    return made.select("question_id", "prompt", "target_of_interest", F.get("crops", F.lit(0))["x2"].alias("crop_x2"))


@query(f"""
WITH {QUESTIONS_SQL}, i AS (SELECT question_id AS image, 200 + question_id % 7 AS width, 100 + question_id % 5 AS height FROM q), {drawn_sql()},
p AS (SELECT q.question_id, plain, d.x1 / width * 1000 AS x1, d.y1 / height * 1000 AS y1, d.x2 / width * 1000 AS x2, d.y2 / height * 1000 AS y2 FROM q JOIN d ON d.image = question_id JOIN i ON i.image = question_id)
SELECT question_id, {HEAD} || {patch_sql("1", "{}")} || {LOOKING} || plain AS prompt FROM p""")
def q60_mode_drawn_box(spark: SparkSession, d: str) -> DataFrame:
    """A box that depends on the image's size alone, as evidence."""
    sized = numbered_questions(spark, d).withColumns({"width": (200 + F.col("question_id") % 7).cast("int"), "height": (100 + F.col("question_id") % 5).cast("int")})
    return O.prompts("detection_gt_fake", sized, INSTRUCTION).select("question_id", "prompt")


@query("""
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Reasoning' ELSE 'Perception' END AS task, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS answers, length(coalesce(text, '')) AS n FROM documents WHERE doc_id IS NOT NULL)
SELECT CASE WHEN doc_id % 5 = 0 THEN 'json' ELSE 'jsonl' END AS kind, task, count(*) AS rows, CAST(sum(answers) AS BIGINT) AS answers, CAST(sum(n) AS BIGINT) AS characters FROM a GROUP BY ALL""")
def q61_question_files(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON lines, and each fifth one in an array of its own, read by what their file's name ends with."""
    docs = S.table(spark, d, "documents").where("doc_id IS NOT NULL")
    truth = F.when(F.col("doc_id") % 2 == 0, F.lit("A")).otherwise(F.lit('["A", "B"]'))
    task = F.when(F.col("doc_id") % 3 == 0, "Reasoning").otherwise("Perception")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("Question_id"), task.alias("Task"), F.coalesce("text", F.lit("")).alias("Text"), truth.alias("Ground truth")))
    base, array = f"{scratch_dir(spark)}/questions-{uuid.uuid4().hex}", F.col("doc_id") % 5 == 0
    docs.where(~array).select(line.alias("value")).write.text(f"{base}/q.jsonl")
    docs.where(array).select(F.concat(F.lit("["), line, F.lit("]")).alias("value")).write.option("lineSep", "\n").text(f"{base}/a.json")
    lines = S.read_questions(spark, f"{base}/q.jsonl").withColumn("kind", F.lit("jsonl"))
    arrays = spark.read.text(f"{base}/a.json").select(F.explode(F.from_json("value", S.T.ArrayType(S.QUESTION))).alias("q")).select("q.*")
    both = lines.select("kind", "task", "text", "ground_truth").unionByName(S.named(arrays).withColumn("kind", F.lit("json")).select("kind", "task", "text", "ground_truth"))
    return both.groupBy("kind", "task").agg(F.count("*").alias("rows"), F.sum(F.size("ground_truth")).alias("answers"), F.sum(F.length("text")).alias("characters"))


@query("""
WITH m AS (SELECT 'v' || vec_id || '.png' AS img_name, 'a view, of "label" ' || label || chr(10) || 'number ' || vec_id AS text, label, vec_id, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings)
SELECT label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters, round(sum(first), 5) AS first, max(img_name) AS last FROM m GROUP BY label""")
def q62_shards_and_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Feature shards and their captions, two files of which the later counts, written, read, joined, stored by label and read again."""
    base, v = f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}", vectors(spark, d)
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".png"))
    S.write_store(v.select(F.concat(F.lit("some/folder/"), name).alias("img_name"), "label", F.col("vec").alias("feat")), f"{base}/shards")
    said = F.concat(F.lit('a view, of "label" '), F.col("label").cast("string"), F.lit("\n"), F.lit("number "), F.col("vec_id").cast("string"))
    for k, text in enumerate((F.lit("to be replaced"), said)):
        v.select(name.alias("file_name"), text.alias("text")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{base}/captions-{k}")
    captions = [S.read_metadata(spark, [f"{base}/captions-{k}"]).select(F.lit(k).alias("pos"), F.col("file_name").alias("img_name"), "text") for k in (0, 1)]
    S.write_store(S.joined_metadata(S.read_shards(spark, f"{base}/shards"), captions[0].unionByName(captions[1])), f"{base}/store", by=["label"])
    read = S.read_store(spark, f"{base}/store")
    return read.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"), F.round(F.sum(F.col("feat")[0].cast("double")), 5).alias("first"), F.max("img_name").alias("last"))


@query(f"WITH {BOX}, o AS (SELECT *, row_number() OVER () AS r, (x1 + x2) / 2 - 300 AS cx, (y1 + y2) / 2 - 200 AS cy, x2 - x1 AS w, y2 - y1 AS h, radians(l_discount * 900) AS a FROM x), z AS (SELECT *, abs(w / 2 * cos(a)) + abs(h / 2 * sin(a)) AS dx, abs(w / 2 * sin(a)) + abs(h / 2 * cos(a)) AS dy FROM o) SELECT l_orderkey, l_linenumber, round(greatest(0, cx - dx), 4) AS l, round(greatest(0, cy - dy), 4) AS t FROM z")
def q50_region_bounds(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2 - 300, (F.col("y1") + F.col("y2")) / 2 - 200
    box = G.corners(*G.enclosing(cx, cy, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("l_discount") * 900))
    return boxes(spark, d).select("l_orderkey", "l_linenumber", F.round(F.greatest(box[0], F.lit(0.0)), 4).alias("l"), F.round(F.greatest(box[1], F.lit(0.0)), 4).alias("t"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def q42_streaming_answers(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, answered into JSON lines, and read again."""
    from skysift.streaming.answers import answer_stream, stream

    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = S.table(spark, d, "events").select("event_type", "value")
    table.write.parquet(f"{base}/in")
    answer_stream(stream(spark, f"{base}/in", table.schema), lambda b: b, f"{base}/out", f"{base}/state").awaitTermination()
    read = spark.read.schema(table.schema).json(f"{base}/out/*")
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
