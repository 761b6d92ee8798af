"""Clustering queries.

Vectors are the ``embeddings`` table (``vec_id`` = token id).  The OOV methods
(M2, M4) need removed tokens that have vectors; in the documents corpus the
removed (rare) tokens all have ids beyond the embedding table, so those two
run on the ``benchmark`` table as the task corpus (its rare words include
globally common ones), encoded with the documents vocabulary.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cluster import (cluster_removed, cluster_sizes, eps_clusters, kmeans, normalise,
                                 prune_by_cluster, representatives)
from ..operators.importance import count_texts, tfidf_importance, word_importance
from ..operators.rank import keep_by_percent, removed
from ..operators.remap import hybrid_lookup
from ..operators.tokens import texts, token_counts_from_words, words
from ..sources.corpus import table
from .common import Inputs
from .oracle_sql import STOP, doc_ctes, with_ctes
from .q_prune import P, sql_percent_map, sql_tfidf, train_counts, ctes as prune_ctes
from .registry import register

K_DEMO = 8
K_OOV = 50
SEED = 42
ROUNDS = 5


def vectors(inp: Inputs):
    return inp.table("embeddings").select(F.col("vec_id").cast("int").alias("token_id"),
                                          F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


PTS = r"""pts AS (
  SELECT CAST(vec_id AS INTEGER) AS token_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings)"""


def sql_kmeans(name: str, pts: str, k_expr: str, seed: int = SEED, rounds: int = ROUNDS) -> str:
    """Unrolled fixed-round k-means; final labels in ``{name}`` (token_id, v, cluster, d)."""
    out = [rf"""{name}_c0 AS (
  SELECT CAST(r - 1 AS INTEGER) AS cluster, v AS centre
  FROM (SELECT v, row_number() OVER (ORDER BY md5('{seed}:' || CAST(token_id AS VARCHAR)), token_id) AS r FROM {pts})
  WHERE r <= ({k_expr}))"""]

    def assign(i_from: int, tgt: str) -> str:
        return rf"""{tgt} AS (
  SELECT token_id, v, cluster, d FROM (
    SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY d, cluster) AS rn FROM (
      SELECT p.token_id, p.v, c.cluster,
             list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.centre[i]) * (p.v[i] - c.centre[i]))) AS d
      FROM {pts} p, {name}_c{i_from} c))
  WHERE rn = 1)"""
    for i in range(1, rounds + 1):
        out.append(assign(i - 1, f"{name}_a{i}"))
        out.append(rf"""{name}_m{i} AS (
  SELECT cluster, list(m ORDER BY pos) AS centre FROM (
    SELECT cluster, pos, avg(x) AS m
    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {name}_a{i})
    GROUP BY cluster, pos)
  GROUP BY cluster),
{name}_c{i} AS (
  SELECT * FROM {name}_m{i}
  UNION ALL SELECT * FROM {name}_c{i - 1} WHERE cluster NOT IN (SELECT cluster FROM {name}_m{i}))""")
    out.append(assign(rounds, name))
    return ",\n".join(out)


# ---------------------------------------------------------------- C1 / A22 / J8 / P18
@register("c1_kmeans", with_ctes(PTS, sql_kmeans("km", "pts", str(K_DEMO)),
                                 body="SELECT token_id, cluster FROM km"))
def c1_kmeans(spark, sf_dir):
    """Fixed-round k-means (k = 8, 5 rounds, md5-seeded centres) over all vectors."""
    lab, _ = kmeans(vectors(Inputs(spark, sf_dir)), K_DEMO, SEED, ROUNDS)
    return lab.select("token_id", "cluster")


@register("a22_cluster_sizes", with_ctes(PTS, sql_kmeans("km", "pts", str(K_DEMO)), body="""
SELECT size, count(*) AS clusters FROM (SELECT cluster, count(*) AS size FROM km GROUP BY cluster) GROUP BY size"""))
def a22_cluster_sizes(spark, sf_dir):
    """Distribution of k-means cluster sizes."""
    lab, _ = kmeans(vectors(Inputs(spark, sf_dir)), K_DEMO, SEED, ROUNDS)
    return cluster_sizes(lab).select(F.col("size").cast("long"), F.col("clusters").cast("long"))


@register("j8_representatives", with_ctes(PTS, sql_kmeans("km", "pts", str(K_DEMO)), body="""
SELECT cluster, CAST(arg_min(token_id, (d, token_id)) AS INTEGER) AS rep_id FROM km GROUP BY cluster"""))
def j8_representatives(spark, sf_dir):
    """Per k-means cluster the token nearest to the centre (ties: lowest id)."""
    lab, _ = kmeans(vectors(Inputs(spark, sf_dir)), K_DEMO, SEED, ROUNDS)
    return representatives(lab).select("cluster", F.col("rep_id").cast("int"))


@register("p18_l2_normalise", with_ctes(PTS, body="""
SELECT token_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))))
                       , 5) AS checksum FROM pts"""))
def p18_l2_normalise(spark, sf_dir):
    """Unit-length vectors (checksum = sum of the normalised components)."""
    n = normalise(vectors(Inputs(spark, sf_dir)))
    return n.select("token_id", F.round(F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x), 5)
                    .alias("checksum"))


# ---------------------------------------------------------------- C2
C2_SQL = "WITH RECURSIVE " + ",\n".join([PTS, r"""unit AS (
  SELECT token_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM pts),
edges AS (
  SELECT a.token_id AS a, b.token_id AS b FROM unit a, unit b
  WHERE a.token_id <> b.token_id
    AND 1 - list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) <= 0.3)""",
    """reach(a, b) AS (
  SELECT token_id, token_id FROM unit
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)"""]) + """
SELECT a AS token_id, CAST(dense_rank() OVER (ORDER BY min(b)) - 1 AS INTEGER) AS cluster FROM reach GROUP BY a"""


@register("c2_eps_clusters", C2_SQL)
def c2_eps_clusters(spark, sf_dir):
    """DBSCAN(cosine, eps 0.3, min 2) = components of the eps graph; noise -> own cluster.
    The oracle closes the graph with a recursive CTE."""
    return eps_clusters(vectors(Inputs(spark, sf_dir)), 0.3).select("token_id", "cluster")


# ---------------------------------------------------------------- C4 / M7
C4_SQL = with_ctes(*prune_ctes(), PTS, r"""cp AS (SELECT p.token_id, p.v FROM pts p WHERE p.token_id IN (SELECT token_id FROM cnts)),
cr AS (SELECT token_id, v, row_number() OVER (ORDER BY token_id) AS r FROM cp),
cn AS (SELECT count(*) AS n FROM cr),
spec AS (SELECT token_id, CAST(r - 1 AS INTEGER) AS new_id FROM cr WHERE r <= 5),
prun AS (SELECT token_id, v AS raw, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v
         FROM cr WHERE r > 5)""", sql_kmeans("ck", "prun", f"(SELECT (n - 5) - CAST(trunc(n * {P} / 100) AS BIGINT) FROM cn)"),
                   body=r"""
, rawm AS (
  SELECT cluster, list(m ORDER BY pos) AS centre FROM (
    SELECT cluster, pos, avg(x) AS m FROM (
      SELECT k.cluster, unnest(p.raw) AS x, generate_subscripts(p.raw, 1) AS pos FROM ck k JOIN prun p ON k.token_id = p.token_id)
    GROUP BY cluster, pos) GROUP BY cluster),
rd AS (
  SELECT k.cluster, k.token_id,
         list_sum(list_transform(range(1, len(p.raw) + 1), lambda i: (p.raw[i] - m.centre[i]) * (p.raw[i] - m.centre[i]))) AS d
  FROM ck k JOIN prun p ON k.token_id = p.token_id JOIN rawm m ON k.cluster = m.cluster),
reps AS (SELECT cluster, arg_min(token_id, (d, token_id)) AS rep FROM rd GROUP BY cluster)
SELECT token_id AS old_id, new_id FROM spec
UNION ALL SELECT CAST(rep AS INTEGER), CAST(4 + row_number() OVER (ORDER BY cluster) AS INTEGER) FROM reps""")


@register("m7_prune_clustering", C4_SQL)
def m7_prune_clustering(spark, sf_dir):
    """M7 = A1 -> P11 -> C4 (k-means on normalised vectors, 20 %) -> W5."""
    inp = Inputs(spark, sf_dir)
    keep = prune_by_cluster(train_counts(inp), vectors(inp), P, SEED, ROUNDS)
    return keep.select(F.col("token_id").alias("old_id"), "new_id")


# ---------------------------------------------------------------- C3 / C2a / C4 by other methods
def sql_linkage(name: str, pts: str, n: str) -> str:
    """Average linkage of ``pts (token_id, v)`` (unit vectors), the nearest pair joined one at a
    time until ``n`` clusters are left: ``{name}`` (token_id, cluster).  Needs WITH RECURSIVE."""
    best = f"SELECT a AS ma, b AS mb, na AS nma, nb AS nmb FROM {name}_s ORDER BY d, a, b LIMIT 1"
    return f"""{name}_n AS (SELECT greatest(count(*) - greatest(({n}), 1), 0) AS need FROM {pts}),
{name}_s(step, a, b, d, na, nb, ma, mb) AS (
  SELECT 0, x.token_id, y.token_id, 1 - list_inner_product(x.v, y.v), 1, 1, -1, -1
  FROM {pts} x JOIN {pts} y ON x.token_id < y.token_id
  UNION ALL
  SELECT step + 1, least(x, y), greatest(x, y), sum(d * w) / sum(w), CAST(any_value(CASE WHEN x < y THEN nx ELSE ny END) AS INTEGER),
         CAST(any_value(CASE WHEN x < y THEN ny ELSE nx END) AS INTEGER), any_value(ma), any_value(mb)
  FROM (SELECT s.step, s.d, m.ma, m.mb, CASE WHEN a = m.mb THEN m.ma ELSE a END AS x, CASE WHEN b = m.mb THEN m.ma ELSE b END AS y,
               CASE WHEN a = m.ma OR a = m.mb THEN na WHEN b = m.ma OR b = m.mb THEN nb ELSE 1 END AS w,
               CASE WHEN a = m.ma OR a = m.mb THEN nma + nmb ELSE na END AS nx,
               CASE WHEN b = m.ma OR b = m.mb THEN nma + nmb ELSE nb END AS ny
        FROM {name}_s s, ({best}) m
        WHERE NOT (a = m.ma AND b = m.mb) AND s.step < (SELECT need FROM {name}_n)) AS j
  GROUP BY step, least(x, y), greatest(x, y)),
{name}_m AS (SELECT DISTINCT step, ma AS a, mb AS b FROM {name}_s WHERE step > 0),
{name}_l(step, token_id, id) AS (
  SELECT 0, token_id, token_id FROM {pts}
  UNION ALL
  SELECT m.step, l.token_id, CASE WHEN l.id = m.b THEN m.a ELSE l.id END FROM {name}_l l JOIN {name}_m m ON m.step = l.step + 1),
{name} AS (SELECT token_id, CAST(dense_rank() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster
           FROM {name}_l WHERE step = (SELECT need FROM {name}_n))"""


UNIT = "unit AS (SELECT token_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM pts)"
K_MANY = 40


def recursive(*parts: str, body: str) -> str:
    return with_ctes(*parts, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


# SQL that joins one pair at a time takes minutes on the whole table: C3, and C4 by it, are tested
# against plain loops; C2a, which is C3 on fewer points, has SQL.
@register("c3_average_linkage")
def c3_average_linkage(spark, sf_dir):
    """Average linkage (cosine) of all vectors, cut at 80 % as many clusters."""
    from ..operators.linkage import average_linkage
    vecs = normalise(vectors(Inputs(spark, sf_dir)))
    return average_linkage(vecs, int(vecs.count() * 0.8)).select("token_id", "cluster")


@register("c2a_merge_clusters", recursive(PTS, UNIT, sql_kmeans("km", "unit", str(K_MANY)), r"""means AS (
  SELECT CAST(cluster AS INTEGER) AS token_id, list(m ORDER BY pos) AS c FROM (
    SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM km)
    GROUP BY cluster, pos) GROUP BY cluster),
cu AS (SELECT token_id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS v FROM means)""",
                                          sql_linkage("al", "cu", "SELECT 12"), body="""
SELECT km.token_id, al.cluster FROM km JOIN al ON km.cluster = al.token_id"""))
def c2a_merge_clusters(spark, sf_dir):
    """K-means clusters (k = 40) of the directions merged to 12 by average linkage of their means."""
    from ..operators.linkage import merge_clusters
    vecs = normalise(vectors(Inputs(spark, sf_dir)))
    labels, _ = kmeans(vecs, K_MANY, SEED, ROUNDS)
    return merge_clusters(labels, vecs, 12).select("token_id", "cluster")


@register("c4_agglomerative")
def c4_agglomerative(spark, sf_dir):
    """C4 with average linkage (the usual method): 20 % of the train tokens pruned."""
    inp = Inputs(spark, sf_dir)
    keep = prune_by_cluster(train_counts(inp), vectors(inp), P, SEED, ROUNDS, method="agglomerative")
    return keep.select(F.col("token_id").alias("old_id"), "new_id")


@register("c4_dbscan")
def c4_dbscan(spark, sf_dir):
    """C4 with eps-graph clusters, merged (C2a) to the number wanted."""
    inp = Inputs(spark, sf_dir)
    keep = prune_by_cluster(train_counts(inp), vectors(inp), P, SEED, ROUNDS, method="dbscan")
    return keep.select(F.col("token_id").alias("old_id"), "new_id")


# ---------------------------------------------------------------- C5 / C6 / J2 / M2 / M4 (benchmark corpus)
def bench_counts(inp: Inputs):
    b = table(inp.spark, inp.sf_dir, "benchmark").select(
        F.col("item_id").alias("example_id"), F.lit("train").alias("split"), F.col("text").alias("text_a"),
        F.lit(None).cast("string").alias("text_b"), F.lit(-1.0).alias("label"))
    return b, token_counts_from_words(words(texts(b), add_special_tokens=True), inp.vocab())


BENCH = r"""bcorpus AS (
  SELECT item_id AS example_id, 'train' AS split, text AS text_a, CAST(NULL AS VARCHAR) AS text_b,
         CAST(-1 AS DOUBLE) AS label FROM benchmark),
btexts AS (SELECT example_id, split, label, 'a' AS side, text_a AS text FROM bcorpus WHERE text_a IS NOT NULL),
bwords AS (
  SELECT example_id, split, label, side, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM btexts)),
bswords AS (
  SELECT example_id, side, unnest(w) AS word
  FROM (SELECT *, list_concat(['[CLS]'], regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ['[SEP]']) AS w FROM btexts)),
bcnts AS (
  SELECT CAST(coalesce(v.token_id, 0) AS INTEGER) AS token_id, count(*) AS cnt
  FROM bswords s LEFT JOIN vocab v ON s.word = v.word GROUP BY 1)"""


def _oov_sql(keep_cte: str, keep_sql: str, mode: str) -> str:
    body_intended = """
SELECT token_id AS old_id, new_id FROM keep2
UNION ALL
SELECT o.token_id, k.new_id FROM oov o JOIN keep2 k ON o.rep_id = k.token_id
WHERE o.token_id NOT IN (SELECT token_id FROM keep2)"""
    body_shipped = """
, over AS (SELECT token_id, rep_id AS new_id FROM oov),
sz AS (SELECT count(*) AS n FROM keep2)
SELECT token_id AS old_id, CAST(least(greatest(new_id, 0), (SELECT n FROM sz) - 1) AS INTEGER) AS new_id FROM (
  SELECT token_id, new_id FROM keep2 WHERE token_id NOT IN (SELECT token_id FROM over)
  UNION ALL SELECT token_id, new_id FROM over)"""
    return with_ctes(*doc_ctes(STOP), BENCH, keep_sql, PTS, rf"""removed AS (
  SELECT token_id FROM bcnts WHERE token_id NOT IN (SELECT token_id FROM {keep_cte})),
rpts AS (SELECT p.token_id, p.v FROM pts p WHERE p.token_id IN (SELECT token_id FROM removed))""",
                     sql_kmeans("ok", "rpts", f"(SELECT least({K_OOV}, count(*)) FROM rpts)"), rf"""reps AS (
  SELECT cluster, CAST(arg_min(token_id, (d, token_id)) AS INTEGER) AS rep_id FROM ok GROUP BY cluster),
oov AS (SELECT o.token_id, r.rep_id FROM ok o JOIN reps r ON o.cluster = r.cluster),
keep2 AS (
  SELECT token_id, new_id FROM {keep_cte}
  UNION ALL
  SELECT rep_id, CAST((SELECT count(*) FROM {keep_cte}) + row_number() OVER (ORDER BY cluster) - 1 AS INTEGER)
  FROM reps WHERE rep_id NOT IN (SELECT token_id FROM {keep_cte}))""",
                     body=body_intended if mode == "intended" else body_shipped)


BFMAP = sql_percent_map("bfmap", "bcnts", "cnt")


def _oov_method(spark, sf_dir, score: str, mode: str = "intended"):
    inp = Inputs(spark, sf_dir)
    corpus, counts = bench_counts(inp)
    if score == "importance":
        tf = tfidf_importance(texts(corpus), count_texts(texts(corpus)), 3)
        counts = word_importance(counts, inp.vocab(), tf).select(
            "token_id", F.round("importance", 6).alias("importance"))
    keep = keep_by_percent(counts, P, score=score)
    oov, keep2 = cluster_removed(removed(counts, keep), keep, vectors(inp), K_OOV, SEED, ROUNDS)
    return hybrid_lookup(keep2, oov, mode).select(F.col("token_id").alias("old_id"), F.col("new_id").cast("int"))


@register("m2_prune_frequency_oov", _oov_sql("bfmap", BFMAP, "intended"))
def m2_prune_frequency_oov(spark, sf_dir):
    """M2 = M1 ranking -> J6 -> P11 -> C5 (k-means of removed tokens, k = 50) -> U4 -> C6 hybrid map."""
    return _oov_method(spark, sf_dir, "cnt")


@register("j2_remap_as_shipped", _oov_sql("bfmap", BFMAP, "as_shipped"))
def j2_remap_as_shipped(spark, sf_dir):
    """J2 ``as_shipped``: the hybrid map overwritten with representatives' original ids, clamped."""
    return _oov_method(spark, sf_dir, "cnt", "as_shipped")


BIMP = sql_tfidf("btf", 3).replace("FROM texts WHERE split = 'train'", "FROM btexts") \
    .replace("FROM words\n  WHERE split = 'train' AND", "FROM bwords\n  WHERE")
BIMAP = BIMP + r""",
bimp AS (
  SELECT c.token_id, round(coalesce(t.tfidf, CAST(c.cnt AS DOUBLE)), 6) AS importance
  FROM bcnts c LEFT JOIN vocab v ON c.token_id = v.token_id LEFT JOIN btf t ON v.word = t.word),
""" + sql_percent_map("bimap", "bimp", "importance")


@register("m4_prune_importance_oov", _oov_sql("bimap", BIMAP, "intended"))
def m4_prune_importance_oov(spark, sf_dir):
    """M4 = M3 ranking -> C5 -> U4 -> C6 hybrid map."""
    return _oov_method(spark, sf_dir, "importance")


def _c2b_sql(target: int = 12, rounds: int = ROUNDS) -> str:
    parts = [PTS, sql_kmeans("km", "pts", str(K_DEMO)), f"""sizes AS (SELECT cluster, count(*) AS size FROM km GROUP BY cluster),
ch AS (
  SELECT cluster, o FROM (
    SELECT cluster, row_number() OVER (ORDER BY size DESC, cluster DESC) AS o FROM sizes WHERE size >= 2)
  WHERE o <= {target} - (SELECT count(*) FROM sizes)),
sp AS (SELECT k.token_id, k.v, k.cluster, ch.o FROM km k JOIN ch ON k.cluster = ch.cluster),
s_c0 AS (
  SELECT cluster, r - 1 AS sub, v AS centre FROM (
    SELECT cluster, v, row_number() OVER (PARTITION BY cluster ORDER BY md5('{SEED}:' || CAST(token_id AS VARCHAR)), token_id) AS r
    FROM sp)
  WHERE r <= 2)"""]
    for i in range(1, rounds + 2):
        parts.append(f"""s_a{i} AS (
  SELECT token_id, v, cluster, o, sub FROM (
    SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY d, sub) AS rn FROM (
      SELECT p.token_id, p.v, p.cluster, p.o, c.sub,
             list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.centre[i]) * (p.v[i] - c.centre[i]))) AS d
      FROM sp p JOIN s_c{i - 1} c ON p.cluster = c.cluster))
  WHERE rn = 1),
s_m{i} AS (
  SELECT cluster, sub, list(m ORDER BY pos) AS centre FROM (
    SELECT cluster, sub, pos, avg(x) AS m
    FROM (SELECT cluster, sub, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM s_a{i})
    GROUP BY cluster, sub, pos)
  GROUP BY cluster, sub),
s_c{i} AS (
  SELECT * FROM s_m{i}
  UNION ALL SELECT * FROM s_c{i - 1} c WHERE NOT EXISTS (
    SELECT 1 FROM s_m{i} m WHERE m.cluster = c.cluster AND m.sub = c.sub))""")
    last = rounds + 1
    body = f"""
SELECT token_id, cluster FROM km WHERE cluster NOT IN (SELECT cluster FROM ch)
UNION ALL
SELECT token_id, CAST(CASE WHEN sub = 1 THEN (SELECT max(cluster) FROM km) + o ELSE cluster END AS INTEGER)
FROM s_a{last}"""
    return with_ctes(*parts, body=body)


@register("c2b_split_clusters", _c2b_sql())
def c2b_split_clusters(spark, sf_dir):
    """The k-means clusters (k = 8) grown to 12 by splitting the largest ones
    with 2-means (the oracle unrolls the rounds)."""
    from ..operators.cluster import split_clusters
    vecs = vectors(Inputs(spark, sf_dir))
    lab, _ = kmeans(vecs, K_DEMO, SEED, ROUNDS)
    return split_clusters(lab, vecs, 12, SEED)
