"""Pruning queries: rankings, budgets, token maps, remaps, reports.

The pruning corpus is the ``train`` split of the documents corpus encoded with
specials (every text adds one CLS and one SEP).  Model shape for the parameter
figures: ``V`` vocabulary rows (from the data), ``DIM`` = 64 (the width of the
``embeddings`` table) and ``BODY_FACTOR * V * DIM`` non-embedding weights.
"""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.text import SPECIAL_TOKENS
from ..operators.importance import count_texts, tfidf_importance, word_importance
from ..operators.ordering import stored
from ..operators.rank import (keep_by_parameters, keep_by_percent, keep_random, removed, sorted_map)
from ..operators.remap import reduction_report, remap, truncation_map, valid_ids
from ..operators.tokens import encode_texts
from ..sources.corpus import scan_embeddings
from .common import Inputs
from .oracle_sql import STOP, doc_ctes, with_ctes
from .registry import register

P = 20.0
SEED = 42
DIM = 64
BODY_FACTOR = 3


def r6(c):
    return F.round(c, 6)


def train_corpus(inp: Inputs):
    return inp.text_corpus().filter(F.col("split") == "train")


def train_counts(inp: Inputs):
    """A2 on the pruning corpus: ``(token_id, cnt)``, materialised once per session
    because the budgets, rankings and reports of every method read it (the
    methods rank by count; document frequency is computed where it is reported)."""
    return inp.shared("train_counts", lambda: train_words(inp).join(inp.vocab(), "word").select("token_id", "cnt"))


def train_words(inp: Inputs):
    """``(word, cnt, df)`` of the train split, from the shared counts."""
    return inp.split_words().filter(F.col("split") == "train").drop("split")


def as_map(tm):
    return tm.select(F.col("token_id").cast("int").alias("old_id"), F.col("new_id").cast("int"))


# ---------------------------------------------------------------- SQL pieces
CNTS = r"""cnts AS (
  SELECT token_id, count(*) AS cnt, count(DISTINCT CAST(example_id AS VARCHAR) || ':' || side) AS df
  FROM tokens WHERE split = 'train' GROUP BY token_id)"""


def sql_percent_map(name: str, scores: str, score: str, p: float = P) -> str:
    """Token-budget keep list over ``scores(token_id, <score>)`` as CTE ``name``."""
    return rf"""{name}_k AS (
  SELECT greatest(5, CAST(trunc((count(*) - 5) * (1 - CAST({p} AS DOUBLE) / 100)) AS BIGINT)) AS k FROM {scores}),
{name}_r AS (
  SELECT token_id, row_number() OVER (ORDER BY {score} DESC, token_id) AS rank
  FROM {scores} WHERE token_id NOT IN (0, 1, 2, 3, 4)),
{name} AS (
  SELECT CAST(token_id AS INTEGER) AS token_id, CAST(rank + 4 AS INTEGER) AS new_id
  FROM {name}_r WHERE rank <= (SELECT k FROM {name}_k)
  UNION ALL SELECT CAST(range AS INTEGER), CAST(range AS INTEGER) FROM range(5))"""


FMAP = sql_percent_map("fmap", "cnts", "cnt")

RMAP = rf"""rmap_k AS (
  SELECT greatest(5, CAST(trunc(count(*) * (1 - CAST({P} AS DOUBLE) / 100)) AS BIGINT)) AS k
  FROM cnts WHERE token_id NOT IN (0, 1, 2, 3, 4)),
rmap_r AS (
  SELECT token_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(token_id AS VARCHAR)), token_id) AS rank
  FROM cnts WHERE token_id NOT IN (0, 1, 2, 3, 4)),
rmap AS (
  SELECT CAST(token_id AS INTEGER) AS token_id, CAST(rank + 4 AS INTEGER) AS new_id
  FROM rmap_r WHERE rank <= (SELECT k FROM rmap_k)
  UNION ALL SELECT CAST(range AS INTEGER), CAST(range AS INTEGER) FROM range(5))"""

PMAP = rf"""pb AS (
  SELECT (SELECT count(*) FROM cnts) AS n,
         (SELECT count(*) FROM cnts WHERE token_id NOT IN (0, 1, 2, 3, 4)) AS ns,
         (SELECT v FROM vsize) AS v),
pb2 AS (SELECT n, ns, (v - n) * {DIM} AS red, ({BODY_FACTOR} + 1) * v * {DIM} AS total FROM pb),
pk AS (
  SELECT 100 * (red / CAST(total AS DOUBLE)) >= {P} AS keep_all,
         greatest(5, ns - least(CAST(trunc((CAST({P} AS DOUBLE) / 100 * total - red) / {DIM}) AS BIGINT), ns)) AS k
  FROM pb2),
pmap_r AS (
  SELECT token_id, row_number() OVER (ORDER BY cnt DESC, token_id) AS rank
  FROM cnts WHERE token_id NOT IN (0, 1, 2, 3, 4)),
pmap_all AS (
  SELECT token_id, row_number() OVER (ORDER BY cnt DESC, token_id) AS rank FROM cnts),
pmap AS (
  SELECT CAST(token_id AS INTEGER) AS token_id, CAST(rank + 4 AS INTEGER) AS new_id
  FROM pmap_r WHERE NOT (SELECT keep_all FROM pk) AND rank <= (SELECT k FROM pk)
  UNION ALL SELECT CAST(range AS INTEGER), CAST(range AS INTEGER) FROM range(5) WHERE NOT (SELECT keep_all FROM pk)
  UNION ALL SELECT CAST(token_id AS INTEGER), CAST(rank - 1 AS INTEGER) FROM pmap_all WHERE (SELECT keep_all FROM pk))"""

TMAP = r"""tmap AS (
  SELECT CAST(token_id AS INTEGER) AS token_id, CAST(row_number() OVER (ORDER BY token_id) - 1 AS INTEGER) AS new_id
  FROM cnts)"""


def sql_tfidf(name: str, itype: int, texts_where: str = "split = 'train'") -> str:
    norm = {3: "w / sqrt(sum(w * w) OVER (PARTITION BY example_id, side))",
            2: "w / sum(abs(w)) OVER (PARTITION BY example_id, side)",
            1: "w"}[itype]
    return rf"""{name}_n AS (SELECT count(*) AS n FROM texts WHERE {texts_where}),
{name}_tf AS (
  SELECT example_id, side, word, count(*) AS tf FROM words
  WHERE {texts_where} AND word NOT IN (SELECT word FROM stop) GROUP BY example_id, side, word),
{name}_df AS (SELECT word, count(*) AS df FROM {name}_tf GROUP BY word),
{name}_w AS (
  SELECT t.example_id, t.side, t.word,
         t.tf * (ln((1 + (SELECT CAST(n AS DOUBLE) FROM {name}_n)) / (1 + d.df)) + 1) AS w
  FROM {name}_tf t JOIN {name}_df d ON t.word = d.word),
{name} AS (
  SELECT word, sum(nw) / (SELECT CAST(n AS DOUBLE) FROM {name}_n) AS tfidf
  FROM (SELECT word, {norm} AS nw FROM {name}_w) GROUP BY word)"""


IMP = r"""imp AS (
  SELECT c.token_id, round(coalesce(t.tfidf, CAST(c.cnt AS DOUBLE)), 6) AS importance
  FROM cnts c LEFT JOIN vocab v ON c.token_id = v.token_id LEFT JOIN tfidf3 t ON v.word = t.word)"""

IMAP = sql_percent_map("imap", "imp", "importance")


def ctes(*extra):
    return doc_ctes(STOP, CNTS, *extra)


# ---------------------------------------------------------------- A1
@register("a1_vocabulary", with_ctes(*ctes(), body="SELECT DISTINCT token_id FROM cnts"))
def a1_vocabulary(spark, sf_dir):
    """A1: distinct token ids of the pruning corpus."""
    return train_counts(Inputs(spark, sf_dir)).select("token_id")


# ---------------------------------------------------------------- M1 / W2 / W5
@register("m1_prune_frequency", with_ctes(*ctes(FMAP), body="SELECT token_id AS old_id, new_id FROM fmap"))
def m1_prune_frequency(spark, sf_dir):
    """M1 = A2 -> W1 -> W2 -> W5: frequency token map at a 20 % token budget."""
    return as_map(keep_by_percent(train_counts(Inputs(spark, sf_dir)), P))


@register("j6_removed", with_ctes(*ctes(FMAP), body="""
SELECT token_id FROM cnts WHERE token_id NOT IN (SELECT token_id FROM fmap)"""))
def j6_removed(spark, sf_dir):
    """Corpus tokens removed by the frequency budget (left-anti join)."""
    c = train_counts(Inputs(spark, sf_dir))
    return removed(c, keep_by_percent(c, P)).select("token_id")


@register("w3_prune_parameters", with_ctes(*ctes(PMAP), body="SELECT token_id AS old_id, new_id FROM pmap"))
def w3_prune_parameters(spark, sf_dir):
    """Frequency ranking under a 20 % parameter budget."""
    inp = Inputs(spark, sf_dir)
    v = inp.vocab_rows()
    return as_map(keep_by_parameters(train_counts(inp), P, v, DIM, (BODY_FACTOR + 1) * v * DIM))


@register("m5_prune_random", with_ctes(*ctes(RMAP), body="SELECT token_id AS old_id, new_id FROM rmap"))
def m5_prune_random(spark, sf_dir):
    """M5 = W4 -> W5: seeded random keep list (md5 order, seed 42) at 20 %."""
    return as_map(keep_random(train_counts(Inputs(spark, sf_dir)), P, SEED))


@register("m8_train_only", with_ctes(*ctes(TMAP), body="SELECT token_id AS old_id, new_id FROM tmap"))
def m8_train_only(spark, sf_dir):
    """M8 = A1 -> W5: every corpus token kept, re-indexed in ascending id order."""
    return as_map(sorted_map(train_counts(Inputs(spark, sf_dir))))


# ---------------------------------------------------------------- A4 / J7 / M3
def _tfidf(inp: Inputs, itype: int):
    """Mean TF-IDF of the train split, materialised once per session (the
    importance methods, their OOV variants and the reports all read it)."""
    rows = inp.texts(train_corpus(inp))
    return inp.shared(f"tfidf{itype}", lambda: tfidf_importance(
        rows, count_texts(rows), itype, counts=train_words(inp).filter(~F.col("word").isin(list(SPECIAL_TOKENS)))))


for _t in (1, 2, 3):
    def _mk(itype):
        @register(f"a4_tfidf_type{itype}", with_ctes(*ctes(sql_tfidf("tf", itype)),
                                                     body="SELECT word, round(tfidf, 6) AS tfidf FROM tf"))
        def q(spark, sf_dir):
            """A4: mean TF-IDF per word (type 1 raw, 2 L1, 3 L2 norm)."""
            t = _tfidf(Inputs(spark, sf_dir), itype)
            return t.select("word", r6(F.col("tfidf")).alias("tfidf"))
        return q
    _mk(_t)


def importance_scores(inp: Inputs):
    c = train_counts(inp)
    imp = word_importance(c, inp.vocab(), _tfidf(inp, 3))
    return imp.select("token_id", r6(F.col("importance")).alias("importance"))


def _materialised(sql: str, *names: str) -> str:
    """Shared CTEs that DuckDB computes once."""
    for n in names:
        sql = sql.replace(f"{n} AS (", f"{n} AS MATERIALIZED (", 1)
    return sql


@register("j7_word_importance", _materialised(with_ctes(*ctes(sql_tfidf("tfidf3", 3), IMP), body="""
SELECT token_id, importance FROM imp"""), "vocab", "tokens", "cnts", "tfidf3_tf", "tfidf3_df", "tfidf3"))
def j7_word_importance(spark, sf_dir):
    """Token -> word -> mean TF-IDF, else the token's count (mixed scales, as shipped)."""
    return importance_scores(Inputs(spark, sf_dir))


@register("m3_prune_importance", with_ctes(*ctes(sql_tfidf("tfidf3", 3), IMP, IMAP),
                                           body="SELECT token_id AS old_id, new_id FROM imap"))
def m3_prune_importance(spark, sf_dir):
    """M3 = A2 + A4 -> J7 -> W1 -> W2 -> W5: TF-IDF token map at 20 %."""
    return as_map(keep_by_percent(importance_scores(Inputs(spark, sf_dir)), P, score="importance"))


# ---------------------------------------------------------------- A11
REPORT_SQL = with_ctes(*ctes(FMAP, RMAP, PMAP, TMAP, sql_tfidf("tfidf3", 3), IMP, IMAP), body=rf"""
, maps AS (
  SELECT 'frequency' AS method, new_id FROM fmap UNION ALL SELECT 'random', new_id FROM rmap
  UNION ALL SELECT 'parameters', new_id FROM pmap UNION ALL SELECT 'train_only', new_id FROM tmap
  UNION ALL SELECT 'importance', new_id FROM imap),
k AS (SELECT method, count(DISTINCT new_id) AS kept FROM maps GROUP BY method),
s AS (SELECT v, (SELECT count(*) FROM cnts) AS n FROM vsize)
SELECT method, CAST(kept AS BIGINT) AS kept_tokens,
  round((1 - kept / CAST(v AS DOUBLE)) * 100, 6) AS vocab_reduction_pct,
  round((v * {DIM} - kept * {DIM}) / CAST(v * {DIM} AS DOUBLE) * 100, 6) AS embedding_reduction_pct,
  round(((v * {DIM} + {BODY_FACTOR} * v * {DIM}) - (kept * {DIM} + {BODY_FACTOR} * v * {DIM}))
        / CAST(v * {DIM} + {BODY_FACTOR} * v * {DIM} AS DOUBLE) * 100, 6) AS total_reduction_pct,
  0.0 AS model_only_reduction_pct,
  CAST((v - kept) * {DIM} AS BIGINT) AS removed_params,
  round((1 - n / CAST(v AS DOUBLE)) * 100, 6) AS train_only_reduction_pct
FROM k, s""")


@register("a11_reduction_report", REPORT_SQL)
def a11_reduction_report(spark, sf_dir):
    """A11 (+A10): vocabulary / embedding / total reduction of five methods' token maps."""
    inp = Inputs(spark, sf_dir)
    v = inp.vocab_rows()
    c = train_counts(inp)
    n = int(c.count())
    body = BODY_FACTOR * v * DIM
    maps = {
        "frequency": keep_by_percent(c, P),
        "random": keep_random(c, P, SEED),
        "parameters": keep_by_parameters(c, P, v, DIM, v * DIM + body),
        "train_only": sorted_map(c),
        "importance": keep_by_percent(importance_scores(inp), P, score="importance"),
    }
    out = None
    for name, tm in maps.items():
        rep = reduction_report(tm, v, DIM, body, corpus_tokens=n).select(F.lit(name).alias("method"), "*")
        out = rep if out is None else out.unionByName(rep)
    return out.select(*[r6(F.col(c_)).alias(c_) if c_.endswith("_pct") else F.col(c_) for c_ in out.columns])


# ---------------------------------------------------------------- J1 / J4 / J5 / P11
J1_SQL = with_ctes(*ctes(FMAP), body="""
SELECT t.example_id, t.side,
       string_agg(CAST(coalesce(m.new_id, 0) AS VARCHAR), ',' ORDER BY t.pos) AS ids
FROM tokens t LEFT JOIN fmap m ON t.token_id = m.token_id GROUP BY t.example_id, t.side""")


def _encoded(inp: Inputs):
    """P3 on the whole documents corpus: ``(example_id, side, split, label, input_ids)``."""
    return encode_texts(inp.texts(), inp.vocab(), inp.vocab_rows(), add_special_tokens=True)


def _j1(spark, sf_dir, strategy):
    inp = Inputs(spark, sf_dir)
    tm = keep_by_percent(train_counts(inp), P)
    out = remap(_encoded(inp), tm, strategy=strategy, together=False)
    return out.select("example_id", "side", F.array_join("input_ids", ",").alias("ids"))


@register("j1_remap_join", J1_SQL)
def j1_remap_join(spark, sf_dir):
    """J1 (+P3): whole corpus rewritten with the frequency map; explode + join + rebuild."""
    return _j1(spark, sf_dir, "join")


@register("j1_remap_map", J1_SQL)
def j1_remap_map(spark, sf_dir):
    """J1 (+P3): same result through a size-checked dense lookup row and ``transform`` (no shuffle)."""
    return _j1(spark, sf_dir, "map")


@register("p3_encode", with_ctes(*ctes(), body="""
SELECT example_id, side, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) AS ids
FROM tokens GROUP BY example_id, side"""))
def p3_encode(spark, sf_dir):
    """Every text encoded to ids (CLS ... SEP), unknown words -> UNK."""
    e = _encoded(Inputs(spark, sf_dir))
    return e.select("example_id", "side", F.array_join("input_ids", ",").alias("ids"))


@register("j4_truncation_map", with_ctes(*ctes(), body="""
SELECT token_id AS old_id, CAST(CASE WHEN token_id < 1000 THEN token_id ELSE 0 END AS INTEGER) AS new_id FROM vocab"""))
def j4_truncation_map(spark, sf_dir):
    """Identity below k = 1000, else 0, over the whole vocabulary."""
    return as_map(truncation_map(Inputs(spark, sf_dir).vocab(), 1000))


J5_SQL = with_ctes(*ctes(FMAP), body="""
SELECT m.new_id, CAST(e.vec_id AS INTEGER) AS old_id,
       round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 5) AS checksum
FROM fmap m JOIN embeddings e ON m.token_id = e.vec_id""")


@register("j5_reduce_embeddings", J5_SQL)
def j5_reduce_embeddings(spark, sf_dir):
    """J5 (+P11): reduced embedding rows (new id order) of the frequency keep list."""
    inp = Inputs(spark, sf_dir)
    tm = keep_by_percent(train_counts(inp), P)
    emb = scan_embeddings(spark, sf_dir)
    red = tm.join(emb, "token_id", "inner").select(
        "new_id", F.col("token_id").alias("old_id"),
        F.round(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 5)
        .alias("checksum"))
    return red


@register("p11_valid_ids", with_ctes(*ctes(), body="""
SELECT token_id, (SELECT count(*) FROM cnts WHERE token_id NOT IN (SELECT CAST(vec_id AS INTEGER) FROM embeddings)) AS n_dropped
FROM cnts WHERE token_id IN (SELECT CAST(vec_id AS INTEGER) FROM embeddings)"""))
def p11_valid_ids(spark, sf_dir):
    """Corpus ids that have an embedding row, and the number of those that have none,
    observed by the same job."""
    dropped = Observation("p11")
    kept = stored(valid_ids(train_counts(Inputs(spark, sf_dir)), scan_embeddings(spark, sf_dir), dropped)
                  .select("token_id"), "valid-ids")
    return kept.withColumn("n_dropped", F.lit(dropped.get["n_dropped"]).cast("long"))
