"""Split and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.split import kfold, label_distribution, split3, split_train_test
from .common import Inputs
from .oracle_sql import CORPUS, with_ctes
from .registry import register

SEED = 42


def _pool(inp: Inputs, splits):
    return inp.corpus().filter(F.col("split").isin(list(splits))).select("example_id", "label")


def sql_take_first(name: str, pool: str, nd_expr: str, seed: int, stratified: bool = True) -> str:
    """CTE ``name``: rows of ``pool`` with ``is_first`` (the first ``nd`` rows)."""
    if not stratified:
        return rf"""{name}_nd AS (SELECT {nd_expr.replace('sum(n_c)', 'count(*)')} AS nd FROM {pool}),
{name} AS (
  SELECT p.*, row_number() OVER (ORDER BY md5('{seed}:' || CAST(p.example_id AS VARCHAR)), p.example_id)
              <= (SELECT nd FROM {name}_nd) AS is_first
  FROM {pool} p)"""
    return rf"""{name}_cc AS (SELECT label, count(*) AS n_c FROM {pool} GROUP BY label),
{name}_nd AS (SELECT {nd_expr} AS nd, sum(n_c) AS n FROM {name}_cc),
{name}_a0 AS (SELECT c.label, CAST(c.n_c * d.nd AS DOUBLE) / d.n AS cont, d.nd FROM {name}_cc c, {name}_nd d),
{name}_a1 AS (SELECT label, floor(cont) AS fl, cont - floor(cont) AS rem, nd FROM {name}_a0),
{name}_a AS (
  SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= nd - sum(fl) OVER () THEN 1 ELSE 0 END AS q
  FROM {name}_a1),
{name} AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.label ORDER BY md5('{seed}:' || CAST(p.example_id AS VARCHAR)), p.example_id)
              <= a.q AS is_first
  FROM {pool} p JOIN {name}_a a ON p.label = a.label)"""


def floor_of(ratio: str) -> str:
    return f"CAST(floor(CAST({ratio} AS DOUBLE) * sum(n_c)) AS BIGINT)"


def ceil_rest(ratio: str) -> str:
    return f"sum(n_c) - CAST(ceil(CAST({ratio} AS DOUBLE) * sum(n_c)) AS BIGINT)"


# ---------------------------------------------------------------- D2
D2_SQL = with_ctes(CORPUS,
                   "pool AS (SELECT example_id, label FROM corpus WHERE split = 'train')",
                   sql_take_first("s", "pool", floor_of("0.9"), SEED), body="""
SELECT example_id, CASE WHEN is_first THEN 'train' ELSE 'test' END AS part FROM s
UNION ALL SELECT example_id, 'validation' FROM corpus WHERE split = 'validation'""")


def d2_parts(inp: Inputs):
    s = split_train_test(_pool(inp, ["train"]), 0.9, SEED)
    val = inp.corpus().filter(F.col("split") == "validation").select("example_id", "label",
                                                                    F.lit("validation").alias("part"))
    return s.unionByName(val)


@register("d2_split_train_test", D2_SQL)
def d2_split_train_test(spark, sf_dir):
    """Keep the validation split, stratified 0.9 / 0.1 train / test of the train split."""
    return d2_parts(Inputs(spark, sf_dir)).select("example_id", "part")


@register("a9_label_distribution", with_ctes(CORPUS,
                                             "pool AS (SELECT example_id, label FROM corpus WHERE split = 'train')",
                                             sql_take_first("s", "pool", floor_of("0.9"), SEED), body="""
, parts AS (
  SELECT example_id, label, CASE WHEN is_first THEN 'train' ELSE 'test' END AS part FROM s
  UNION ALL SELECT example_id, label, 'validation' FROM corpus WHERE split = 'validation'),
grid AS (SELECT p.part, l.label FROM (SELECT DISTINCT part FROM parts) p, (SELECT DISTINCT label FROM parts) l),
c AS (SELECT part, label, count(*) AS n FROM parts GROUP BY part, label),
t AS (SELECT part, count(*) AS tot FROM parts GROUP BY part)
SELECT g.part, g.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n, round(coalesce(c.n, 0) / CAST(t.tot AS DOUBLE) * 100, 6) AS pct
FROM grid g LEFT JOIN c ON g.part = c.part AND g.label = c.label JOIN t ON g.part = t.part"""))
def a9_label_distribution(spark, sf_dir):
    """Label counts and percentages per part of the D2 split, missing classes as 0."""
    d = label_distribution(d2_parts(Inputs(spark, sf_dir)))
    return d.withColumn("pct", F.round("pct", 6))


# ---------------------------------------------------------------- D1 / D3
def _split3_sql(stratified: bool) -> str:
    adj = "CAST(0.1 AS DOUBLE) / (CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE))"
    return with_ctes(
        CORPUS,
        "pool AS (SELECT example_id, label FROM corpus WHERE split IN ('train', 'validation'))",
        sql_take_first("s1", "pool", floor_of("0.8"), SEED, stratified),
        "rest AS (SELECT example_id, label FROM s1 WHERE NOT is_first)",
        sql_take_first("s2", "rest", floor_of(adj), SEED, stratified), body="""
SELECT example_id, 'train' AS part FROM s1 WHERE is_first
UNION ALL SELECT example_id, CASE WHEN is_first THEN 'validation' ELSE 'test' END FROM s2""")


@register("d1_split3", _split3_sql(True))
def d1_split3(spark, sf_dir):
    """D1 (+U1): train + validation pooled, stratified 0.8 / 0.1 / 0.1."""
    pool = _pool(Inputs(spark, sf_dir), ["train", "validation"])
    return split3(pool, (0.8, 0.1, 0.1), SEED).select("example_id", "part")


@register("d3_split_unstratified", _split3_sql(False))
def d3_split_unstratified(spark, sf_dir):
    """D3: the same three-way split without stratification (regression / unlabelled)."""
    pool = _pool(Inputs(spark, sf_dir), ["train", "validation"])
    return split3(pool, (0.8, 0.1, 0.1), SEED, label=None).select("example_id", "part")


# ---------------------------------------------------------------- D4 / D5
def _kfold_sql(stratified: bool) -> str:
    if stratified:
        folds = f"""
, off AS (SELECT label, coalesce(sum(n_c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
          FROM (SELECT label, count(*) AS n_c FROM trainpool GROUP BY label)),
fk AS (
  SELECT t.example_id, CAST(((o.o + row_number() OVER (PARTITION BY t.label
           ORDER BY md5('{SEED + 1}:' || CAST(t.example_id AS VARCHAR)), t.example_id) - 1) % 5) AS INTEGER) AS fold
  FROM trainpool t JOIN off o ON t.label = o.label)"""
    else:
        folds = f"""
, nn AS (SELECT count(*) AS n, count(*) // 5 AS q, count(*) % 5 AS m FROM trainpool),
rk AS (SELECT example_id, row_number() OVER (ORDER BY md5('{SEED + 1}:' || CAST(example_id AS VARCHAR)), example_id) - 1 AS pos
       FROM trainpool),
fk AS (
  SELECT example_id, CAST(CASE WHEN pos < m * (q + 1) THEN floor(pos / (q + 1))
                               ELSE m + floor((pos - m * (q + 1)) / greatest(q, 1)) END AS INTEGER) AS fold
  FROM rk, nn)"""
    return with_ctes(
        CORPUS,
        "pool AS (SELECT example_id, label FROM corpus WHERE split IN ('train', 'validation'))",
        sql_take_first("s", "pool", ceil_rest("0.1"), SEED, stratified),
        "trainpool AS (SELECT example_id, label FROM s WHERE is_first)", body=folds + """
SELECT example_id, 'test' AS part, CAST(NULL AS INTEGER) AS fold FROM s WHERE NOT is_first
UNION ALL SELECT example_id, 'train', fold FROM fk""")


@register("d4_kfold", _kfold_sql(True))
def d4_kfold(spark, sf_dir):
    """Stratified hold-out test (10 %) and stratified 5 folds of the rest."""
    pool = _pool(Inputs(spark, sf_dir), ["train", "validation"])
    return kfold(pool, 5, 0.1, SEED).select("example_id", "part", "fold")


@register("d5_kfold_plain", _kfold_sql(False))
def d5_kfold_plain(spark, sf_dir):
    """Plain (unstratified) hold-out and 5 folds."""
    pool = _pool(Inputs(spark, sf_dir), ["train", "validation"])
    return kfold(pool, 5, 0.1, SEED, label=None).select("example_id", "part", "fold")
