"""Queries of scans, sinks and report tables (S1, S6, S8-S11, A10) and of the whole
OOV and parameter-budget jobs (J2, J5, W4, C4).

Sinks write below the checkpoint folder, which all executors share, and the query
returns what a second scan reads there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.cluster import cluster_removed, prune_by_cluster
from ..operators.encoding import encode_pair, pair_arrays
from ..operators.rank import keep_by_percent, keep_random_by_parameters, removed
from ..operators.remap import parameter_counts, reduce_embeddings, remap_hybrid
from ..operators.report import format_report, read_many_csv, write_csv, write_encoded, write_predictions
from ..operators.stats import token_stats
from ..operators.tokens import encode, sequences, texts, words
from ..sources.corpus import scan_corpus, scan_embeddings
from .common import Inputs
from .oracle_sql import doc_ctes, with_ctes
from .q_cluster import BFMAP, C4_SQL, K_OOV, ROUNDS, SEED, _oov_sql, bench_counts, vectors
from .q_encode import MAXLEN, PAIR_WORDS, sql_pair_encoding
from .q_metrics import PRED, predictions
from .q_prune import BODY_FACTOR, DIM, P, RMAP, as_map, ctes as prune_ctes, train_counts
from .q_tokens import sql_token_stats, split_counts
from .registry import register


def _folder(spark, name: str) -> str:
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- S1
@register("s1_scan_splits", with_ctes(*doc_ctes(), body="""
SELECT example_id, split, length(text_a) AS n_chars FROM corpus WHERE split IN ('validation', 'test')"""))
def s1_scan_splits(spark, sf_dir):
    """The validation and test splits of the corpus, as the scan restricts them."""
    c = scan_corpus(Inputs(spark, sf_dir).text_corpus(), ("validation", "test"))
    return c.select("example_id", "split", F.length("text_a").cast("long").alias("n_chars"))


# ---------------------------------------------------------------- S6 / S8
@register("s8_csv_round_trip", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_chars, lang, CAST(NULL AS BIGINT) AS quality FROM documents
UNION ALL SELECT doc_id, NULL, NULL, CAST(quality AS BIGINT) FROM labels""")
def s8_csv_round_trip(spark, sf_dir):
    """S8 + S6: documents (one folder per language) and labels written as CSV, then read
    back as one table by column name; a path that does not exist is skipped."""
    inp = Inputs(spark, sf_dir)
    base = _folder(spark, "csv")
    docs = inp.table("documents").select("doc_id", F.length("text").alias("text_chars"), "lang")
    write_csv(docs, base + "/documents", by=["lang"])
    write_csv(inp.table("labels").select("doc_id", "quality"), base + "/labels")
    back = read_many_csv(spark, [base + "/documents", base + "/absent", base + "/labels"])
    return back.select(F.col("doc_id").cast("long"), F.col("text_chars").cast("long"), "lang",
                       F.col("quality").cast("long"))


# ---------------------------------------------------------------- S9
@register("s9_predictions_file", "WITH " + PRED + """
SELECT 'labels' AS kind, printf('%d', CAST(pred AS BIGINT)) AS line, count(*) AS n FROM dp GROUP BY 2
UNION ALL SELECT 'scores', printf('%.6f', score), count(*) FROM dp GROUP BY 2""")
def s9_predictions_file(spark, sf_dir):
    """The predictions written one a line, as labels and as scores; lines read back and counted."""
    preds = predictions(Inputs(spark, sf_dir))
    out = None
    for kind, regression, value in (("labels", False, "pred"), ("scores", True, "score")):
        path = _folder(spark, "predictions")
        write_predictions(preds, path, regression, value)
        lines = spark.read.text(path).select(F.lit(kind).alias("kind"), F.col("value").alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out.groupBy("kind", "line").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- S10
@register("s10_encoded_file", with_ctes(*PAIR_WORDS, sql_pair_encoding("pwords", True), body="""
SELECT e.example_id, array_to_string(e.ids, ',') AS ids, array_to_string(e.mask, ',') AS mask, c.label AS labels
FROM enc e JOIN pcorpus c ON e.example_id = c.example_id"""))
def s10_encoded_file(spark, sf_dir):
    """Encoded pairs written as model-ready Parquet and read back."""
    inp = Inputs(spark, sf_dir)
    pairs = inp.pairs()
    tokens = encode(words(texts(pairs), keep_empty=True, limit=MAXLEN - 2), inp.vocab())
    enc = encode_pair(pair_arrays(tokens), MAXLEN).join(pairs.select("example_id", F.col("label").alias("labels")),
                                                        "example_id")
    path = _folder(spark, "encoded")
    write_encoded(enc.select("example_id", "input_ids", "attention_mask", "labels"), path)
    return spark.read.parquet(path).select("example_id", F.array_join("input_ids", ",").alias("ids"),
                                           F.array_join("attention_mask", ",").alias("mask"), "labels")


# ---------------------------------------------------------------- S11
@register("s11_format_report", with_ctes(*doc_ctes(), sql_token_stats("words", "split"), body="""
SELECT split, format('{:,}', CAST(total_tokens AS BIGINT)) AS total_tokens,
       format('{:,}', CAST(unique_tokens AS BIGINT)) AS unique_tokens,
       printf('%.2f', vocab_coverage_pct) AS vocab_coverage_pct,
       printf('%.2f', top10_coverage_pct) AS top10_coverage_pct
FROM stats"""))
def s11_format_report(spark, sf_dir):
    """The per-split statistics as report text (thousands separators, two decimals)."""
    inp = Inputs(spark, sf_dir)
    s = token_stats(None, inp.vocab(), inp.vocab_rows(), counts=split_counts(inp))
    pct = ["vocab_coverage_pct", "top10_coverage_pct"]
    s = s.select("split", "total_tokens", "unique_tokens", *[F.round(c, 6).alias(c) for c in pct])
    return format_report(s, ["total_tokens", "unique_tokens"], pct)


ROW_COLS = ("total_tokens", "unique_tokens", "vocab_coverage_pct", "top20_coverage_pct", "freq_importance_overlap_pct")


def _rows_sql() -> str:
    cell = lambda c, s: (f"format('{{:,}}', CAST(max(CASE WHEN split = '{s}' THEN {c} END) AS BIGINT))" if c.endswith("tokens")
                         else f"printf('%.2f', max(CASE WHEN split = '{s}' THEN {c} END))")
    cells = ["'documents'"] + [cell(c, s) for c in ROW_COLS for s in ("train", "test")]
    return with_ctes(*doc_ctes(), sql_token_stats("words", "split"), body=f"""
SELECT concat_ws(' & ', {", ".join(cells)}) || ' \\\\' AS line FROM stats""")


@register("s11_report_rows", _rows_sql())
def s11_report_rows(spark, sf_dir):
    """S11 + A19: the statistics of train and test beside each other, one joined line a task."""
    from ..operators.report import report_rows, split_pivot
    inp = Inputs(spark, sf_dir)
    s = token_stats(None, inp.vocab(), inp.vocab_rows(), counts=split_counts(inp)).withColumn("task", F.lit("documents"))
    s = s.select("task", "split", *[F.round(c, 6).alias(c) if c.endswith("pct") else F.col(c) for c in ROW_COLS])
    wide = split_pivot(s, ROW_COLS, ("train", "test"))
    cols = [f"{c}_{part}" for c in ROW_COLS for part in ("train", "test")]
    text = format_report(wide, [c for c in cols if "tokens" in c], [c for c in cols if "pct" in c])
    return report_rows(text, ["task", *cols])


# ---------------------------------------------------------------- A10
@register("a10_parameter_counts", f"""
WITH e AS (SELECT count(*) * max(len(embedding)) AS n FROM embeddings),
b AS (SELECT count(*) * {DIM} AS n FROM documents)
SELECT e.n + b.n AS total, e.n AS embedding, b.n AS model_only FROM e, b""")
def a10_parameter_counts(spark, sf_dir):
    """A10: parameter totals by the name rule, over an inventory of the embedding table
    and one dense block per document language."""
    inp = Inputs(spark, sf_dir)
    emb = inp.table("embeddings").agg(
        F.lit("embeddings.word_embeddings.weight").alias("param_name"),
        (F.count(F.lit(1)) * F.max(F.size("embedding"))).alias("numel"))
    body = inp.table("documents").groupBy("lang").agg((F.count(F.lit(1)) * DIM).alias("numel")).select(
        F.concat(F.lit("encoder."), F.coalesce("lang", F.lit("none")), F.lit(".weight")).alias("param_name"), "numel")
    c = parameter_counts(emb.unionByName(body))
    return c.select(*[F.col(x).cast("long") for x in ("total", "embedding", "model_only")])


# ---------------------------------------------------------------- W4 / C4 under a parameter budget
RPMAP = rf"""rb AS (
  SELECT (SELECT count(*) FROM cnts) AS n,
         (SELECT count(*) FROM cnts WHERE token_id NOT IN (0, 1, 2, 3, 4)) AS ns,
         (SELECT v FROM vsize) AS v),
rb2 AS (SELECT n, ns, (v - n) * {DIM} AS red, ({BODY_FACTOR} + 1) * v * {DIM} AS total FROM rb),
rk AS (
  SELECT 100 * (red / CAST(total AS DOUBLE)) >= {P} AS keep_all,
         greatest(5, ns - least(CAST(trunc((CAST({P} AS DOUBLE) / 100 * total - red) / {DIM}) AS BIGINT), ns)) AS k
  FROM rb2),
rall AS (SELECT token_id, row_number() OVER (ORDER BY token_id) AS rank FROM cnts),
rpmap AS (
  SELECT CAST(token_id AS INTEGER) AS token_id, CAST(rank + 4 AS INTEGER) AS new_id
  FROM rmap_r WHERE NOT (SELECT keep_all FROM rk) AND rank <= (SELECT k FROM rk)
  UNION ALL SELECT CAST(range AS INTEGER), CAST(range AS INTEGER) FROM range(5) WHERE NOT (SELECT keep_all FROM rk)
  UNION ALL SELECT CAST(token_id AS INTEGER), CAST(rank - 1 AS INTEGER) FROM rall WHERE (SELECT keep_all FROM rk))"""


@register("w4_random_parameters", with_ctes(*prune_ctes(RMAP, RPMAP), body="""
SELECT token_id AS old_id, new_id FROM rpmap"""))
def w4_random_parameters(spark, sf_dir):
    """W4 + W3: seeded random keep list under a 20 % parameter budget."""
    inp = Inputs(spark, sf_dir)
    v = inp.vocab_rows()
    return as_map(keep_random_by_parameters(train_counts(inp), P, v, DIM, (BODY_FACTOR + 1) * v * DIM, SEED))


# the embedding table is the whole embedding here, so its rows are the vocabulary of the budget
_TOKEN_BUDGET = f"(SELECT (n - 5) - CAST(trunc(n * {P} / 100) AS BIGINT) FROM cn)"
_PARAM_BUDGET = rf"""(SELECT greatest(0, (n - 5) - least(CAST(trunc(
  (CAST({P} AS DOUBLE) / 100 * {BODY_FACTOR + 1} * v * {DIM} - (v - n) * {DIM}) / {DIM}) AS BIGINT), n - 5))
  FROM cn, (SELECT count(*) AS v FROM embeddings))"""


@register("c4_cluster_parameters", C4_SQL.replace(_TOKEN_BUDGET, _PARAM_BUDGET))
def c4_cluster_parameters(spark, sf_dir):
    """C4 + W3: one token per cluster, as many clusters as a 20 % parameter budget leaves."""
    inp = Inputs(spark, sf_dir)
    vecs = vectors(inp)
    v = vecs.count()
    keep = prune_by_cluster(train_counts(inp), vecs, P, SEED, ROUNDS, vocab_rows=v, dim=DIM,
                            total_params=(BODY_FACTOR + 1) * v * DIM)
    return keep.select(F.col("token_id").alias("old_id"), "new_id")


# ---------------------------------------------------------------- M2 as a whole: J2 on encoded rows, J5 on its keep list
def _m2(inp: Inputs):
    """``(corpus, keep list with representatives, removed token -> representative)`` of M2, once per session."""
    corpus, counts = bench_counts(inp)
    keep = keep_by_percent(counts, P)
    oov, keep2 = cluster_removed(removed(counts, keep), keep, vectors(inp), K_OOV, SEED, ROUNDS)
    return corpus, inp.shared("m2_keep", lambda: keep2), inp.shared("m2_oov", lambda: oov)


_HYBRID = _oov_sql("bfmap", BFMAP, "intended")


@register("j2_remap_hybrid", _HYBRID.rsplit("\nSELECT token_id AS old_id, new_id FROM keep2", 1)[0] + """,
hyb AS (
  SELECT token_id, new_id FROM keep2
  UNION ALL
  SELECT o.token_id, k.new_id FROM oov o JOIN keep2 k ON o.rep_id = k.token_id
  WHERE o.token_id NOT IN (SELECT token_id FROM keep2)),
bpos AS (
  SELECT example_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT *, list_concat(['[CLS]'], regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), ['[SEP]']) AS w FROM btexts))
SELECT b.example_id, string_agg(CAST(coalesce(h.new_id, 0) AS VARCHAR), ',' ORDER BY b.pos) AS ids
FROM bpos b LEFT JOIN vocab v ON b.word = v.word LEFT JOIN hyb h ON coalesce(v.token_id, 0) = h.token_id
GROUP BY b.example_id""")
def j2_remap_hybrid(spark, sf_dir):
    """J2 (M2 whole): encoded benchmark texts rewritten, removed tokens as their representative's new id."""
    inp = Inputs(spark, sf_dir)
    corpus, keep2, oov = _m2(inp)
    enc = sequences(encode(words(texts(corpus), add_special_tokens=True), inp.vocab()))
    out = remap_hybrid(enc.select("example_id", "side", "input_ids"), keep2, oov)
    return out.select("example_id", F.array_join("input_ids", ",").alias("ids"))


@register("m2_reduced_embeddings", _HYBRID.rsplit("\nSELECT token_id AS old_id, new_id FROM keep2", 1)[0] + """
SELECT k.new_id, round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 5) AS checksum
FROM keep2 k JOIN embeddings e ON k.token_id = e.vec_id""")
def m2_reduced_embeddings(spark, sf_dir):
    """J5 (M2 whole): the embedding rows of M2's keep list, representatives included."""
    _, keep2, _ = _m2(Inputs(spark, sf_dir))
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return reduce_embeddings(keep2, scan_embeddings(spark, sf_dir)).select("new_id", F.round(total, 5).alias("checksum"))
