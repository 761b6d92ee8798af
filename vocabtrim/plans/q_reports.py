"""Method comparison over per-language tasks.

Each document language is one task; its ``train`` split fits a keep list per
method (all languages in one job), and a method's score is the share of the
task's ``test`` word occurrences that survive pruning.  The comparison then
follows the reference's report: drop from the unpruned baseline in percentage
points, dataset sizes, ordering by the baseline, and the fit against log10(size).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordering import stored
from ..operators.rank import keep_by_percent_grouped
from ..operators.report import log10_size, order_by_baseline, performance_drop, size_correlation, with_sizes
from ..operators.tokens import texts, token_counts_from_words, words
from .common import Inputs
from .oracle_sql import doc_ctes, with_ctes
from .registry import register

P = 20.0
SEED = 42
METHODS = ("NO PRUNING", "TRAIN TOKENS ONLY", "FREQUENCY", "RANDOM")


def method_results(inp: Inputs):
    """Long results ``(dataset, method, split='test', value)`` and sizes per dataset."""
    docs = inp.text_corpus("lang")
    w = words(texts(docs, extra=("lang",)))
    counts = token_counts_from_words(w, inp.vocab(), by=["lang", "split"], with_df=False)
    fit = counts.filter(F.col("split") == "train").drop("split")
    test = counts.filter(F.col("split") == "test").select("lang", "token_id", F.col("cnt").alias("tcnt"))
    keeps = {
        "TRAIN TOKENS ONLY": fit.select("lang", "token_id"),
        "FREQUENCY": keep_by_percent_grouped(fit, P, ["lang"]).select("lang", "token_id"),
        "RANDOM": keep_by_percent_grouped(fit, P, ["lang"], random_seed=SEED).select("lang", "token_id"),
    }
    total = test.groupBy("lang").agg(F.sum("tcnt").alias("_t"))
    out = total.select(F.upper("lang").alias("dataset"), F.lit("NO PRUNING").alias("method"),
                       F.lit(1.0).alias("value"))
    for name, keep in keeps.items():
        kept = (test.join(keep.withColumn("_k", F.lit(1)), ["lang", "token_id"], "left")
                    .groupBy("lang").agg((F.sum(F.when(F.col("_k").isNotNull(), F.col("tcnt")).otherwise(0))
                                          / F.sum("tcnt")).alias("value")))
        out = out.unionByName(kept.select(F.upper("lang").alias("dataset"), F.lit(name).alias("method"), "value"))
    sizes = docs.groupBy(F.upper("lang").alias("dataset")).agg(F.count(F.lit(1)).alias("_n")).select(
        "dataset", F.when(F.col("_n") >= 1000, F.concat(F.format_number(F.col("_n") / 1000.0, 1), F.lit("k")))
        .otherwise(F.col("_n").cast("string")).alias("size"))
    return out.withColumn("split", F.lit("test")), sizes


RESULTS_SQL = r"""lt AS (SELECT t.*, d.lang FROM tokens_ns t JOIN documents d ON t.example_id = d.doc_id),
fit AS (SELECT lang, token_id, count(*) AS cnt FROM lt WHERE split = 'train' GROUP BY lang, token_id),
fn AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE token_id NOT IN (0, 1, 2, 3, 4)) AS ns FROM fit GROUP BY lang),
fr AS (SELECT lang, token_id,
              row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, token_id) AS r,
              row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(token_id AS VARCHAR)), token_id) AS rr
       FROM fit WHERE token_id NOT IN (0, 1, 2, 3, 4)),
fk AS (SELECT fr.lang, fr.token_id FROM fr JOIN fn ON fr.lang = fn.lang
       WHERE r <= greatest(5, CAST(floor((n - 5) * (1 - CAST(20 AS DOUBLE) / 100)) AS BIGINT))
       UNION ALL SELECT lang, CAST(range AS INTEGER) FROM fn, range(5)),
rkp AS (SELECT fr.lang, fr.token_id FROM fr JOIN fn ON fr.lang = fn.lang
        WHERE rr <= greatest(5, CAST(floor(ns * (1 - CAST(20 AS DOUBLE) / 100)) AS BIGINT))
        UNION ALL SELECT lang, CAST(range AS INTEGER) FROM fn, range(5)),
te AS (SELECT lang, token_id, count(*) AS cnt FROM lt WHERE split = 'test' GROUP BY lang, token_id),
res AS (
  SELECT upper(lang) AS dataset, 'NO PRUNING' AS method, 1.0 AS value FROM te GROUP BY lang
  UNION ALL SELECT upper(t.lang), 'TRAIN TOKENS ONLY', sum(CASE WHEN f.token_id IS NOT NULL THEN t.cnt ELSE 0 END) / CAST(sum(t.cnt) AS DOUBLE)
  FROM te t LEFT JOIN fit f ON t.lang = f.lang AND t.token_id = f.token_id GROUP BY t.lang
  UNION ALL SELECT upper(t.lang), 'FREQUENCY', sum(CASE WHEN f.token_id IS NOT NULL THEN t.cnt ELSE 0 END) / CAST(sum(t.cnt) AS DOUBLE)
  FROM te t LEFT JOIN fk f ON t.lang = f.lang AND t.token_id = f.token_id GROUP BY t.lang
  UNION ALL SELECT upper(t.lang), 'RANDOM', sum(CASE WHEN f.token_id IS NOT NULL THEN t.cnt ELSE 0 END) / CAST(sum(t.cnt) AS DOUBLE)
  FROM te t LEFT JOIN rkp f ON t.lang = f.lang AND t.token_id = f.token_id GROUP BY t.lang),
sizes AS (SELECT upper(lang) AS dataset, count(*) AS n,
                 CASE WHEN count(*) >= 1000 THEN printf('%.1fk', count(*) / 1000.0) ELSE CAST(count(*) AS VARCHAR) END AS size
          FROM documents GROUP BY upper(lang)),
base AS (SELECT dataset, value AS b FROM res WHERE method = 'NO PRUNING'),
ordr AS (SELECT dataset, row_number() OVER (ORDER BY b DESC, dataset) AS ord FROM base)"""


@register("m15_compare_methods", with_ctes(*doc_ctes(RESULTS_SQL), body="""
SELECT r.dataset, s.size, r.method, round(r.value, 6) AS value,
       round(CASE WHEN r.method <> 'NO PRUNING' THEN (b.b - r.value) * 100 END, 6) AS drop_pp,
       CAST(o.ord AS INTEGER) AS "order"
FROM res r JOIN base b ON r.dataset = b.dataset JOIN sizes s ON r.dataset = s.dataset
JOIN ordr o ON r.dataset = o.dataset"""))
def m15_compare_methods(spark, sf_dir):
    """M15 (+A20, J11, W8): per-language method scores, drop from the baseline, sizes, order."""
    res, sizes = method_results(Inputs(spark, sf_dir))
    d = with_sizes(performance_drop(res), sizes.select(F.col("dataset").alias("task"), "size"))
    d = order_by_baseline(d.withColumn("value", F.col("value")))
    return d.select("dataset", "size", "method", F.round("value", 6).alias("value"),
                    F.round("drop_pp", 6).alias("drop_pp"), F.col("order").cast("int").alias("order"))


def _wide_sql() -> str:
    name = lambda m: m.lower().replace(" ", "_")
    cols = [f"round(max(CASE WHEN r.method = '{m}' THEN r.value END), 6) AS {name(m)}_performance" for m in METHODS]
    cols += [f"round(max(CASE WHEN r.method = '{m}' THEN (b.b - r.value) * 100 END), 6) AS {name(m)}_drop"
             for m in METHODS if m != "NO PRUNING"]
    return with_ctes(*doc_ctes(RESULTS_SQL), body=f"""
SELECT r.dataset, s.size, {", ".join(cols)}
FROM res r JOIN base b ON r.dataset = b.dataset JOIN sizes s ON r.dataset = s.dataset GROUP BY r.dataset, s.size""")


@register("m15_wide_summary", _wide_sql())
def m15_wide_summary(spark, sf_dir):
    """M15 as the summary with sizes is laid out: one column a method, its drop beside it."""
    from ..operators.report import wide_summary
    res, sizes = method_results(Inputs(spark, sf_dir))
    d = with_sizes(performance_drop(res), sizes.select(F.col("dataset").alias("task"), "size"))
    wide = wide_summary(d, METHODS)
    return wide.select("dataset", "size", *[F.round(c, 6).alias(c) for c in wide.columns[2:]])


@register("a21_size_correlation", with_ctes(*doc_ctes(RESULTS_SQL), body="""
, x AS (SELECT r.method, r.value, log10(CASE WHEN lower(s.size) LIKE '%k' THEN CAST(rtrim(lower(s.size), 'k') AS DOUBLE) * 1000
                                             ELSE CAST(s.size AS DOUBLE) END) AS lsize
        FROM res r JOIN sizes s ON r.dataset = s.dataset)
SELECT method, round(CASE WHEN var_pop(lsize) > 0 AND var_pop(value) > 0 THEN corr(lsize, value) END, 6) AS corr,
       round(CASE WHEN var_pop(lsize) > 0 THEN regr_slope(value, lsize) END, 6) AS slope,
       round(CASE WHEN var_pop(lsize) > 0 THEN regr_intercept(value, lsize) END, 6) AS intercept, count(*) AS n
FROM x GROUP BY method"""))
def a21_size_correlation(spark, sf_dir):
    """A21 (+P14): per method, correlation of the score with log10(size) and the linear fit."""
    res, sizes = method_results(Inputs(spark, sf_dir))
    x = res.join(sizes, "dataset").withColumn("lsize", log10_size("size"))
    c = size_correlation(x, "lsize", "value")
    return c.select("method", *[F.round(k, 6).alias(k) for k in ("corr", "slope", "intercept")],
                    F.col("n").cast("long"))


# ---------------------------------------------------------------- M14 (S7, S8, P15, J10) through real log files
def run_logs(inp: Inputs):
    """One run per document language: the metrics of its labelled predictions and
    the vocabulary reduction of its frequency keep list, written as run logs
    (``time - LEVEL - message`` lines, test and parameter sections) by Spark."""
    from ..operators.metrics import binary_metrics
    from .q_metrics import predictions
    docs = inp.table("documents").select(F.col("doc_id").alias("example_id"), "lang")
    m = binary_metrics(predictions(inp).join(docs, "example_id"), ["lang"])
    train = inp.text_corpus("lang").filter(F.col("split") == "train")
    fit = token_counts_from_words(words(texts(train, extra=("lang",))), inp.vocab(), by=["lang"], with_df=False)
    kept = keep_by_percent_grouped(fit, P, ["lang"]).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    v = float(inp.vocab_rows())
    red = kept.select("lang", ((1 - F.col("kept") / v) * 100).alias("voc"))
    j = m.join(red, "lang")
    line = lambda msg: F.concat(F.lit("2024-01-01 00:00:00 - INFO - "), msg)
    text = F.concat_ws("\n",
                       line(F.format_string("eval_loss: %.4f", 1 - F.col("accuracy_score"))),
                       line(F.format_string("eval_accuracy: %.4f", F.col("accuracy_score"))),
                       F.lit("=== Test Set Evaluation Results ==="),
                       F.format_string("accuracy: %.4f", F.col("accuracy_score")),
                       F.format_string("f1: %.4f", F.col("f1_score")),
                       F.lit(""),
                       F.lit("=== Parameter Reduction Statistics ==="),
                       F.format_string("Embedding parameter reduction: %.2f%%", F.col("voc")),
                       line(F.format_string("Vocabulary reduction: %.2f%%", F.col("voc"))))
    return j.select(F.col("lang").alias("run"), text.alias("text"))


M14_SQL = with_ctes(*doc_ctes(RESULTS_SQL.split(",\nte AS")[0]), r"""preds AS (
  SELECT d.doc_id AS example_id, d.lang, CAST(coalesce(l.quality, -1) AS DOUBLE) AS label,
         CAST(CAST('0x' || substr(md5('pred:' || CAST(d.doc_id AS VARCHAR)), 1, 4) AS INTEGER) AS DOUBLE) / 65535.0 * 0.8
           + CASE WHEN coalesce(l.quality, -1) = 1 THEN 0.5 ELSE 0.0 END AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
lp AS (SELECT *, CASE WHEN score > 0.65 THEN 1.0 ELSE 0.0 END AS pred FROM preds WHERE label <> -1),
bm AS (
  SELECT lang, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS acc,
         CASE WHEN sum(CASE WHEN label = 1 AND pred = 1 THEN 2 ELSE 0 END) + sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END)
                   + sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) <> 0
              THEN sum(CASE WHEN label = 1 AND pred = 1 THEN 2 ELSE 0 END)
                   / CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 2 ELSE 0 END) + sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END)
                          + sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS DOUBLE)
              ELSE 0.0 END AS f1
  FROM lp GROUP BY lang),
kc AS (SELECT lang, count(*) AS kept FROM fk GROUP BY lang),
vr AS (SELECT kc.lang, (1 - kept / CAST((SELECT v FROM vsize) AS DOUBLE)) * 100 AS voc FROM kc)""", body="""
SELECT b.lang AS task, CAST(printf('%.4f', 1 - b.acc) AS DOUBLE) AS val_loss, CAST(printf('%.4f', b.acc) AS DOUBLE) AS val_accuracy,
       CAST(printf('%.4f', b.acc) AS DOUBLE) AS test_accuracy, CAST(printf('%.4f', b.f1) AS DOUBLE) AS test_f1,
       CAST(printf('%.2f', v.voc) AS DOUBLE) AS embedding_param_reduction, CAST(printf('%.2f', v.voc) AS DOUBLE) AS vocab_reduction,
       0.0 AS total_param_reduction, 0.0 AS model_only_param_reduction
FROM bm b JOIN vr v ON b.lang = v.lang""")


LOG_PATTERNS = ("run={task}_frequency_token_prune20/*.txt", "run={task}_frequency_prune20/*.txt", "run={task}_frequency*prune*/*.txt")


@register("m14_summarise_runs", M14_SQL)
def m14_summarise_runs(spark, sf_dir):
    """M14 (+S8, S7, P15, J10): run logs written per language by Spark (text sink, one folder
    per run), two a language: the right one under a name of varying priority and another
    with other figures.  One log a task is chosen by pattern, read, parsed and pivoted."""
    import uuid
    from ..operators.report import choose_logs, parse_logs, run_summary, scan_chosen_logs
    inp = Inputs(spark, sf_dir)
    base = spark.sparkContext.getCheckpointDir().rstrip("/") + f"/run_logs/{uuid.uuid4().hex}"
    logs = stored(run_logs(inp), "logs")
    even = F.pmod(F.crc32("run"), F.lit(2)) == 0
    right = logs.withColumn("run", F.concat("run", F.when(even, "_frequency_token_prune20").otherwise("_frequency_prune20")))
    other = logs.select(F.concat("run", F.when(even, "_frequency_prune20").otherwise("_frequency_old_prune5")).alias("run"),
                        F.regexp_replace("text", "0[.][0-9]", "0.0").alias("text"))
    right.unionByName(other).repartition("run").write.partitionBy("run").text(base)
    chosen = choose_logs(spark, base, logs.select(F.col("run").alias("task")), LOG_PATTERNS)
    texts = scan_chosen_logs(spark, chosen)
    parsed = parse_logs(texts.select(F.col("task").alias("path"), "text")).withColumn("task", F.col("path"))
    s = run_summary(parsed)
    cols = ["val_loss", "val_accuracy", "test_accuracy", "test_f1", "embedding_param_reduction", "vocab_reduction",
            "total_param_reduction", "model_only_param_reduction"]
    return s.select("task", *[F.col(c).cast("double").alias(c) for c in cols])


# ---------------------------------------------------------------- S5 / S11 / A20 through a two-header summary file
def write_summary_file(res, path: str) -> None:
    """S11 + S8: the per-language results as the two-header, comma-decimal summary
    layout (method columns by position, train columns left empty, the baseline
    repeated in the reference column), one small file written by Spark."""
    from ..operators.report import SUMMARY_METHODS, SUMMARY_WIDTH
    test = res.filter(F.col("split") == "test").groupBy("dataset").pivot("method", list(METHODS)).agg(F.first("value"))

    def cell(c):
        return F.when(F.col(c).isNull(), F.lit('""')).otherwise(
            F.concat(F.lit('"'), F.regexp_replace(F.format_string("%.4f", F.col(c)), r"\.", ","), F.lit('"')))
    cols = [F.col("dataset"), cell("NO PRUNING")] + [F.lit('""')] * (SUMMARY_WIDTH - 3)
    for name, _tr, te in SUMMARY_METHODS:
        if name in METHODS:
            cols[te] = cell(name)
    data = test.select(F.lit(2).alias("_o"), F.concat_ws(",", *cols[: SUMMARY_WIDTH - 1]).alias("value"))
    head1 = "," + ",".join([""] + [x for name, _t, _e in SUMMARY_METHODS[:7] for x in (name, "")] +
                           ["FREQUENCY_OOV", "", "IMPORTANCE_OOV"])
    head2 = ",paper," + ",".join(["train,test"] * 7 + ["test", "test"])
    spark = res.sparkSession
    heads = spark.createDataFrame([(0, head1), (1, head2)], "_o int, value string")
    (heads.unionByName(data).orderBy("_o", "value").coalesce(1).select("value")
          .write.mode("overwrite").text(path))


@register("s5_read_summary", with_ctes(*doc_ctes(RESULTS_SQL), body="""
, r4 AS (SELECT dataset, method, CAST(replace(printf('%.4f', value), ',', '.') AS DOUBLE) AS value FROM res),
b4 AS (SELECT dataset, value AS b FROM r4 WHERE method = 'NO PRUNING'),
allm AS (
  SELECT d.dataset, m.method, coalesce(r.value, 0.0) AS value
  FROM (SELECT DISTINCT dataset FROM r4) d
  CROSS JOIN (VALUES ('NO PRUNING'), ('TRAIN TOKENS ONLY'), ('RANDOM'), ('CLUSTERING'), ('FREQUENCY'),
                     ('ATTENTION'), ('IMPORTANCE'), ('FREQUENCY_OOV'), ('IMPORTANCE_OOV')) m(method)
  LEFT JOIN r4 r ON r.dataset = d.dataset AND r.method = m.method)
SELECT a.dataset, a.method, round(a.value, 6) AS value,
       round(CASE WHEN a.method <> 'NO PRUNING' THEN (b.b - a.value) * 100 END, 6) AS drop_pp,
       round((a.value - b.b) * 100, 6) AS vs_paper_pp
FROM allm a JOIN b4 b ON a.dataset = b.dataset"""))
def s5_read_summary(spark, sf_dir):
    """S5 (+S8, S11, P13, A20): the method results written as the two-header,
    comma-decimal summary file and read back by position; drop from the baseline."""
    import uuid
    from ..operators.report import read_summary
    res, _ = method_results(Inputs(spark, sf_dir))
    path = spark.sparkContext.getCheckpointDir().rstrip("/") + f"/summary/{uuid.uuid4().hex}"
    write_summary_file(res, path)
    back = read_summary(spark, path)
    d = performance_drop(back)
    return d.select("dataset", "method", F.round("value", 6).alias("value"), F.round("drop_pp", 6).alias("drop_pp"),
                    F.round("vs_paper_pp", 6).alias("vs_paper_pp"))
