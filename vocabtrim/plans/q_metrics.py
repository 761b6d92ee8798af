"""Metric queries over a prediction table derived from the documents.

Predictions stand in for a model's output: label = ``labels.quality`` (-1 when
unlabelled); logits = ``[0.65, score]`` with
``score = h / 65535 * 0.8 + (label = 1 ? 0.5 : 0)`` and ``h`` the first four
hex digits of ``md5('pred:' || doc_id)`` — deterministic in every engine and
correlated with the label, so all metrics are non-trivial.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import decode_prediction
from ..operators.metrics import (align_history, best_fold, binary_metrics, cv_summary,
                                 labelled, matthews, metric_history, pearson, spearman, task_metrics,
                                 timing_summary)
from ..operators.ordering import with_row_number
from ..operators.split import kfold
from ..sources.corpus import task_metadata, TASKS
from .common import Inputs
from .oracle_sql import with_ctes
from .q_splits import _kfold_sql
from .registry import register


def predictions(inp: Inputs):
    docs = inp.table("documents").select("doc_id")
    lab = inp.table("labels").select("doc_id", "quality")
    h = F.conv(F.substring(F.md5(F.concat(F.lit("pred:"), F.col("doc_id").cast("string"))), 1, 4), 16, 10)
    label = F.coalesce(F.col("quality"), F.lit(-1)).cast("double")
    score = h.cast("double") / 65535.0 * 0.8 + F.when(label == 1, 0.5).otherwise(0.0)
    base = docs.join(lab, "doc_id", "left").select(F.col("doc_id").alias("example_id"), label.alias("label"),
                                                   score.alias("score"))
    logits = F.array(F.lit(0.65), F.col("score"))
    return base.withColumn("logits", logits).withColumn("pred", decode_prediction(F.col("logits")))


PRED = r"""preds AS (
  SELECT d.doc_id AS example_id, CAST(coalesce(l.quality, -1) AS DOUBLE) AS label,
         CAST(CAST('0x' || substr(md5('pred:' || CAST(d.doc_id AS VARCHAR)), 1, 4) AS INTEGER) AS DOUBLE) / 65535.0 * 0.8
           + CASE WHEN coalesce(l.quality, -1) = 1 THEN 0.5 ELSE 0.0 END AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
dp AS (SELECT *, CASE WHEN score > 0.65 THEN 1.0 ELSE 0.0 END AS pred FROM preds),
lp AS (SELECT * FROM dp WHERE label <> -1)"""

BIN = r"""bin AS (
  SELECT count(*) AS n, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS correct,
         sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn
  FROM lp),
binm AS (
  SELECT n, CASE WHEN n <> 0 THEN correct / CAST(n AS DOUBLE) ELSE 0.0 END AS accuracy_score,
         CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1_score,
         CASE WHEN tp + fp <> 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision_score,
         CASE WHEN tp + fn <> 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall_score
  FROM bin)"""

MCC = r"""tcls AS (SELECT label AS cls, CAST(count(*) AS DOUBLE) AS t FROM lp GROUP BY label),
pcls AS (SELECT pred AS cls, CAST(count(*) AS DOUBLE) AS q FROM lp GROUP BY pred),
marg AS (
  SELECT sum(coalesce(t, 0) * coalesce(q, 0)) AS tp_sum, sum(coalesce(t, 0) ^ 2) AS tt, sum(coalesce(q, 0) ^ 2) AS pp
  FROM tcls FULL OUTER JOIN pcls ON tcls.cls = pcls.cls),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS s, sum(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS c FROM lp),
mcc AS (
  SELECT CASE WHEN sqrt((s ^ 2 - pp) * (s ^ 2 - tt)) <> 0 THEN (c * s - tp_sum) / sqrt((s ^ 2 - pp) * (s ^ 2 - tt))
              ELSE 0.0 END AS matthews_corrcoef FROM tot, marg)"""

SPEAR = r"""rk AS (
  SELECT label, score,
         rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ry
  FROM lp),
spear AS (SELECT CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS spearmanr FROM rk),
pear AS (SELECT CASE WHEN var_pop(label) > 0 AND var_pop(score) > 0 THEN corr(label, score) END AS pearsonr FROM lp)"""

LONG = r"""long AS (
  SELECT 'accuracy_score' AS metric, accuracy_score AS value FROM binm
  UNION ALL SELECT 'f1_score', f1_score FROM binm
  UNION ALL SELECT 'precision_score', precision_score FROM binm
  UNION ALL SELECT 'recall_score', recall_score FROM binm
  UNION ALL SELECT 'matthews_corrcoef', matthews_corrcoef FROM mcc
  UNION ALL SELECT 'pearsonr', pearsonr FROM pear
  UNION ALL SELECT 'spearmanr', spearmanr FROM spear)"""


def r6(c):
    return F.round(c, 6)


@register("p16_decode_predictions", with_ctes(PRED, body="SELECT example_id, pred FROM dp"))
def p16_decode_predictions(spark, sf_dir):
    """Arg-max of the logits per row (first maximum wins)."""
    return predictions(Inputs(spark, sf_dir)).select("example_id", "pred")


@register("p17_labelled", with_ctes(PRED, body="SELECT example_id, label FROM lp"))
def p17_labelled(spark, sf_dir):
    """Rows with a real label (label -1 skipped)."""
    return labelled(predictions(Inputs(spark, sf_dir))).select("example_id", "label")


@register("a12_binary_metrics", with_ctes(PRED, BIN, body="""
SELECT CAST(n AS BIGINT) AS n, round(accuracy_score, 6) AS accuracy_score, round(f1_score, 6) AS f1_score,
       round(precision_score, 6) AS precision_score, round(recall_score, 6) AS recall_score FROM binm"""))
def a12_binary_metrics(spark, sf_dir):
    """Accuracy, F1, precision, recall (one confusion pass)."""
    b = binary_metrics(predictions(Inputs(spark, sf_dir)))
    return b.select("n", *[r6(F.col(c)).alias(c) for c in b.columns if c != "n"])


@register("a13_matthews", with_ctes(PRED, MCC, body="SELECT round(matthews_corrcoef, 6) AS matthews_corrcoef FROM mcc"))
def a13_matthews(spark, sf_dir):
    """Matthews correlation coefficient."""
    return matthews(predictions(Inputs(spark, sf_dir))).select(r6(F.col("matthews_corrcoef")).alias("matthews_corrcoef"))


@register("a14_pearson", with_ctes(PRED, SPEAR, body="SELECT round(pearsonr, 6) AS pearsonr FROM pear"))
def a14_pearson(spark, sf_dir):
    """Pearson correlation of label and score."""
    return pearson(predictions(Inputs(spark, sf_dir))).select(r6(F.col("pearsonr")).alias("pearsonr"))


@register("a15_spearman", with_ctes(PRED, SPEAR, body="SELECT round(spearmanr, 6) AS spearmanr FROM spear"))
def a15_spearman(spark, sf_dir):
    """Spearman correlation with tie-averaged ranks."""
    return spearman(predictions(Inputs(spark, sf_dir))).select(r6(F.col("spearmanr")).alias("spearmanr"))


def _tasks_sql() -> str:
    rows = []
    for t in TASKS:
        for m in t[8]:
            rows.append(f"('{t[0]}', '{m}')")
    return "tm(task, metric) AS (VALUES " + ", ".join(rows) + ")"


@register("a16_task_metrics", with_ctes(PRED, BIN, MCC, SPEAR, LONG, _tasks_sql(), body="""
SELECT tm.task, tm.metric, round(long.value, 6) AS value FROM tm JOIN long ON tm.metric = long.metric"""))
def a16_task_metrics(spark, sf_dir):
    """A16 (+S2): each registry task's metric set scored on the predictions."""
    t = task_metrics(predictions(Inputs(spark, sf_dir)), task_metadata(spark))
    return t.withColumn("value", r6(F.col("value")))


# ---------------------------------------------------------------- A17 / A18 (folds of D4)
def fold_metrics(inp: Inputs):
    pool = inp.corpus().filter(F.col("split").isin("train", "validation")).select("example_id", "label")
    folds = kfold(pool, 5, 0.1, 42).filter(F.col("part") == "train").select("example_id", "fold")
    p = predictions(inp).join(folds, "example_id")
    b = binary_metrics(p, ["fold"])
    return b.select("fold", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("accuracy_score", "f1_score", "precision_score", "recall_score")])).alias("_m")) \
            .select("fold", "_m.metric", "_m.value")


def _fold_sql(body: str) -> str:
    ks = _kfold_sql(True)
    # reuse the D4 CTEs, then score every fold
    ks = ks[: ks.rindex("SELECT example_id, 'test'")]
    return ks + """, """ + PRED + """,
fp AS (SELECT p.*, fk.fold FROM lp p JOIN fk ON p.example_id = fk.example_id),
fb AS (
  SELECT fold, count(*) AS n, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS correct,
         sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn
  FROM fp GROUP BY fold),
fm AS (
  SELECT fold, 'accuracy_score' AS metric, CASE WHEN n <> 0 THEN correct / CAST(n AS DOUBLE) ELSE 0.0 END AS value FROM fb
  UNION ALL SELECT fold, 'f1_score', CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END FROM fb
  UNION ALL SELECT fold, 'precision_score', CASE WHEN tp + fp <> 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END FROM fb
  UNION ALL SELECT fold, 'recall_score', CASE WHEN tp + fn <> 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END FROM fb)
""" + body


@register("a17_cv_summary", _fold_sql("""
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM fm GROUP BY metric"""))
def a17_cv_summary(spark, sf_dir):
    """A17 (+U5): mean and sample std of each metric over the five D4 folds."""
    s = cv_summary(fold_metrics(Inputs(spark, sf_dir)))
    return s.select("metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@register("a18_best_fold", _fold_sql("""
SELECT metric, fold, round(value, 6) AS value FROM fm WHERE metric = 'accuracy_score'
ORDER BY value DESC, fold LIMIT 1"""))
def a18_best_fold(spark, sf_dir):
    """Best fold by accuracy (first fold on ties)."""
    b = best_fold(fold_metrics(Inputs(spark, sf_dir)))
    return b.select("metric", "fold", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------- A23 / A24 / J9 over events
@register("a23_timing_summary", with_ctes("x AS (SELECT 1)", body="""
SELECT event_type AS run, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS batches
FROM events GROUP BY event_type"""))
def a23_timing_summary(spark, sf_dir):
    """Per-run measurement summary; ``events.value`` grouped by event type stands in for timings."""
    ev = Inputs(spark, sf_dir).table("events").select(F.col("event_type").alias("run"), F.col("value").alias("seconds"))
    t = timing_summary(ev)
    return t.select("run", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
                    F.col("batches").cast("long"))


def train_events(inp: Inputs):
    """Training-log entries derived from ``events``: each event is one log entry of
    run = event type at step = its order in time; every third user logs an eval
    entry (``eval_loss``, ``eval_k``, ``epoch``), the others a train entry
    (``loss``, ``learning_rate``, ``epoch``) plus a non-numeric ``note`` (NULL)."""
    ev = inp.table("events")
    k = F.get_json_object("props", "$.k").cast("double")
    # a run (event type) can hold a third of all events: distributed numbering, not a window
    ev = with_row_number(ev.select("event_type", "ts", "event_id", "user_id", "value", "props"),
                         [F.col("ts").asc(), F.col("event_id").asc()], name="step", groups=["event_type"])
    base = ev.select(F.col("event_type").alias("run"), "step", (F.col("user_id") % 3 == 0).alias("ev"),
                     "value", k.alias("k"))
    kv = F.when(F.col("ev"), F.array(
        F.struct(F.lit("eval_loss").alias("key"), F.col("value").alias("value")),
        F.struct(F.lit("eval_k").alias("key"), F.col("k").alias("value")),
        F.struct(F.lit("epoch").alias("key"), (F.col("step") / 100.0).alias("value")))).otherwise(F.array(
        F.struct(F.lit("loss").alias("key"), F.col("value").alias("value")),
        F.struct(F.lit("learning_rate").alias("key"), (F.col("k") / 10000.0).alias("value")),
        F.struct(F.lit("epoch").alias("key"), (F.col("step") / 100.0).alias("value")),
        F.struct(F.lit("note").alias("key"), F.lit(None).cast("double").alias("value"))))
    return base.select("run", "step", F.explode(kv).alias("e")).select("run", "step", "e.key", "e.value")


TE_SQL = r"""te0 AS (
  SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
         user_id % 3 = 0 AS ev, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
te AS (
  SELECT run, step, 'eval_loss' AS key, value FROM te0 WHERE ev
  UNION ALL SELECT run, step, 'eval_k', k FROM te0 WHERE ev
  UNION ALL SELECT run, step, 'epoch', step / 100.0 FROM te0
  UNION ALL SELECT run, step, 'loss', value FROM te0 WHERE NOT ev
  UNION ALL SELECT run, step, 'learning_rate', k / 10000.0 FROM te0 WHERE NOT ev
  UNION ALL SELECT run, step, 'note', CAST(NULL AS DOUBLE) FROM te0 WHERE NOT ev),
se AS (
  SELECT run, step, key, value, max(CASE WHEN starts_with(key, 'eval_') THEN 1 ELSE 0 END) OVER (PARTITION BY run, step) = 1 AS is_eval
  FROM te WHERE value IS NOT NULL),
series AS (
  SELECT run, step, 'eval' AS phase, regexp_replace(key, '^eval_', '') AS metric, value FROM se
  WHERE is_eval AND (starts_with(key, 'eval_') OR key = 'epoch')
  UNION ALL
  SELECT run, step, 'train', key, value FROM se WHERE NOT is_eval AND key IN ('loss', 'learning_rate', 'epoch')),
hist AS (
  SELECT run, phase, metric, CAST(row_number() OVER (PARTITION BY run, phase, metric ORDER BY step) - 1 AS BIGINT) AS idx, value
  FROM series)"""


@register("a24_metric_history", with_ctes(TE_SQL, body="SELECT run, phase, metric, idx, round(value, 6) AS value FROM hist"))
def a24_metric_history(spark, sf_dir):
    """Training-log entries -> per-run train/eval metric series."""
    h = metric_history(train_events(Inputs(spark, sf_dir)))
    return h.select("run", "phase", "metric", "idx", r6(F.col("value")).alias("value"))


@register("j9_align_history", with_ctes(TE_SQL, body="""
, lens AS (SELECT run, phase, metric, count(*) AS n FROM hist GROUP BY run, phase, metric),
mins AS (SELECT run, phase, min(n) AS m FROM lens GROUP BY run, phase)
SELECT h.run, h.idx, CASE WHEN h.phase = 'train' THEN 'train_' || h.metric ELSE h.metric END AS "column",
       round(h.value, 6) AS value
FROM hist h JOIN mins ON h.run = mins.run AND h.phase = mins.phase WHERE h.idx < mins.m"""))
def j9_align_history(spark, sf_dir):
    """History truncated to the shortest series per phase, aligned by position."""
    a = align_history(metric_history(train_events(Inputs(spark, sf_dir))))
    return a.withColumn("value", r6(F.col("value")))


# ---------------------------------------------------------------- M12 / M13 (data side of the runs)
RUN_TASK = "mrpc"


def _m12_sql() -> str:
    from .oracle_sql import SWORDS, TEXTS, TOKENS, VOCAB
    from .q_prune import P
    names = ", ".join(f"'{m}'" for t in TASKS if t[0] == RUN_TASK for m in t[8])
    return _fold_sql(",\n" + ",\n".join([TEXTS, SWORDS, VOCAB, TOKENS]) + rf""",
own AS (SELECT f.fold, t.token_id, count(*) AS cnt FROM tokens t JOIN fk f ON t.example_id = f.example_id GROUP BY 1, 2),
others AS (
  SELECT CAST(k.range AS INTEGER) AS fold, o.token_id, sum(o.cnt) AS cnt
  FROM range(5) k JOIN own o ON o.fold <> k.range GROUP BY 1, 2),
kk AS (
  SELECT fold, greatest(5, CAST(trunc((count(*) - 5) * (1 - CAST({P} AS DOUBLE) / 100)) AS BIGINT)) AS k
  FROM others GROUP BY fold),
ranked AS (
  SELECT fold, token_id, row_number() OVER (PARTITION BY fold ORDER BY cnt DESC, token_id) AS rank
  FROM others WHERE token_id > 4),
maps AS (
  SELECT r.fold, r.token_id FROM ranked r JOIN kk ON r.fold = kk.fold WHERE r.rank <= kk.k
  UNION ALL SELECT kk.fold, CAST(x.range AS INTEGER) FROM kk, range(5) x),
total AS (
  SELECT f.fold, sum(2 + least(len(regexp_extract_all(lower(x.text), '[\p{{L}}\p{{N}}_]{{2,}}')), 126)) AS n
  FROM texts x JOIN fk f ON x.example_id = f.example_id GROUP BY 1),
gone AS (
  SELECT f.fold, count(*) AS u
  FROM tokens t JOIN fk f ON t.example_id = f.example_id LEFT JOIN maps m ON m.fold = f.fold AND m.token_id = t.token_id
  WHERE t.pos BETWEEN 1 AND 126 AND m.token_id IS NULL GROUP BY 1)
SELECT fold, metric, round(value, 6) AS value FROM fm WHERE metric IN ({names})
UNION ALL SELECT fold, 'kept_tokens', CAST(count(*) AS DOUBLE) FROM maps GROUP BY fold
UNION ALL SELECT t.fold, 'unk_rate', round(coalesce(g.u, 0) / CAST(t.n AS DOUBLE), 6)
FROM total t LEFT JOIN gone g ON t.fold = g.fold""")


@register("m12_cross_validate", _m12_sql())
def m12_cross_validate(spark, sf_dir):
    """M12 (+U5): every D4 fold with the keep list of the other folds: its rows encoded and
    rewritten (J1), the task's metrics (A16), all folds in grouped jobs."""
    from .pipelines import cross_validate
    from .q_prune import P
    inp = Inputs(spark, sf_dir)
    corpus = inp.corpus().filter(F.col("split").isin("train", "validation"))
    task = task_metadata(spark).filter(F.col("task") == RUN_TASK)
    results, _, _ = cross_validate(corpus, inp.vocab(), predictions(inp), task, P, 5, 42)
    return results.select("fold", "metric", r6(F.col("value")).alias("value"))


def _m13_sql() -> str:
    from .oracle_sql import STOP, doc_ctes
    from .q_encode import D2_PARTS
    from .q_prune import BODY_FACTOR, CNTS, DIM, FMAP
    return with_ctes(*doc_ctes(STOP), CNTS, FMAP, *D2_PARTS, PRED.replace("preds AS (", "preds0 AS (", 1)
                     .replace("dp AS (SELECT *, CASE WHEN score > 0.65 THEN 1.0 ELSE 0.0 END AS pred FROM preds),",
                              "preds AS (SELECT p.* FROM preds0 p JOIN parts t ON p.example_id = t.example_id WHERE t.part = 'test'),\n"
                              "dp AS (SELECT *, CASE WHEN score > 0.65 THEN 1.0 ELSE 0.0 END AS pred FROM preds),"),
                     BIN, body=f"""
, red AS (SELECT count(DISTINCT new_id) AS kept, (SELECT v FROM vsize) AS v FROM fmap),
unk AS (SELECT avg(CASE WHEN m.new_id IS NULL THEN 1.0 ELSE 0.0 END) AS r
        FROM tokens t JOIN parts p ON t.example_id = p.example_id LEFT JOIN fmap m ON t.token_id = m.token_id
        WHERE p.part = 'test')
SELECT 'test_accuracy_score' AS metric, round(accuracy_score, 6) AS value FROM binm
UNION ALL SELECT 'test_f1_score', round(f1_score, 6) FROM binm
UNION ALL SELECT 'kept_tokens', CAST(kept AS DOUBLE) FROM red
UNION ALL SELECT 'removed_params', CAST((v - kept) * {DIM} AS DOUBLE) FROM red
UNION ALL SELECT 'model_only_reduction_pct', 0.0
UNION ALL SELECT 'embedding_reduction_pct', round((v * {DIM} - kept * {DIM}) / CAST(v * {DIM} AS DOUBLE) * 100, 6) FROM red
UNION ALL SELECT 'vocab_reduction_pct', round((1 - kept / CAST(v AS DOUBLE)) * 100, 6) FROM red
UNION ALL SELECT 'total_reduction_pct', round((v - kept) * {DIM} / CAST((1 + {BODY_FACTOR}) * v * {DIM} AS DOUBLE) * 100, 6) FROM red
UNION ALL SELECT 'test_unk_rate', round(r, 6) FROM unk""")


@register("m13_standard_run", _m13_sql())
def m13_standard_run(spark, sf_dir):
    """Frequency pruning -> D2 -> the task's metrics on the test part (A16) + A11 reduction
    + the share of test tokens that became UNK, written as CSV (S8) and read back (S6)."""
    from ..operators.rank import keep_by_percent
    from ..operators.remap import reduction_report
    from ..operators.report import read_many_csv, write_csv
    from ..operators.tokens import token_counts_from_words, words
    from .pipelines import PruneResult, standard_run
    from .q_encode import d2_split
    from .q_files import _folder
    from .q_prune import BODY_FACTOR, DIM, P, train_counts
    inp = Inputs(spark, sf_dir)
    parts = d2_split(inp)
    test_ids = parts.filter(F.col("part") == "test").select("example_id")
    tm = keep_by_percent(train_counts(inp), P)
    v = inp.vocab_rows()
    result = PruneResult(tm, None, None, reduction_report(tm, v, DIM, BODY_FACTOR * v * DIM))
    task = task_metadata(spark).filter(F.col("task") == RUN_TASK)
    out = standard_run(predictions(inp).join(test_ids, "example_id"), task, result)
    # whole texts of the test part, counted per token before the map joins
    counts = token_counts_from_words(words(inp.texts().join(test_ids, "example_id"), add_special_tokens=True),
                                     inp.vocab(), with_df=False)
    unk = (counts.join(tm.withColumn("_k", F.lit(1)).select("token_id", "_k"), "token_id", "left")
                 .agg((F.sum(F.when(F.col("_k").isNull(), F.col("cnt")).otherwise(0)) / F.sum("cnt"))
                      .alias("test_unk_rate")))

    out = out.unionByName(unk.select(F.lit("test_unk_rate").alias("metric"), F.col("test_unk_rate").alias("value")))
    path = _folder(spark, "standard-run")
    write_csv(out.select("metric", r6(F.col("value")).alias("value")), path)
    return read_many_csv(spark, [path]).select("metric", F.col("value").cast("double"))
