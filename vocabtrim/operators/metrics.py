"""Prediction scoring.

Inputs are prediction tables ``(example_id, label DOUBLE, pred DOUBLE, score DOUBLE)``;
rows with label -1 are unlabelled and skipped.  Every metric is one grouped
aggregate (``by`` columns, e.g. ``fold``), so all folds or runs are scored in
one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import stored, with_row_number


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop unlabelled rows (label -1)."""
    return df.filter(F.col(label) != -1)


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(preds: DataFrame, by: Sequence[str] = (), positive: float = 1.0) -> DataFrame:
    """Accuracy, F1, precision, recall of the positive class; 0 on zero denominators."""
    p = labelled(preds)
    pos_t, pos_p = F.col("label") == positive, F.col("pred") == positive
    agg = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("label") == F.col("pred"), 1).otherwise(0)).alias("correct"),
        F.sum(F.when(pos_t & pos_p, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(~pos_t & pos_p, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(pos_t & ~pos_p, 1).otherwise(0)).alias("fn"))
    return agg.select(*by, F.col("n").cast("long"),
                      _safe_div(F.col("correct"), F.col("n")).alias("accuracy_score"),
                      _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_score"),
                      _safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_score"),
                      _safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_score"))


def matthews(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Multi-class Matthews correlation from class marginals; 0 if undefined."""
    p = labelled(preds)
    by = list(by)
    t = p.groupBy(*by, F.col("label").alias("cls")).agg(F.count(F.lit(1)).cast("double").alias("t"))
    q = p.groupBy(*by, F.col("pred").alias("cls")).agg(F.count(F.lit(1)).cast("double").alias("q"))
    m = (t.join(q, [*by, "cls"], "full_outer")
          .groupBy(*by).agg(F.sum(F.coalesce("t", F.lit(0.0)) * F.coalesce("q", F.lit(0.0))).alias("tp_sum"),
                            F.sum(F.coalesce("t", F.lit(0.0)) ** 2).alias("tt"),
                            F.sum(F.coalesce("q", F.lit(0.0)) ** 2).alias("pp")))
    tot = p.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("s"),
                             F.sum(F.when(F.col("label") == F.col("pred"), 1.0).otherwise(0.0)).alias("c"))
    if by:
        j = tot.join(m, by)
    else:  # two one-row aggregates: stack them and sum, no pairing of tables
        zero = F.lit(0.0)
        j = (tot.select("s", "c", zero.alias("tp_sum"), zero.alias("tt"), zero.alias("pp"))
                .unionByName(m.select(zero.alias("s"), zero.alias("c"), "tp_sum", "tt", "pp"))
                .agg(*[F.sum(x).alias(x) for x in ("s", "c", "tp_sum", "tt", "pp")]))
    num = F.col("c") * F.col("s") - F.col("tp_sum")
    den = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return j.select(*by, F.when(den != 0, num / den).otherwise(F.lit(0.0)).alias("matthews_corrcoef"))


def pearson(preds: DataFrame, by: Sequence[str] = (), x: str = "label", y: str = "score") -> DataFrame:
    """Pearson correlation (``corr`` aggregate)."""
    from .report import safe_corr
    return labelled(preds).groupBy(*by).agg(safe_corr(x, y).alias("pearsonr"))


def average_ranks(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Tie-averaged 1-based ranks of ``col`` within ``by`` (distributed numbering)."""
    name = name or f"{col}_rank"
    r = with_row_number(df, [F.col(col).asc(), F.col("example_id").asc()], name="_rk", groups=list(by))
    ties = r.groupBy(*by, col).agg(F.avg("_rk").alias(name))
    return r.drop("_rk").join(ties, [*by, col])


def spearman(preds: DataFrame, by: Sequence[str] = (), x: str = "label", y: str = "score") -> DataFrame:
    """Spearman correlation = Pearson of tie-averaged ranks."""
    p = labelled(preds).select(*by, "example_id", x, y)
    r = average_ranks(average_ranks(p, x, by, "_rx"), y, by, "_ry")
    from .report import safe_corr
    return r.groupBy(*by).agg(safe_corr("_rx", "_ry").alias("spearmanr"))


#: Metric families by the metrics they give: ``family(preds, by)`` has a column for each.
FAMILIES: list[tuple[tuple[str, ...], Callable[..., DataFrame]]] = [
    (("accuracy_score", "f1_score", "precision_score", "recall_score"), binary_metrics),
    (("matthews_corrcoef",), matthews), (("pearsonr",), pearson), (("spearmanr",), spearman)]


def register_metric(*names: str):
    """Add a metric family: a function ``(preds, by) -> DataFrame(by..., names...)``.  A metric
    registered again is taken from the last family that has it."""
    def add(fn):
        FAMILIES.append((names, fn))
        return fn
    return add


def all_metrics_long(preds: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] | None = None) -> DataFrame:
    """A12-A15 and registered metrics as one long table ``(by..., metric, value)``; only the
    families that have one of ``metrics`` are computed (None: all).  Several families read
    the labelled predictions from one written copy, so the predictions are computed once."""
    by, out, done, wanted = list(by), None, set(), []
    for names, family in reversed(FAMILIES):
        mine = [m for m in names if m not in done and (metrics is None or m in metrics)]
        done.update(names)
        if mine:
            wanted.append((mine, family))
    if len(wanted) > 1:
        preds = stored(labelled(preds), "predictions")
    for mine, family in wanted:
        cells = family(preds, by).select(*by, F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in mine])).alias("_m"))
        cells = cells.select(*by, "_m.metric", "_m.value")
        out = cells if out is None else out.unionByName(cells)
    if out is None:
        raise ValueError(f"no metric of {metrics} is registered")
    return out


def task_metrics(preds: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each task's metric list scored on the predictions, long ``(task, metric, value)``.
    Only metrics that some task asks for are computed."""
    want = tasks.select("task", F.explode("metrics").alias("metric"))
    names = [r["metric"] for r in want.select("metric").distinct().collect()]  # names of the task registry
    return want.join(all_metrics_long(preds, metrics=names), "metric", "inner").select("task", "metric", "value")


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and sample standard deviation over folds of every metric (long input)."""
    return fold_metrics.groupBy("metric").agg(F.avg("value").alias("mean"),
                                              F.stddev_samp("value").alias("std"))


def best_fold(fold_metrics: DataFrame, prefer=("accuracy_score", "f1_score", "matthews_corrcoef")) -> DataFrame:
    """Fold with the best value of the first available preferred metric
    (first fold wins ties); the last fold if none is present."""
    pref = F.broadcast(fold_metrics.sparkSession.createDataFrame(
        [(m, i) for i, m in enumerate(prefer)], "metric string, _pref int"))
    m = fold_metrics.join(pref, "metric", "left")
    found = F.col("_pref").isNotNull()
    chosen = F.when(found, F.struct("metric", "fold", "value")).otherwise(
        F.struct(F.lit(None).cast("string").alias("metric"), "fold", F.lit(None).cast("double").alias("value")))
    order = F.struct(F.when(found, -F.col("_pref")).otherwise(F.lit(-len(prefer))), F.when(found, F.col("value")),
                     F.when(found, -F.col("fold")).otherwise(F.col("fold")))
    best = m.agg(F.max_by(chosen, order).alias("b"))
    return best.select("b.metric", "b.fold", "b.value")


def timing_summary(timings: DataFrame, run: str = "run", value: str = "seconds") -> DataFrame:
    """Per run mean, population std, min, max and count of measurements."""
    return timings.groupBy(run).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                    F.min(value).alias("min"), F.max(value).alias("max"),
                                    F.count(F.lit(1)).alias("batches"))


TRAIN_KEYS = ("loss", "learning_rate", "epoch")
ENTRIES = 1 << 19
"""Log entries that a task sorts, on average."""


def metric_history(events: DataFrame) -> DataFrame:
    """Log entries ``(run, step, key, value)`` -> series ``(run, phase, metric, idx, value)``.

    A step is an eval entry when any of its keys starts with ``eval_``; eval keys
    lose the prefix (``epoch`` is kept too), train entries keep the train keys;
    non-numeric (NULL) values are dropped.  ``idx`` is the 0-based position in
    the series, ordered by step.
    """
    from pyspark.sql import Window
    # dealt by run and step into parts of bounded size: what the entries come from may be dealt
    # by run alone, and then a task would sort all entries of a run
    num = stored(events.filter(F.col("value").isNotNull()).select("run", "step", "key", "value"), "entries")
    n = max(int(num.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-num.count() // ENTRIES))
    is_eval = F.max(F.col("key").startswith("eval_").cast("int")).over(Window.partitionBy("run", "step")) == 1
    e = num.repartition(n, "run", "step").withColumn("_eval", is_eval)
    kept = F.when(F.col("_eval"), F.col("key").startswith("eval_") | (F.col("key") == "epoch")) \
            .when(~F.col("_eval"), F.col("key").isin(list(TRAIN_KEYS)))
    s = e.filter(kept).select(
        "run", "step", F.when(F.col("_eval"), "eval").otherwise("train").alias("phase"),
        F.when(F.col("_eval"), F.regexp_replace("key", "^eval_", "")).otherwise(F.col("key")).alias("metric"), "value")
    # one series can hold a large share of all entries: distributed numbering
    s = with_row_number(s, [F.col("step").asc()], name="_i", groups=["run", "phase", "metric"], num_partitions=n)
    return s.withColumn("idx", (F.col("_i") - 1).cast("long")).drop("step", "_i")


def align_history(series: DataFrame) -> DataFrame:
    """Truncate each phase to its shortest series and align train and eval by
    position: ``(run, idx, metric_name, value)`` with ``train_`` prefixed names."""
    lens = series.groupBy("run", "phase", "metric").agg(F.count(F.lit(1)).alias("_n"))
    mins = lens.groupBy("run", "phase").agg(F.min("_n").alias("_min"))
    t = series.join(mins, ["run", "phase"]).filter(F.col("idx") < F.col("_min"))
    name = F.when(F.col("phase") == "train", F.concat(F.lit("train_"), F.col("metric"))).otherwise(F.col("metric"))
    return t.select("run", "idx", name.alias("column"), "value")
