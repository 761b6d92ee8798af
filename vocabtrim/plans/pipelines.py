"""User-level jobs (M1-M15): one call per pruning method or report, as a
DataFrame program.  ``prune(method, ...)`` is the pluggable-method registry.

Every job returns lazily planned DataFrames (budgets are the only values
computed on the driver); model training and inference are outside: predictions
and attention weights come in as tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import cluster_removed, prune_by_cluster
from ..operators.encoding import encode_pair, pair_arrays
from ..operators.importance import attention_importance, count_texts, tfidf_importance, word_importance
from ..functions.text import UNK_ID
from ..operators.metrics import all_metrics_long, task_metrics
from ..operators.ordering import materialize
from ..operators.rank import (keep_by_parameters, keep_by_percent, keep_by_percent_grouped, keep_random,
                              keep_random_by_parameters, removed, sorted_map)
from ..operators.remap import reduce_embeddings, reduction_report, remap, remap_hybrid
from ..operators.report import parse_logs, performance_drop, read_summary, run_summary, scan_logs, with_sizes
from ..operators.split import kfold, split_train_test
from ..operators.stats import token_stats, vocab_overlap
from ..operators.tokens import counting_words, encode, texts, token_counts_from_words, words
from ..sources.corpus import task_metadata


@dataclass
class PruneResult:
    token_map: DataFrame            # (token_id, new_id)
    oov: DataFrame | None           # (token_id, rep_id) for the OOV methods
    embeddings: DataFrame | None    # (new_id, embedding)
    report: DataFrame               # one row of reduction figures (A11)


def _counts(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    return token_counts_from_words(counting_words(texts(corpus), add_special_tokens=True), vocab)


@dataclass
class PruneJob:
    """What a pruning method sees: the counts of the fitting corpus and the parameters of the call."""
    counts: DataFrame               # (token_id, cnt, df)
    corpus: DataFrame
    vocab: DataFrame                # (word, token_id)
    vocab_rows: int
    embeddings: DataFrame | None    # (token_id, embedding)
    p: float
    dim: int
    total_params: int | None
    param_based: bool
    seed: int
    options: dict

    def vectors(self) -> DataFrame:
        return self.embeddings.select("token_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))

    def best(self, scores: DataFrame, score: str = "cnt") -> DataFrame:
        """Keep list of the best scores under the call's budget."""
        if self.param_based and self.total_params:
            return keep_by_parameters(scores, self.p, self.vocab_rows, self.dim, self.total_params, score=score)
        return keep_by_percent(scores, self.p, score=score)

    def with_oov(self, tm: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The keep list with representatives of what it removes (C5), and their map."""
        oov, keep = cluster_removed(removed(self.counts, tm), tm, self.vectors(), self.options.get("num_clusters", 50), self.seed)
        return keep, oov


METHODS: dict[str, Callable] = {}


def register_method(name: str):
    """Register a pruning method: a function of a :class:`PruneJob` that returns its token map
    ``(token_id, new_id)``, or the map and the representatives ``(token_id, rep_id)``."""
    def add(fn):
        METHODS[name] = fn
        return fn
    return add


@register_method("no_pruning")
def _no_pruning(job: PruneJob):
    return job.vocab.select("token_id", F.col("token_id").alias("new_id"))


@register_method("train_only")
def _train_only(job: PruneJob):
    return sorted_map(job.counts)


@register_method("frequency")
def _frequency(job: PruneJob):
    return job.best(job.counts)


@register_method("frequency_oov")
def _frequency_oov(job: PruneJob):
    return job.with_oov(job.best(job.counts))


@register_method("importance")
def _importance(job: PruneJob):
    kind = job.options.get("importance_type", 3)
    tf = None if kind == 0 else tfidf_importance(texts(job.corpus), count_texts(texts(job.corpus)), kind)
    scores = word_importance(job.counts, job.vocab, tf)
    return job.best(scores.select("token_id", F.round("importance", 6).alias("importance")), "importance")


@register_method("importance_oov")
def _importance_oov(job: PruneJob):
    return job.with_oov(_importance(job))


@register_method("attention")
def _attention(job: PruneJob):
    scores = attention_importance(job.options["attention"], job.options["attention_tokens"], job.counts)
    return job.best(scores.select("token_id", F.round("importance", 6).alias("importance")), "importance")


@register_method("random")
def _random(job: PruneJob):
    if job.param_based and job.total_params:
        return keep_random_by_parameters(job.counts, job.p, job.vocab_rows, job.dim, job.total_params, job.seed)
    return keep_random(job.counts, job.p, job.seed)


@register_method("clustering")
def _clustering(job: PruneJob):
    budget = dict(vocab_rows=job.vocab_rows, dim=job.dim, total_params=job.total_params) if job.param_based else {}
    return prune_by_cluster(job.counts, job.vectors(), job.p, job.seed,
                            method=job.options.get("clustering_method", "agglomerative"), **budget)


def prune(method: str, corpus: DataFrame, vocab: DataFrame, vocab_rows: int, embeddings: DataFrame | None = None,
          p: float = 20.0, dim: int = 768, total_params: int | None = None, param_based: bool = False,
          seed: int = 42, **options) -> PruneResult:
    """M1-M9 by name: frequency, frequency_oov, importance, importance_oov, random,
    attention, clustering, train_only, no_pruning, or a method of :func:`register_method`.
    ``corpus`` is the fitting corpus (e.g. the train split); ``embeddings`` is ``(token_id,
    embedding)``.  Options: num_clusters, importance_type, attention, attention_tokens,
    clustering_method (agglomerative, kmeans, dbscan) and those of registered methods."""
    if method not in METHODS:
        raise ValueError(f"unknown pruning method {method!r}")
    job = PruneJob(_counts(corpus, vocab), corpus, vocab, vocab_rows, embeddings, p, dim, total_params, param_based,
                   seed, options)
    found = METHODS[method](job)
    tm, oov = found if isinstance(found, tuple) else (found, None)
    body = (total_params - vocab_rows * dim) if total_params else 0
    emb = reduce_embeddings(tm, embeddings) if embeddings is not None else None
    return PruneResult(tm, oov, emb, reduction_report(tm, vocab_rows, dim, body))


def prepare(corpus: DataFrame, vocab: DataFrame, result: PruneResult, max_length: int = 128) -> DataFrame:
    """Encode every split to fixed length and rewrite it with the token map."""
    enc = encode_pair(pair_arrays(encode(words(texts(corpus), keep_empty=True, limit=max_length - 2), vocab)),
                      max_length)
    enc = enc.join(corpus.select("example_id", "split", "label"), "example_id")
    tm = result.token_map
    if result.oov is not None:
        return remap_hybrid(enc, tm, result.oov, keys=("example_id",))
    return remap(enc, tm, keys=("example_id",))


def token_statistics(corpus: DataFrame, vocab: DataFrame, vocab_rows: int, seed: int = 42) -> DataFrame:
    """Stratified 0.9 / 0.1 split of the train split, statistics per part and the overlap."""
    parts = split_train_test(corpus.filter(F.col("split") == "train").select("example_id", "label"), 0.9, seed)
    w = counting_words(texts(corpus.drop("split").join(parts.select("example_id", F.col("part").alias("split")),
                                                           "example_id")))
    c = materialize(token_counts_from_words(w, vocab, by=["split"]))
    stats = token_stats(None, vocab, vocab_rows, counts=c)
    return stats, vocab_overlap(c.filter(F.col("split") == "train"), c.filter(F.col("split") == "test"))


def other_folds(own: DataFrame, k: int) -> DataFrame:
    """Counts of every fold's training part, ``(fold, token_id, cnt)``: the token's total less
    its count in the fold itself (``own``), so the corpus is counted once for all folds."""
    total = own.groupBy("token_id").agg(F.sum("cnt").alias("_t"))
    every = total.select("token_id", "_t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return (every.join(own, ["fold", "token_id"], "left")
                 .select("fold", "token_id", (F.col("_t") - F.coalesce("cnt", F.lit(0))).alias("cnt"))
                 .filter(F.col("cnt") > 0))


def cross_validate(corpus: DataFrame, vocab: DataFrame, predictions: DataFrame, tasks: DataFrame, p: float = 20.0,
                   k: int = 5, seed: int = 42, max_length: int = 128):
    """M12 (data side): D4 folds of ``corpus``.  Each fold has the frequency keep list of the
    other folds; its own rows are encoded and rewritten with that list (J1, one grouped job) and
    its predictions scored with the metrics of ``tasks`` (one task, A16).

    Returns ``(results (fold, metric, value), token maps (fold, token_id, new_id), rewritten
    rows)``; the results, with ``kept_tokens`` and ``unk_rate``, go into ``cv_summary`` and
    ``best_fold``."""
    folds = materialize(kfold(corpus.select("example_id", "label"), k, 0.1, seed)
                        .filter(F.col("part") == "train").select("example_id", "fold"))
    rows = texts(corpus.join(folds, "example_id"), extra=("fold",)).drop("split", "label")
    own = materialize(token_counts_from_words(words(rows, add_special_tokens=True), vocab, ["fold"], with_df=False))
    maps = materialize(keep_by_percent_grouped(other_folds(own, k), p, ["fold"]))
    enc = encode_pair(pair_arrays(encode(words(rows, keep_empty=True, limit=max_length - 2), vocab)), max_length)
    enc = materialize(remap(enc.drop("ids_a", "ids_b").join(folds, "example_id"), maps, keys=("example_id",),
                            by=("fold",)))
    real = F.filter(F.arrays_zip("input_ids", "attention_mask"), lambda x: x["attention_mask"] == 1)
    unk = (enc.select("fold", F.size(real).alias("_n"), F.size(F.filter(real, lambda x: x["input_ids"] == UNK_ID)).alias("_u"))
              .groupBy("fold").agg(F.lit("unk_rate").alias("metric"), (F.sum("_u") / F.sum("_n")).alias("value")))
    kept = maps.groupBy("fold").agg(F.lit("kept_tokens").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
    scored = all_metrics_long(predictions.join(folds, "example_id"), ["fold"]) \
        .join(tasks.select(F.explode("metrics").alias("metric")).distinct(), "metric").select("fold", "metric", "value")
    return scored.unionByName(kept).unionByName(unk), maps, enc


def standard_run(test_predictions: DataFrame, tasks: DataFrame, result: PruneResult) -> DataFrame:
    """M13 (data side): the task's metrics (A16) on the test part next to the reduction figures."""
    m = task_metrics(test_predictions, tasks)
    rep = result.report.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in result.report.columns])).alias("r")).select("r.metric", "r.value")
    return m.select(F.concat(F.lit("test_"), F.col("metric")).alias("metric"), "value").unionByName(rep)


def summarise_runs(spark, log_glob: str, strict_legacy: bool = False) -> DataFrame:
    """Every run log -> one row of test metrics and reductions."""
    logs = scan_logs(spark, log_glob)
    m = parse_logs(logs, strict_legacy).withColumn(
        "task", F.regexp_extract("path", r"([^/]+?)(?:_[^/_]*)?\.log$", 1))
    return run_summary(m)


def compare_methods(spark, summary_path: str) -> DataFrame:
    """The summary file -> drop from the baseline (pp) with dataset sizes."""
    res = read_summary(spark, summary_path)
    return with_sizes(performance_drop(res), task_metadata(spark))
