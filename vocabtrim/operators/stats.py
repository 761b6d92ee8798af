"""Corpus token statistics.

All per-split figures come from one word-level aggregate; rankings use the
distributed row number, grouped by split, so a split holding most of the
corpus is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import materialize, with_row_number
from .tokens import token_counts_from_words

COVERAGE_POINTS = (0.1, 0.2, 0.5)
OVERLAP_TOP = 0.2


def _floor_frac(p: float, n):
    """``int(p * n)`` with a double product, as the reference computes it."""
    return F.floor(F.lit(float(p)) * n).cast("long")


def ranked_counts(counts: DataFrame, by=("split",)) -> DataFrame:
    """W1 twice: frequency rank and burstiness (count/df, A5) rank, ties by id."""
    by = list(by)
    r = with_row_number(counts, [F.col("cnt").desc(), F.col("token_id").asc()], name="rank_freq", groups=by)
    r = r.withColumn("burstiness", F.when(F.col("df") > 0, F.col("cnt") / F.col("df")).otherwise(F.lit(0.0)))
    return with_row_number(r, [F.col("burstiness").desc(), F.col("token_id").asc()], name="rank_imp", groups=by)


def token_stats(word_rows: DataFrame | None, vocab: DataFrame, vocab_rows: int, by=("split",),
                counts: DataFrame | None = None) -> DataFrame:
    """A7 per group: total, unique, vocabulary coverage, top-p coverage (W6), overlap.

    ``counts`` (``by..., token_id, cnt, df``) can be passed in when another job
    already materialised them; otherwise they are computed from ``word_rows``.
    """
    by = list(by)
    if counts is None:
        counts = materialize(token_counts_from_words(word_rows, vocab, by))
    ranked = ranked_counts(counts, by)
    sizes = counts.groupBy(*by).agg(F.sum("cnt").alias("total_tokens"),
                                    F.count(F.lit(1)).alias("unique_tokens"))
    # one row per split: a bounded table joined back by split (not a cross join)
    j = ranked.join(F.broadcast(sizes), by)
    u = F.col("unique_tokens")
    top_n = _floor_frac(OVERLAP_TOP, u)
    aggs = [F.first("total_tokens").alias("total_tokens"), F.first("unique_tokens").alias("unique_tokens")]
    for p in COVERAGE_POINTS:
        aggs.append(F.sum(F.when(F.col("rank_freq") <= _floor_frac(p, u) + 1, F.col("cnt")).otherwise(0))
                    .alias(f"_c{int(p * 100)}"))
    aggs.append(F.sum(F.when((F.col("rank_freq") <= top_n) & (F.col("rank_imp") <= top_n), 1).otherwise(0))
                .alias("_both"))
    agg = j.groupBy(*by).agg(*aggs)
    out = agg.select(
        *by, F.col("total_tokens").cast("long").alias("total_tokens"),
        F.col("unique_tokens").cast("long").alias("unique_tokens"),
        (F.col("unique_tokens") / F.lit(float(vocab_rows)) * 100).alias("vocab_coverage_pct"),
        *[F.when(u > 10, F.col(f"_c{int(p * 100)}") / F.col("total_tokens") * 100).otherwise(F.lit(100.0))
          .alias(f"top{int(p * 100)}_coverage_pct") for p in COVERAGE_POINTS],
        F.when(_floor_frac(OVERLAP_TOP, u) > 0, F.col("_both") / _floor_frac(OVERLAP_TOP, u) * 100)
         .otherwise(F.lit(100.0)).alias("freq_importance_overlap_pct"))
    return out


def vocab_overlap(train_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Test types missing from train (n, %) and their occurrences (n, %), zero-safe.

    Inputs are ``(token_id, cnt)`` tables; one full outer join on token id.
    """
    t = train_counts.select("token_id", F.col("cnt").alias("train_cnt"))
    s = test_counts.select("token_id", F.col("cnt").alias("test_cnt"))
    j = t.join(s, "token_id", "full_outer")
    agg = j.agg(
        F.sum(F.when(F.col("test_cnt").isNotNull() & F.col("train_cnt").isNull(), 1).otherwise(0)).alias("oov_types"),
        F.sum(F.when(F.col("test_cnt").isNotNull(), 1).otherwise(0)).alias("test_types"),
        F.sum(F.when(F.col("train_cnt").isNull(), F.col("test_cnt")).otherwise(0)).alias("oov_occ"),
        F.sum(F.coalesce(F.col("test_cnt"), F.lit(0))).alias("test_occ"))
    return agg.select(
        F.col("oov_types").cast("long").alias("test_unique_not_in_train"),
        F.when(F.col("test_types") > 0, F.col("oov_types") / F.col("test_types") * 100).otherwise(F.lit(0.0))
         .alias("test_unique_not_in_train_pct"),
        F.col("oov_occ").cast("long").alias("test_oov_occurrences"),
        F.when(F.col("test_occ") > 0, F.col("oov_occ") / F.col("test_occ") * 100).otherwise(F.lit(0.0))
         .alias("test_oov_occurrences_pct"))
