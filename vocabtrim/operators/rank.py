"""Ranking, budgets, keep lists and dense re-indexing.

Budgets (how many tokens survive) are one-row numbers computed on the driver
from a count; the keep / remove split itself is a filter on a distributed rank.
A keep list is a DataFrame ``(token_id, new_id)`` in keep order (``new_id`` is
the dense position, W5), which is the ``token_map`` of the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import materialize, scalar, with_row_number

SPECIAL_IDS = (0, 1, 2, 3, 4)


def rank_tokens(scores: DataFrame, score: str = "cnt", name: str = "rank",
                exclude: Sequence[int] = ()) -> DataFrame:
    """1-based rank by ``score`` descending, ties by ``token_id`` ascending."""
    df = scores.filter(~F.col("token_id").isin(list(exclude))) if exclude else scores
    return with_row_number(df, [F.col(score).desc(), F.col("token_id").asc()], name=name)


def percent_keep_count(n_tokens: int, p: float, min_tokens: int = 5, n_special: int = 5) -> int:
    """W2 budget: ``max(min_tokens, int((n - 5) * (1 - p/100)))`` non-special tokens."""
    return max(min_tokens, int((n_tokens - n_special) * (1 - p / 100)))


def parameter_keep_count(n_tokens: int, n_non_special: int, p: float, vocab_rows: int, dim: int,
                         total_params: int, min_tokens: int = 5):
    """W3 budget; returns ``None`` when keeping the whole corpus vocabulary already meets it."""
    reduction = (vocab_rows - n_tokens) * dim
    if 100 * (reduction / total_params) >= p:
        return None
    extra = int(((p / 100) * total_params - reduction) / dim)
    extra = min(extra, n_non_special)
    return max(min_tokens, n_non_special - extra)


def specials_map(spark, special_ids: Sequence[int] = SPECIAL_IDS) -> DataFrame:
    return spark.createDataFrame([(int(t), i) for i, t in enumerate(special_ids)], "token_id int, new_id int")


def keep_top(ranked: DataFrame, k: int, special_ids: Sequence[int] = SPECIAL_IDS,
             rank_col: str = "rank") -> DataFrame:
    """Specials first (always kept, present or not), then the top ``k`` ranks.

    ``ranked`` must exclude the special ids. Output ``(token_id, new_id)``.
    """
    top = ranked.filter(F.col(rank_col) <= k).select(
        F.col("token_id").cast("int"), (F.col(rank_col) + len(special_ids) - 1).cast("int").alias("new_id"))
    return specials_map(ranked.sparkSession, special_ids).unionByName(top)


def keep_by_percent(counts: DataFrame, p: float, score: str = "cnt", min_tokens: int = 5,
                    special_ids: Sequence[int] = SPECIAL_IDS) -> DataFrame:
    """W2 on a ``(token_id, score)`` table: the token budget of the ranked methods."""
    counts = materialize(counts.select("token_id", score))
    n = int(scalar(counts, F.count(F.lit(1))))
    k = percent_keep_count(n, p, min_tokens, len(special_ids))
    return keep_top(rank_tokens(counts, score, exclude=special_ids), k, special_ids)


def keep_by_parameters(counts: DataFrame, p: float, vocab_rows: int, dim: int, total_params: int,
                       score: str = "cnt", min_tokens: int = 5,
                       special_ids: Sequence[int] = SPECIAL_IDS) -> DataFrame:
    """Keep under a parameter budget; if the corpus vocabulary already meets it,
    keep exactly the corpus tokens (by score order, no specials added)."""
    counts = materialize(counts.select("token_id", score))
    n = int(scalar(counts, F.count(F.lit(1))))
    ranked = rank_tokens(counts, score, exclude=special_ids)
    ns = int(scalar(ranked, F.count(F.lit(1))))
    k = parameter_keep_count(n, ns, p, vocab_rows, dim, total_params, min_tokens)
    if k is None:
        allr = rank_tokens(counts, score)
        return allr.select(F.col("token_id").cast("int"), (F.col("rank") - 1).cast("int").alias("new_id"))
    return keep_top(ranked, k, special_ids)


def random_order(seed: int, token_id: Column) -> Column:
    """Seeded, engine-portable random order: ``md5(seed || ':' || token_id)``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), token_id.cast("string")))


def keep_random(counts: DataFrame, p: float, seed: int = 42, min_tokens: int = 5,
                special_ids: Sequence[int] = SPECIAL_IDS) -> DataFrame:
    """Keep ``max(min_tokens, int(ns * (1 - p/100)))`` non-special tokens at random."""
    ns_df = materialize(counts.select("token_id").filter(~F.col("token_id").isin(list(special_ids))))
    ns = int(scalar(ns_df, F.count(F.lit(1))))
    k = max(min_tokens, int(ns * (1 - p / 100)))
    ranked = with_row_number(ns_df.withColumn("_h", random_order(seed, F.col("token_id"))),
                             [F.col("_h").asc(), F.col("token_id").asc()], name="rank")
    return keep_top(ranked, k, special_ids)


def keep_random_by_parameters(counts: DataFrame, p: float, vocab_rows: int, dim: int, total_params: int,
                              seed: int = 42, min_tokens: int = 5,
                              special_ids: Sequence[int] = SPECIAL_IDS) -> DataFrame:
    """W4 under the parameter budget of W3; all corpus tokens, in id order, if they meet it."""
    ids = materialize(counts.select("token_id").distinct())
    n = int(scalar(ids, F.count(F.lit(1))))
    plain = ids.filter(~F.col("token_id").isin(list(special_ids)))
    ns = int(scalar(plain, F.count(F.lit(1))))
    k = parameter_keep_count(n, ns, p, vocab_rows, dim, total_params, min_tokens)
    if k is None:
        return sorted_map(ids)
    ranked = with_row_number(plain.withColumn("_h", random_order(seed, F.col("token_id"))),
                             [F.col("_h").asc(), F.col("token_id").asc()], name="rank")
    return keep_top(ranked, k, special_ids)


def sorted_map(token_ids: DataFrame) -> DataFrame:
    """W5 for the train-only method: new id = position in ascending id order."""
    r = with_row_number(token_ids.select("token_id").distinct(), [F.col("token_id").asc()], name="rank")
    return r.select(F.col("token_id").cast("int"), (F.col("rank") - 1).cast("int").alias("new_id"))


def removed(counts: DataFrame, keep: DataFrame) -> DataFrame:
    """Corpus tokens that are not kept (left-anti join on token id)."""
    return counts.join(keep.select("token_id"), "token_id", "left_anti")


def union_keep(first: DataFrame, extra: DataFrame, extra_order: str) -> DataFrame:
    """U4: append ``extra`` ids after ``first`` (a token map), skipping duplicates,
    in ``extra_order`` order; new ids continue densely."""
    base = int(scalar(first, F.count(F.lit(1))))
    add = extra.select("token_id", extra_order).join(first.select("token_id"), "token_id", "left_anti")
    r = with_row_number(add.dropDuplicates(["token_id"]), [F.col(extra_order).asc(), F.col("token_id").asc()],
                        name="_r")
    return first.unionByName(r.select(F.col("token_id").cast("int"),
                                      (F.col("_r") + base - 1).cast("int").alias("new_id")))


def keep_by_percent_grouped(counts: DataFrame, p: float, by: Sequence[str], score: str = "cnt",
                            min_tokens: int = 5, special_ids: Sequence[int] = SPECIAL_IDS,
                            random_seed: int | None = None) -> DataFrame:
    """W2 / W4 for many corpora in one job (one keep list per ``by`` group).

    Budgets come from a per-group count table (one row per group) joined back
    by key; ranks are numbered per group with the distributed row number.
    ``random_seed`` switches to the random keep (W4 budget on non-special tokens).
    Output ``(by..., token_id, new_id)``.
    """
    by = list(by)
    counts = materialize(counts.select(*by, "token_id", score))
    ns_df = counts.filter(~F.col("token_id").isin(list(special_ids)))
    base = ns_df if random_seed is not None else counts
    n = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sub = 0 if random_seed is not None else len(special_ids)
    k = n.select(*by, F.greatest(F.lit(min_tokens), F.floor((F.col("_n") - sub) * (1 - p / 100)).cast("long"))
                 .alias("_k"))
    if random_seed is not None:
        order = [random_order(random_seed, F.col("token_id")).asc(), F.col("token_id").asc()]
    else:
        order = [F.col(score).desc(), F.col("token_id").asc()]
    ranked = with_row_number(ns_df, order, name="rank", groups=by)
    top = ranked.join(k, by).filter(F.col("rank") <= F.col("_k")).select(
        *by, F.col("token_id").cast("int"), (F.col("rank") + len(special_ids) - 1).cast("int").alias("new_id"))
    spec = n.select(*by, F.explode(F.array(*[F.struct(F.lit(int(t)).alias("token_id"), F.lit(i).alias("new_id"))
                                          for i, t in enumerate(special_ids)])).alias("_s")) \
         .select(*by, "_s.token_id", "_s.new_id")
    return spec.unionByName(top)
