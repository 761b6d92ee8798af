"""Token importance scores.

TF-IDF follows the vectorizer the reference fits: raw term counts, smooth idf
``ln((1+N)/(1+df)) + 1``, per-text norm (none / L1 / L2 for importance type
1 / 2 / 3), then the mean over all N texts (texts without the word count as 0).
Spark ML's ``IDF`` uses a different formula (no ``+1``), so it is written here
with joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import stop_words_df
from .ordering import scalar
from .tokens import counting_words, text_word_counts, word_counts


def tfidf_importance(text_rows: DataFrame, n_texts: int, importance_type: int = 3,
                     stop_words: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """A4: ``(word, tfidf)`` mean TF-IDF per feature word over ``n_texts`` texts.

    ``counts`` (``word, cnt, df`` over the same texts) can come from an already materialised
    count table; otherwise the texts are counted first.  Type 1 has no norm, so the sum over
    texts is ``cnt * idf`` and needs no row a text.  For the others a text's words are
    counted inside its row, its distinct words meet their idf, and go back to the text once,
    where the norm is taken."""
    if importance_type not in (1, 2, 3):
        raise ValueError("importance_type must be 1, 2 or 3 for TF-IDF")
    stop = stop_words if stop_words is not None else stop_words_df(text_rows.sparkSession)
    wc = counts if counts is not None else word_counts(counting_words(text_rows))
    wc = wc.join(F.broadcast(stop), "word", "left_anti")  # ~180 rows: fixed bound
    idf = F.log((F.lit(1.0) + n_texts) / (F.lit(1.0) + F.col("df"))) + 1
    n = F.lit(float(n_texts))
    if importance_type == 1:
        return wc.select("word", (F.col("cnt") * idf / n).alias("tfidf"))
    tf = (text_word_counts(text_rows).join(wc.select("word", idf.alias("idf")), "word")
          .select("example_id", "side", "word", (F.col("tf") * F.col("idf")).alias("w")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w"))) if importance_type == 3 else F.sum(F.abs("w"))
    # one row a text holds its distinct words
    per_text = tf.groupBy("example_id", "side").agg(norm.alias("norm"), F.collect_list(F.struct("word", "w")).alias("ws"))
    back = per_text.select("norm", F.inline("ws"))
    return back.groupBy("word").agg((F.sum(F.col("w") / F.col("norm")) / n).alias("tfidf"))


def count_texts(text_rows: DataFrame) -> int:
    return int(scalar(text_rows, F.count(F.lit(1))))


def word_importance(counts: DataFrame, vocab: DataFrame, tfidf: DataFrame | None,
                    fallback: str = "count") -> DataFrame:
    """Token -> word -> mean TF-IDF; tokens whose word is not a feature keep
    their count (``fallback="count"``, as shipped) or 0 (``"zero"``).
    ``tfidf=None`` is importance type 0: the counts themselves."""
    if tfidf is None:
        return counts.select("token_id", F.col("cnt").cast("double").alias("importance"))
    j = counts.join(vocab, "token_id", "left").join(tfidf, "word", "left")
    fb = F.col("cnt").cast("double") if fallback == "count" else F.lit(0.0)
    return j.select("token_id", F.coalesce(F.col("tfidf"), fb).alias("importance"))


def burstiness(counts: DataFrame) -> DataFrame:
    """A5: count / document frequency, 0 when df is 0."""
    return counts.withColumn("burstiness",
                             F.when(F.col("df") > 0, F.col("cnt") / F.col("df")).otherwise(F.lit(0.0)))


def attention_importance(weights: DataFrame, tokens: DataFrame, vocab_ids: DataFrame,
                         include_padding: bool = True) -> DataFrame:
    """Per key position, mean over heads and layers of the column sum over
    query rows; then the mean over a token's occurrences; unseen tokens -> 0.

    ``weights``: (example_id, layer, head, q_pos, k_pos, is_pad, weight);
    ``tokens``: (example_id, pos, token_id); ``vocab_ids``: (token_id).
    """
    w = weights if include_padding else weights.filter(~F.col("is_pad"))
    lh = w.groupBy("example_id").agg(
        (F.count_distinct("layer") * F.count_distinct("head")).alias("_lh"))
    per_key = (w.groupBy("example_id", "k_pos").agg(F.sum("weight").alias("_s"))
                .join(lh, "example_id").select("example_id", F.col("k_pos").alias("pos"),
                                               (F.col("_s") / F.col("_lh")).alias("_imp")))
    per_tok = (per_key.join(tokens.select("example_id", "pos", "token_id"), ["example_id", "pos"])
               .groupBy("token_id").agg(F.avg("_imp").alias("importance")))
    return (vocab_ids.select("token_id").distinct().join(per_tok, "token_id", "left")
            .select("token_id", F.coalesce(F.col("importance"), F.lit(0.0)).alias("importance")))
