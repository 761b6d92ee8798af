"""Model-input encoding: fixed-length pairs, batching and collation.

All array work is plain Spark array functions (``slice``, ``concat``,
``array_repeat``); lengths come from a closed form of longest-first
truncation, so no per-token loop exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CLS_ID, PAD_ID, SEP_ID
from .ordering import with_row_number


def pair_arrays(tokens: DataFrame) -> DataFrame:
    """Token rows ``(example_id, side, pos, token_id)`` -> ``(example_id, ids_a, ids_b)``.

    One shuffle by example; side ``b`` is NULL for single-text corpora.  A row without
    a token stands for an empty text, which gives an empty array.  Tokens cut to a first
    part (``n_words`` from ``words(limit=...)``) also give the full lengths ``len_a, len_b``.
    """
    cut = "n_words" in tokens.columns
    full = [F.max(F.when(F.col("side") == s, F.col("n_words"))).alias(f"len_{s}") for s in ("a", "b")] if cut else []
    g = tokens.groupBy("example_id").agg(
        F.sort_array(F.collect_list(F.struct("side", "pos", "token_id"))).alias("_t"), *full)
    ids = lambda side: F.transform(
        F.filter("_t", lambda x: (x["side"] == side) & x["token_id"].isNotNull()), lambda x: x["token_id"])
    has_b = F.exists("_t", lambda x: x["side"] == "b")
    return g.select("example_id", ids("a").alias("ids_a"),
                    F.when(has_b, ids("b")).alias("ids_b"), *(["len_a", "len_b"] if cut else []))


def truncated_lengths(la: Column, lb: Column, budget: Column | int):
    """Longest-first truncation to ``budget`` tokens: (kept_a, kept_b).

    The longer side is cut first; once both are equal they lose tokens in turn,
    the second side first — so the result is (ceil(B/2), floor(B/2)) whenever
    cutting only the longer side is not enough.
    """
    b = budget if isinstance(budget, Column) else F.lit(budget)
    excess = la + lb - b
    longer_only = F.greatest(la, lb) - excess >= F.least(la, lb)
    a_keep = (F.when(excess <= 0, la)
               .when(longer_only, F.when(la >= lb, la - excess).otherwise(la))
               .otherwise(F.ceil(b / 2)))
    b_keep = (F.when(excess <= 0, lb)
               .when(longer_only, F.when(la >= lb, lb).otherwise(lb - excess))
               .otherwise(F.floor(b / 2)))
    return a_keep.cast("int"), b_keep.cast("int")


def encode_pair(pairs: DataFrame, max_length: int = 128, pad: bool = True, pad_id: int = PAD_ID,
                cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> DataFrame:
    """``[CLS] a [SEP] (b [SEP])``, longest-first truncation to ``max_length``,
    right padding with ``pad_id`` and an attention mask (``pad=False``: no padding).

    Sides may come cut to their first ``max_length - 2`` ids with the full lengths in
    ``len_a, len_b``: truncation goes by the full lengths and never keeps more than that."""
    cut = "len_a" in pairs.columns
    la = F.coalesce("len_a", F.lit(0)) if cut else F.size("ids_a")
    lb = F.coalesce("len_b", F.lit(0)) if cut else F.coalesce(F.size("ids_b"), F.lit(0))
    single = F.col("ids_b").isNull()
    budget = F.when(single, F.lit(max_length - 2)).otherwise(F.lit(max_length - 3))
    ka, kb = truncated_lengths(la, F.when(single, F.lit(0)).otherwise(lb), budget)
    cls, sep = F.array(F.lit(cls_id)), F.array(F.lit(sep_id))
    a_part = F.when(ka > 0, F.slice("ids_a", 1, ka)).otherwise(F.array().cast("array<int>"))
    b_part = F.when(kb > 0, F.slice("ids_b", 1, kb)).otherwise(F.array().cast("array<int>"))
    head = F.concat(cls, a_part, sep)
    ids = F.when(single, head).otherwise(F.concat(head, b_part, sep))
    out = pairs.withColumn("input_ids", ids).drop("len_a", "len_b")
    n = F.size("input_ids")
    if pad:
        out = out.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n),
                                                        F.array_repeat(F.lit(0), F.lit(max_length) - n)))
        out = out.withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), F.lit(max_length) - n)))
    else:
        out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), n))
    return out


def with_batch(df: DataFrame, batch_size: int, order=("example_id",), name: str = "batch") -> DataFrame:
    """``floor((row_number - 1) / batch_size)`` in input order, which names each row.

    Only the ``order`` columns are numbered; the rows themselves are joined with their
    number and neither sorted nor checkpointed."""
    keys = list(order)
    r = with_row_number(df.select(*keys), [F.col(c).asc() for c in keys], name="_bn")
    r = r.select(*[F.col(c).alias(f"_o_{c}") for c in keys], F.floor((F.col("_bn") - 1) / F.lit(batch_size)).cast("long").alias(name))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return df.join(r, same).drop(*[f"_o_{c}" for c in keys])


def pad_batches(df: DataFrame, pad_id: int = 0, ids: str = "input_ids", mask: str = "attention_mask",
                batch: str = "batch") -> DataFrame:
    """Pad ids with ``pad_id`` and the mask with 0 to the longest row of the batch.
    A batch holds ``batch_size`` rows, so the window group is bounded."""
    w = Window.partitionBy(batch)
    m = F.max(F.size(ids)).over(w)
    out = df.withColumn("_m", m)
    out = out.withColumn(mask, F.concat(F.coalesce(F.col(mask), F.array_repeat(F.lit(1), F.size(ids))),
                                        F.array_repeat(F.lit(0), F.col("_m") - F.size(ids))))
    return out.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad_id), F.col("_m") - F.size(ids)))).drop("_m")


def prediction_only(df: DataFrame, label: str = "labels", batch: str = "batch") -> DataFrame:
    """Flag batches that contain an unlabelled row (label -1)."""
    return df.withColumn("prediction_only", F.max((F.col(label) == -1).cast("int")).over(Window.partitionBy(batch)) == 1)


def standardise_label(df: DataFrame) -> DataFrame:
    """P10: rename ``label`` -> ``labels`` unless ``labels`` exists."""
    if "labels" in df.columns or "label" not in df.columns:
        return df
    return df.withColumnRenamed("label", "labels")


def label_or_default(df: DataFrame) -> DataFrame:
    """``labels``, else ``label``, else 0."""
    cols = [F.col(c) for c in ("labels", "label") if c in df.columns]
    return df.withColumn("labels", F.coalesce(*cols, F.lit(0)).cast("double") if cols else F.lit(0.0))


def head_sample(df: DataFrame, n: int, order=("example_id",)) -> DataFrame:
    """The first ``min(n, rows)`` rows in ``order`` (the sample is the feature)."""
    return df.orderBy(*order).limit(n)
