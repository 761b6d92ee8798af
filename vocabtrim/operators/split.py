"""Deterministic stratified splits and folds.

Sizes follow the usual shuffle-split rules (``floor(train_ratio * n)`` for a
train fraction, ``ceil(test_ratio * n)`` for a test fraction); per-class
allocation is largest remainder (ties by class), which gives the same class
balance a stratified shuffle split gives.  Which rows land where is a seeded,
engine-portable order, ``md5(seed || ':' || example_id)``, numbered per class
with the distributed row number, so a class holding most rows is never moved
into a single task.  Quotas are a table with one row per class; rows
without a label are a class of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import materialize, scalar, with_row_number

MAX_CLASSES = 10_000


def hash_order(seed: int, id_col: str = "example_id"):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def allocate(counts: dict, n_draws: int) -> dict:
    """Largest-remainder allocation of ``n_draws`` over classes (ties: class order)."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    cont = {k: c * n_draws / n for k, c in counts.items()}
    take = {k: math.floor(v) for k, v in cont.items()}
    need = n_draws - sum(take.values())
    order = sorted(counts, key=lambda k: (-(cont[k] - take[k]), k))
    for k in order[:need]:
        take[k] += 1
    return take


def train_size(n: int, ratio: float) -> int:
    return int(math.floor(ratio * n))


def test_size(n: int, ratio: float) -> int:
    return int(math.ceil(ratio * n))


def _ranked(df: DataFrame, seed: int, label: str | None, name: str = "_r") -> DataFrame:
    order = [hash_order(seed).asc(), F.col("example_id").asc()]
    return with_row_number(df, order, name=name, groups=[label] if label else ())


def class_table(df: DataFrame, label: str) -> DataFrame:
    """``(_class, _c)``: rows per class, written once."""
    return materialize(df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_c")))


def quotas(classes: DataFrame, n_draws: int) -> DataFrame:
    """The largest-remainder rule of ``allocate`` as a table ``(_class, _q)``."""
    n = int(scalar(classes, F.sum("_c")) or 0)
    share = F.col("_c").cast("double") * F.lit(float(n_draws)) / F.lit(float(max(n, 1)))
    c = classes.withColumn("_take", F.floor(share)).withColumn("_rest", share - F.floor(share))
    need = n_draws - int(scalar(c, F.sum("_take")) or 0)
    ranked = with_row_number(c, [F.col("_rest").desc(), F.col("_class").asc()], name="_o")
    return ranked.select("_class", (F.col("_take") + F.when(F.col("_o") <= need, 1).otherwise(0)).alias("_q"))


def _by_class(rows: DataFrame, per_class: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Join a per-class table to the rows, NULL labels included; it is broadcast only while
    the number of classes is within ``MAX_CLASSES``."""
    if scalar(classes, F.count(F.lit(1))) <= MAX_CLASSES:
        per_class = F.broadcast(per_class)
    return rows.join(per_class, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def take_first(df: DataFrame, n_first: int, seed: int = 42, label: str | None = "label",
               flag: str = "_first") -> DataFrame:
    """Flag the first ``n_first`` rows (stratified by ``label`` when given)."""
    if label is None:
        r = _ranked(df, seed, None)
        return r.withColumn(flag, F.col("_r") <= n_first).drop("_r")
    classes = class_table(df, label)
    r = _by_class(_ranked(df, seed, label), quotas(classes, n_first), classes, label)
    return r.withColumn(flag, F.col("_r") <= F.col("_q")).drop("_r", "_q")


def split_train_test(df: DataFrame, train_ratio: float = 0.9, seed: int = 42,
                     label: str | None = "label") -> DataFrame:
    """D2 (and D3 with ``label=None``): ``part`` = train / test of one pool."""
    n = df.count()
    k = train_size(n, train_ratio)
    out = take_first(df, k, seed, label)
    return out.withColumn("part", F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def split3(df: DataFrame, ratios=(0.8, 0.1, 0.1), seed: int = 42, label: str | None = "label") -> DataFrame:
    """Train ``r``, then validation/test by the adjusted ratio ``v / (v + t)``."""
    r, v, t = ratios
    if abs(r + v + t - 1.0) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    first = split_train_test(df, r, seed, label)
    rest = first.filter(F.col("part") == "test").drop("part")
    second = split_train_test(rest, v / (v + t), seed, label)
    second = second.withColumn("part", F.when(F.col("part") == "train", "validation").otherwise("test"))
    return first.filter(F.col("part") == "train").unionByName(second)


def kfold(df: DataFrame, k: int = 5, test_ratio: float = 0.1, seed: int = 42,
          label: str | None = "label") -> DataFrame:
    """D4 (stratified) / D5 (``label=None``): a common hold-out test set, then
    ``fold`` 0..k-1 for the rest (test rows have ``fold`` NULL)."""
    n = df.count()
    n_test = test_size(n, test_ratio)
    marked = take_first(df, n - n_test, seed, label)
    test = marked.filter(~F.col("_first")).drop("_first").withColumn("part", F.lit("test")) \
                 .withColumn("fold", F.lit(None).cast("int"))
    pool = marked.filter(F.col("_first")).drop("_first")
    return test.unionByName(assign_folds(pool, k, seed, label).withColumn("part", F.lit("train")))


def assign_folds(pool: DataFrame, k: int, seed: int = 42, label: str | None = "label") -> DataFrame:
    if label is None:
        n = pool.count()
        q, m = divmod(n, k)
        r = _ranked(pool, seed + 1, None)
        pos = F.col("_r") - 1
        big = m * (q + 1)
        fold = F.when(pos < big, F.floor(pos / (q + 1))).otherwise(
            F.lit(m) + F.floor((pos - big) / F.lit(max(q, 1))))
        return r.withColumn("fold", fold.cast("int")).drop("_r")
    # dealing the label-sorted order round robin: one numbering over (label, hash)
    order = [F.col(label).asc(), hash_order(seed + 1).asc(), F.col("example_id").asc()]
    r = with_row_number(pool, order, name="_r")
    return r.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r")


def label_distribution(df: DataFrame, by: str = "part", label: str = "label") -> DataFrame:
    """Count and percent per (part, label); classes missing from a part -> 0.

    Every class gets a zero for every part (a split has a few, fetched as literals), and
    one aggregate adds the counts, so there may be any number of classes; rows without
    a label are a class of their own.
    """
    counts = materialize(df.groupBy(by, F.col(label).cast("double").alias(label)).agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_t"))
    parts = [r[0] for r in totals.select(by).collect()]
    if parts:
        zeros = counts.select(label).distinct().select(F.explode(F.array(*map(F.lit, parts))).alias(by), label,
                                                       F.lit(0).cast("long").alias("n"))
        counts = counts.unionByName(zeros).groupBy(by, label).agg(F.sum("n").alias("n"))
    totals = totals.withColumnRenamed(by, "_part")
    return (counts.join(totals, F.col(by).eqNullSafe(F.col("_part")))
                  .select(by, label, "n", (F.col("n") / F.col("_t") * 100).alias("pct")))
