"""Id remapping, embedding gather and reduction report.

Remapping rewrites whole corpora, so it is written two ways:

* ``strategy="join"`` — explode the id arrays, equi-join the token map, and
  rebuild the arrays per text.  A map of bounded ids is broadcast; if the input is
  already hash-partitioned by example (it is right after :func:`sequences`),
  the rebuild needs no extra shuffle.  Rows that do not lie by example (``together=False``) are
  joined by blocks of rows (:mod:`.blocks`): the distinct ids of a block are exploded
  and joined, and its arrays rebuilt in it.
* ``strategy="map"`` — for a map whose largest id has been checked to be
  small, fold it into one dense lookup array (index = old id), broadcast that
  single row and rewrite every array with ``transform``: no explode and no
  shuffle of the corpus at all (Spark's MAP lookup scans keys; an array index
  does not).

``map`` is taken only when the largest old id is below ``MAP_LITERAL_LIMIT``, whoever asks;
beyond it the join is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import clamp
from .blocks import looked_up
from .ordering import scalar

MAP_LITERAL_LIMIT = 200_000
# a map whose largest id is below this is broadcast in the join strategy (<= ~16 MB)
BROADCAST_MAP_IDS = 2_000_000


def _lookup_row(spark, token_map: DataFrame, key: str, value: str, size: int, unk: int) -> DataFrame:
    """The whole (size-checked) map as one dense array row ``(_one, _lut)``:
    ``_lut[old_id + 1] = new_id`` (``unk`` where there is no entry), so a lookup
    is an O(1) array index instead of a scan over map keys."""
    dense = (spark.range(size).select(F.col("id").cast("int").alias("_k"))
             .join(token_map.select(F.col(key).cast("int").alias("_k"), F.col(value).cast("int").alias("_v")),
                   "_k", "left"))
    return (dense.agg(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_v", F.lit(unk)).alias("_v"))))
                      .alias("_ps"))
                 .select(F.transform("_ps", lambda s: s["_v"]).alias("_lut"), F.lit(1).alias("_one")))


def _choose(token_map: DataFrame, strategy: str) -> tuple[str, int]:
    """Pick the strategy from the largest old id (the dense array's length)."""
    top = scalar(token_map, F.max("token_id"))
    size = 0 if top is None else int(top) + 1
    if strategy == "join":
        return strategy, size
    # also for a caller that asks for the lookup row: its size is bounded
    return ("map" if size <= MAP_LITERAL_LIMIT else "join"), size


def _explode_join_rebuild(df: DataFrame, col: str, lookup: DataFrame, value_expr, keys, by=()) -> DataFrame:
    """Explode ``col``, look every id up (in the map of its ``by`` group), and rebuild the
    arrays per text.

    Other columns ride along (``first`` per text) instead of being joined back,
    and ``posexplode_outer`` keeps empty arrays as one NULL row, so the input is
    read once.
    """
    others = [c for c in df.columns if c not in keys and c != col]
    ex = df.select(*keys, *others, F.posexplode_outer(col).alias("_pos", "_old"))
    j = ex.withColumn("_k", F.col("_old")).join(lookup, [*by, "_k"], "left")
    j = j.select(*keys, *others, "_pos", value_expr.cast("int").alias("_new"))
    cell = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_new"))  # NULL cells are not collected
    return (j.groupBy(*keys)
             .agg(F.array_sort(F.collect_list(cell)).alias("_ps"), *[F.first(c).alias(c) for c in others])
             .select(*keys, *others, F.transform("_ps", lambda s: s["_new"]).alias(col)))


def remap(df: DataFrame, token_map: DataFrame, col: str = "input_ids", unk: int = 0,
          keys=("example_id", "side"), strategy: str = "auto", by=(), together: bool = True) -> DataFrame:
    """Replace every id of ``col`` by ``token_map.new_id``; ids without an entry -> ``unk``.
    With ``by`` the map holds one map a group (a fold, say) and each row uses that of its group.
    ``together``: the rows of ``keys`` lie in one partition, so that exploded rows need no shuffle."""
    if by:
        lookup = token_map.select(*by, F.col("token_id").alias("_k"), F.col("new_id").alias("_v"))
        return _explode_join_rebuild(df, col, lookup, F.coalesce(F.col("_v"), F.lit(unk)), keys, by)
    how, size = _choose(token_map, strategy)
    if how == "map":
        # one row of at most MAP_LITERAL_LIMIT ints (checked above): broadcast to every task
        lut = F.broadcast(_lookup_row(df.sparkSession, token_map, "token_id", "new_id", size, unk))
        j = df.withColumn("_one", F.lit(1)).join(lut, "_one")
        return j.withColumn(col, F.transform(col, lambda x: F.coalesce(
            F.try_element_at(F.col("_lut"), x + 1), F.lit(unk)))).drop("_one", "_lut")
    lookup = token_map.select(F.col("token_id").alias("_k"), F.col("new_id").alias("_v"))
    if not together:
        return looked_up(df, col, lookup, size, keys, unk)
    if size <= BROADCAST_MAP_IDS:
        # the id space is bounded (checked above): ship the map, keep the corpus in place,
        # so the rebuild reuses the input's partitioning by text
        lookup = F.broadcast(lookup)
    return _explode_join_rebuild(df, col, lookup, F.coalesce(F.col("_v"), F.lit(unk)), keys)


def hybrid_lookup(token_map: DataFrame, oov: DataFrame, mode: str = "intended",
                  size: int | None = None) -> DataFrame:
    """C6 / J2 lookup table ``(token_id, new_id)``.

    ``intended``: kept ids keep their new id, removed ids take the new id of their
    representative.  ``as_shipped``: the map is overwritten with the
    representatives' *original* ids and clamped into ``[0, size-1]``.
    """
    tm = token_map.select("token_id", "new_id")
    if mode == "intended":
        rep = (oov.join(tm.withColumnRenamed("token_id", "rep_id"), "rep_id", "inner")
                  .select("token_id", "new_id"))
        rep = rep.join(tm.select("token_id"), "token_id", "left_anti")
        return tm.unionByName(rep)
    if mode != "as_shipped":
        raise ValueError(mode)
    if size is None:
        size = int(scalar(tm, F.count(F.lit(1))))
    over = oov.select("token_id", F.col("rep_id").alias("new_id"))
    base = tm.join(over.select("token_id"), "token_id", "left_anti")
    return base.unionByName(over).select("token_id", clamp(F.col("new_id"), size).cast("int").alias("new_id"))


def remap_hybrid(df: DataFrame, token_map: DataFrame, oov: DataFrame, mode: str = "intended",
                 col: str = "input_ids", unk: int = 0, keys=("example_id", "side"),
                 strategy: str = "auto") -> DataFrame:
    """Remap through the token map and the OOV representatives."""
    return remap(df, hybrid_lookup(token_map, oov, mode), col, unk, keys, strategy)


def remap_keep_padding(df: DataFrame, token_map: DataFrame, col: str = "input_ids",
                       pad: int = 0, unk: int = 0, keys=("example_id", "side"), strategy: str = "auto") -> DataFrame:
    """Like J1, but the padding id stays itself."""
    tm = token_map.filter(F.col("token_id") != pad).unionByName(
        token_map.sparkSession.createDataFrame([(pad, pad)], "token_id int, new_id int"))
    return remap(df, tm, col, unk, keys, strategy)


def truncation_map(vocab: DataFrame, k: int) -> DataFrame:
    """Identity below ``k``, else 0 — over the ids of a vocabulary table."""
    return vocab.select(F.col("token_id").cast("int"),
                        F.when(F.col("token_id") < k, F.col("token_id")).otherwise(F.lit(0)).cast("int")
                        .alias("new_id"))


def valid_ids(ids: DataFrame, embeddings: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """Keep ids that have an embedding row.  ``dropped`` observes on the way how many
    have none (``n_dropped``), known once the kept rows have been computed."""
    rows = embeddings.select("token_id")
    if dropped is None:
        return ids.join(rows, "token_id", "left_semi")
    known = ids.join(rows.distinct().withColumn("_known", F.lit(True)), "token_id", "left")
    return (known.observe(dropped, F.count_if(F.col("_known").isNull()).alias("n_dropped"))
                 .filter("_known").drop("_known").select(*ids.columns))


def dropped_ids(ids: DataFrame, embeddings: DataFrame) -> DataFrame:
    """How many ids have no embedding row (one row, ``n_dropped``)."""
    return ids.join(embeddings.select("token_id"), "token_id", "left_anti").agg(F.count(F.lit(1)).alias("n_dropped"))


def reduce_embeddings(token_map: DataFrame, embeddings: DataFrame, clamp_missing: bool = False) -> DataFrame:
    """The reduced matrix ``(new_id, embedding)``: rows of kept tokens, new-id order.

    With ``clamp_missing`` a kept id beyond the matrix takes the last row (the
    reference's fallback); otherwise such ids are left out (P11).
    """
    if not clamp_missing:
        return token_map.join(embeddings, "token_id", "inner").select("new_id", "embedding")
    last = int(scalar(embeddings, F.max("token_id")))
    tm = token_map.withColumn("_src", F.least(F.col("token_id"), F.lit(last)))
    return tm.join(embeddings.withColumnRenamed("token_id", "_src"), "_src", "inner").select("new_id", "embedding")


def parameter_table(spark, vocab_rows: int, dim: int, body_params: int, prefix: str = "model") -> DataFrame:
    """A10 input: a parameter inventory ``(param_name, numel)`` of a model with a
    ``vocab_rows x dim`` token embedding and ``body_params`` other weights."""
    return spark.createDataFrame(
        [(f"{prefix}.embeddings.tok_embeddings.weight", vocab_rows * dim),
         (f"{prefix}.embeddings.norm.weight", dim),
         (f"{prefix}.encoder.weights", body_params - dim)],
        "param_name string, numel long")


def parameter_counts(params: DataFrame) -> DataFrame:
    """A10: total / embedding / model-only parameter counts by the name rule."""
    is_emb = F.col("param_name").contains("tok_embeddings.weight") | (
        F.regexp_extract("param_name", r"(?:^|\.)embeddings\.(.*)$", 1).contains("embed"))
    return params.agg(F.sum("numel").alias("total"),
                      F.sum(F.when(is_emb, F.col("numel")).otherwise(0)).alias("embedding")) \
                 .withColumn("model_only", F.col("total") - F.col("embedding"))


def reduction_report(kept_rows: DataFrame, vocab_rows: int, dim: int, body_params: int,
                     corpus_tokens: int | None = None) -> DataFrame:
    """One row of reduction figures for a token map (``kept_rows``: its new ids).

    Counts distinct new ids, so representatives shared by many removed tokens are
    counted once.
    """
    kept = kept_rows.agg(F.count_distinct("new_id").alias("kept_tokens"))
    orig_total = vocab_rows * dim + body_params
    emb_new = F.col("kept_tokens") * dim
    out = kept.select(
        F.col("kept_tokens").cast("long"),
        ((1 - F.col("kept_tokens") / F.lit(float(vocab_rows))) * 100).alias("vocab_reduction_pct"),
        ((F.lit(vocab_rows * dim) - emb_new) / F.lit(float(vocab_rows * dim)) * 100).alias("embedding_reduction_pct"),
        ((F.lit(orig_total) - (emb_new + body_params)) / F.lit(float(orig_total)) * 100).alias("total_reduction_pct"),
        F.lit(0.0).alias("model_only_reduction_pct"),
        ((F.lit(vocab_rows) - F.col("kept_tokens")) * dim).cast("long").alias("removed_params"))
    if corpus_tokens is not None:
        out = out.withColumn("train_only_reduction_pct", F.lit((1 - corpus_tokens / vocab_rows) * 100))
    return out
