"""Encoding queries: pair encoding, batching, collation, encoded splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.encoding import (encode_pair, label_or_default, pad_batches, pair_arrays, prediction_only,
                                  standardise_label, with_batch)
from ..operators.ordering import stored
from ..operators.rank import keep_by_percent
from ..operators.remap import remap, remap_keep_padding
from ..operators.split import split_train_test
from ..operators.tokens import encode, encode_with, texts, token_counts_of, words
from .common import Inputs
from .oracle_sql import CORPUS, PAIR_CTES, STOP, TEXTS, VOCAB, doc_ctes, with_ctes
from .q_prune import CNTS, FMAP, P, sql_percent_map, train_counts
from .q_splits import floor_of, sql_take_first
from .registry import register

MAXLEN = 128


def encoded_pairs(inp: Inputs, corpus, pad=True, max_length=MAXLEN):
    """P6 on a corpus; words past the encoded length are cut before the vocabulary join."""
    tokens = encode(words(texts(corpus), keep_empty=True, limit=max_length - 2), inp.vocab())
    return encode_pair(pair_arrays(tokens), max_length, pad=pad)


def _ids(c):
    return F.array_join(c, ",")


# SQL: per example token lists, truncated lengths and the fixed-length encoding
def sql_pair_encoding(src: str, pad: bool, max_length: int = MAXLEN, pad_id: int = 1) -> str:
    enc = rf"""pl AS (
  SELECT x.example_id,
         list(CAST(coalesce(v.token_id, 0) AS INTEGER) ORDER BY t.pos) FILTER (WHERE x.side = 'a' AND t.word IS NOT NULL) AS a,
         list(CAST(coalesce(v.token_id, 0) AS INTEGER) ORDER BY t.pos) FILTER (WHERE x.side = 'b' AND t.word IS NOT NULL) AS b,
         bool_or(x.side = 'b') AS has_b
  FROM {src.replace("words", "texts")} x LEFT JOIN {src} t ON x.example_id = t.example_id AND x.side = t.side
  LEFT JOIN vocab v ON t.word = v.word GROUP BY x.example_id),
pl2 AS (
  SELECT example_id, coalesce(a, []) AS a, CASE WHEN has_b THEN coalesce(b, []) END AS b FROM pl),
pl3 AS (
  SELECT *, len(a) AS la, coalesce(len(b), 0) AS lb,
         CASE WHEN b IS NULL THEN {max_length - 2} ELSE {max_length - 3} END AS bud FROM pl2),
pl4 AS (
  SELECT *, la + lb - bud AS ex, greatest(la, lb) - (la + lb - bud) >= least(la, lb) AS lo FROM pl3),
pl5 AS (
  SELECT example_id, a, b,
    CASE WHEN ex <= 0 THEN la WHEN lo THEN (CASE WHEN la >= lb THEN la - ex ELSE la END) ELSE CAST(ceil(bud / 2) AS BIGINT) END AS ka,
    CASE WHEN ex <= 0 THEN lb WHEN lo THEN (CASE WHEN la >= lb THEN lb ELSE lb - ex END) ELSE CAST(floor(bud / 2) AS BIGINT) END AS kb
  FROM pl4),
enc0 AS (
  SELECT example_id,
    CASE WHEN b IS NULL THEN list_concat([2], a[1:ka], [3])
         ELSE list_concat([2], a[1:ka], [3], b[1:kb], [3]) END AS ids
  FROM pl5)"""
    if pad:
        enc += rf""",
enc AS (
  SELECT example_id, list_resize(ids, {max_length}, {pad_id}) AS ids,
         list_resize(list_transform(ids, lambda x: 1), {max_length}, 0) AS mask FROM enc0)"""
    else:
        enc += """,
enc AS (SELECT example_id, ids, list_transform(ids, lambda x: 1) AS mask FROM enc0)"""
    return enc


PAIR_WORDS = (VOCAB, *PAIR_CTES)


@register("p1_pair_texts", with_ctes(*PAIR_CTES, body="SELECT example_id, side, length(text) AS n_chars FROM ptexts"))
def p1_pair_texts(spark, sf_dir):
    """The pair corpus unpivoted to one row per (example, side), NULL sides skipped."""
    t = texts(Inputs(spark, sf_dir).pairs())
    return t.select("example_id", "side", F.length("text").cast("bigint").alias("n_chars"))


@register("p6_encode_pair", with_ctes(*PAIR_WORDS, sql_pair_encoding("pwords", True), body="""
SELECT example_id, array_to_string(ids, ',') AS ids, array_to_string(mask, ',') AS mask FROM enc"""))
def p6_encode_pair(spark, sf_dir):
    """[CLS] a [SEP] b [SEP], longest-first truncation to 128, padded, with mask."""
    inp = Inputs(spark, sf_dir)
    e = encoded_pairs(inp, inp.pairs())
    return e.select("example_id", _ids("input_ids").alias("ids"), _ids("attention_mask").alias("mask"))


@register("m9_no_pruning", with_ctes(*PAIR_WORDS, sql_pair_encoding("pwords", False), body="""
SELECT example_id, array_to_string(ids, ',') AS ids FROM enc"""))
def m9_no_pruning(spark, sf_dir):
    """M9: identity vocabulary, P6 without padding (the unpruned baseline's inputs)."""
    inp = Inputs(spark, sf_dir)
    e = encoded_pairs(inp, inp.pairs(), pad=False)
    return e.select("example_id", _ids("input_ids").alias("ids"))


@register("j3_remap_keep_padding", with_ctes(*doc_ctes(STOP), CNTS, FMAP, *PAIR_CTES,
                                             sql_pair_encoding("pwords", True), body="""
, fm AS (SELECT token_id, new_id FROM fmap WHERE token_id <> 1 UNION ALL SELECT 1, 1)
SELECT e.example_id, string_agg(CAST(coalesce(m.new_id, 0) AS VARCHAR), ',' ORDER BY u.i) AS ids
FROM enc e, LATERAL (SELECT unnest(e.ids) AS id, generate_subscripts(e.ids, 1) AS i) u
LEFT JOIN fm m ON u.id = m.token_id GROUP BY e.example_id"""))
def j3_remap_keep_padding(spark, sf_dir):
    """Padded pair encodings remapped with the frequency map, padding id kept."""
    inp = Inputs(spark, sf_dir)
    tm = keep_by_percent(train_counts(inp), P)
    e = encoded_pairs(inp, inp.pairs()).select("example_id", F.lit("a").alias("side"), "input_ids")
    r = remap_keep_padding(e, tm, pad=1)
    return r.select("example_id", _ids("input_ids").alias("ids"))


# ---------------------------------------------------------------- P7 / P8 / P9 / P10 / W9
BATCH = 32


@register("p7_pad_batches", with_ctes(*doc_ctes(), sql_pair_encoding("words", False), body=f"""
, b AS (SELECT e.*, c.label, floor((row_number() OVER (ORDER BY e.example_id) - 1) / {BATCH}) AS batch
       FROM enc e JOIN corpus c ON e.example_id = c.example_id)
SELECT example_id, CAST(batch AS BIGINT) AS batch,
       array_to_string(list_resize(ids, max(len(ids)) OVER (PARTITION BY batch), 0), ',') AS ids,
       array_to_string(list_resize(mask, max(len(ids)) OVER (PARTITION BY batch), 0), ',') AS mask,
       label AS labels, bool_or(label = -1) OVER (PARTITION BY batch) AS prediction_only
FROM b"""))
def p7_pad_batches(spark, sf_dir):
    """P7-P10 + W9: batches of 32 in id order, padded to the batch maximum with 0,
    labels renamed / defaulted, prediction-only batches flagged."""
    inp = Inputs(spark, sf_dir)
    corpus = inp.corpus()
    e = encoded_pairs(inp, corpus, pad=False).join(corpus.select("example_id", "label"), "example_id")
    e = label_or_default(standardise_label(e))
    b = prediction_only(pad_batches(with_batch(e, BATCH), pad_id=0))
    return b.select("example_id", "batch", _ids("input_ids").alias("ids"), _ids("attention_mask").alias("mask"),
                    "labels", "prediction_only")


# ---------------------------------------------------------------- D6 / M10
D2_PARTS = ("pool AS (SELECT example_id, label FROM corpus WHERE split = 'train')",
            sql_take_first("s", "pool", floor_of("0.9"), 42),
            """parts AS (
  SELECT example_id, CASE WHEN is_first THEN 'train' ELSE 'test' END AS part FROM s
  UNION ALL SELECT example_id, 'validation' FROM corpus WHERE split = 'validation')""")


def d2_split(inp: Inputs):
    corpus = inp.corpus()
    pool = corpus.filter(F.col("split") == "train").select("example_id", "label")
    s = split_train_test(pool, 0.9, 42).select("example_id", "part")
    val = corpus.filter(F.col("split") == "validation").select("example_id", F.lit("validation").alias("part"))
    return s.unionByName(val)


@register("d6_encoded_splits", with_ctes(*doc_ctes(), *D2_PARTS, sql_pair_encoding("words", True), body="""
SELECT p.example_id, p.part, array_to_string(e.ids, ',') AS ids, array_to_string(e.mask, ',') AS mask
FROM parts p JOIN enc e ON p.example_id = e.example_id"""))
def d6_encoded_splits(spark, sf_dir):
    """The D2 split, every part encoded to fixed length in the same job."""
    inp = Inputs(spark, sf_dir)
    e = encoded_pairs(inp, inp.text_corpus())
    j = d2_split(inp).join(e, "example_id")
    return j.select("example_id", "part", _ids("input_ids").alias("ids"), _ids("attention_mask").alias("mask"))


@register("m10_prepare_datasets", with_ctes(*doc_ctes(STOP), CNTS, FMAP, *D2_PARTS, sql_pair_encoding("words", True),
                                            body="""
, rm AS (
  SELECT e.example_id, string_agg(CAST(coalesce(m.new_id, 0) AS VARCHAR), ',' ORDER BY u.i) AS ids
  FROM enc e, LATERAL (SELECT unnest(e.ids) AS id, generate_subscripts(e.ids, 1) AS i) u
  LEFT JOIN fmap m ON u.id = m.token_id GROUP BY e.example_id)
SELECT p.example_id, p.part, rm.ids, array_to_string(e.mask, ',') AS mask, c.label AS labels
FROM parts p JOIN rm ON p.example_id = rm.example_id JOIN enc e ON p.example_id = e.example_id
JOIN corpus c ON p.example_id = c.example_id"""))
def m10_prepare_datasets(spark, sf_dir):
    """M10 = S1 -> D2 -> P6 -> J1 (frequency map) -> S10: model-ready rows of every part, written
    as Parquet and read back."""
    import uuid

    from ..operators.report import write_encoded
    inp = Inputs(spark, sf_dir)
    corpus = inp.corpus()
    tm = keep_by_percent(train_counts(inp), P)
    e = encoded_pairs(inp, corpus)
    r = remap(e.select("example_id", "input_ids", "attention_mask"), tm, keys=("example_id",))
    out = (d2_split(inp).join(r, "example_id").join(corpus.select("example_id", "label"), "example_id"))
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/prepared/{uuid.uuid4().hex}"
    write_encoded(standardise_label(out).select("example_id", "part", "input_ids", "attention_mask", "labels"), path)
    out = spark.read.parquet(path)
    return out.select("example_id", "part", _ids("input_ids").alias("ids"), _ids("attention_mask").alias("mask"),
                      "labels")


# ---------------------------------------------------------------- P19 / P20
@register("p19_head_sample", with_ctes(*PAIR_CTES, body="""
SELECT example_id, concat_ws(' ', text_a, text_b) AS text FROM pcorpus ORDER BY example_id LIMIT 100"""))
def p19_head_sample(spark, sf_dir):
    """P19 + P20: the first 100 pairs in id order (the sample is the feature), texts joined by a space."""
    from ..functions.text import concat_pair
    from ..operators.encoding import head_sample
    s = head_sample(Inputs(spark, sf_dir).pairs(), 100)
    return s.select("example_id", concat_pair(F.col("text_a"), F.col("text_b")).alias("text"))


# ---------------------------------------------------------------- hooks: a tokenizer and a method of one's own
BYTES_SQL = f"""bytes AS (
  SELECT example_id, CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) + 5 AS token_id
  FROM (SELECT example_id, h, unnest(range(length(h) // 2)) AS i
        FROM (SELECT example_id, hex(encode(text)) AS h FROM texts WHERE split = 'train'))),
cnts AS (SELECT token_id, count(*) AS cnt, count(DISTINCT example_id) AS df FROM bytes GROUP BY token_id)"""


@register("hook_tokenizer", with_ctes(CORPUS, TEXTS, BYTES_SQL, sql_percent_map("bm", "cnts", "cnt"), body="""
SELECT m.token_id, m.new_id, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt, CAST(coalesce(c.df, 0) AS BIGINT) AS df
FROM bm m LEFT JOIN cnts c USING (token_id)"""))
def hook_tokenizer(spark, sf_dir):
    """P3 with a tokenizer hook (a pandas UDF: one id a UTF-8 byte, after the specials), counted
    (A2, A3) and pruned by frequency at 20 %."""
    # arrays of 4 bytes an id, not lists of Python ints
    utf8 = F.pandas_udf(lambda text: text.map(lambda t: np.frombuffer(t.encode(), np.uint8).astype(np.int32) + 5),
                        "array<int>", F.PandasUDFType.SCALAR)
    inp = Inputs(spark, sf_dir)
    rows = texts(inp.text_corpus().filter(F.col("split") == "train"))
    counts = stored(token_counts_of(encode_with(rows, utf8)), "byte-counts")
    return (keep_by_percent(counts, P).join(counts, "token_id", "left")
            .select("token_id", "new_id", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"),
                    F.coalesce("df", F.lit(0)).cast("long").alias("df")))


@register("hook_method", with_ctes(*doc_ctes(STOP), CNTS, """burst AS (
  SELECT token_id, round(CASE WHEN df > 0 THEN cnt / CAST(df AS DOUBLE) ELSE 0.0 END, 6) AS burstiness FROM cnts)""",
                                   sql_percent_map("bmap", "burst", "burstiness"), body="""
SELECT token_id AS old_id, new_id FROM bmap"""))
def hook_method(spark, sf_dir):
    """``prune`` with a method registered by the caller: tokens ranked by burstiness (A5)."""
    from ..operators.importance import burstiness
    from .pipelines import prune, register_method

    @register_method("burstiness")
    def by_burstiness(job):
        return job.best(burstiness(job.counts).select("token_id", F.round("burstiness", 6).alias("burstiness")), "burstiness")
    inp = Inputs(spark, sf_dir)
    train = inp.text_corpus().filter(F.col("split") == "train")
    tm = prune("burstiness", train, inp.vocab(), inp.vocab_rows(), p=P).token_map
    return tm.select(F.col("token_id").alias("old_id"), "new_id")
