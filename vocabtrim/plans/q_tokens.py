"""Token-level queries: scans, tokenization, counts, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPECIAL_TOKENS
from ..operators.stats import token_stats, vocab_overlap, ranked_counts
from ..operators.tokens import counting_words, token_counts_from_words, word_counts
from .common import Inputs
from .oracle_sql import doc_ctes, with_ctes
from .registry import register


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- A7 / W6 / W7
def sql_token_stats(src: str, key: str) -> str:
    """Per-``key`` token statistics over a words CTE ``src`` (key, example_id, side, word)."""
    return rf"""wc AS (SELECT {key}, word, count(*) AS cnt, count(DISTINCT CAST(example_id AS VARCHAR) || ':' || side) AS df
         FROM {src} GROUP BY {key}, word),
ids AS (SELECT w.{key}, v.token_id, w.cnt, w.df FROM wc w JOIN vocab v ON w.word = v.word),
rk AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY cnt DESC, token_id) AS rank_freq,
              row_number() OVER (PARTITION BY {key} ORDER BY CAST(cnt AS DOUBLE) / df DESC, token_id) AS rank_imp
       FROM ids),
sz AS (SELECT {key}, sum(cnt) AS total, count(*) AS uniq FROM ids GROUP BY {key}),
agg AS (
  SELECT r.{key}, any_value(s.total) AS total, any_value(s.uniq) AS uniq,
    sum(CASE WHEN rank_freq <= floor(CAST(0.1 AS DOUBLE) * s.uniq) + 1 THEN cnt ELSE 0 END) AS c10,
    sum(CASE WHEN rank_freq <= floor(CAST(0.2 AS DOUBLE) * s.uniq) + 1 THEN cnt ELSE 0 END) AS c20,
    sum(CASE WHEN rank_freq <= floor(CAST(0.5 AS DOUBLE) * s.uniq) + 1 THEN cnt ELSE 0 END) AS c50,
    sum(CASE WHEN rank_freq <= floor(CAST(0.2 AS DOUBLE) * s.uniq) AND rank_imp <= floor(CAST(0.2 AS DOUBLE) * s.uniq)
             THEN 1 ELSE 0 END) AS both_top
  FROM rk r JOIN sz s ON r.{key} = s.{key} GROUP BY r.{key}),
stats AS (
  SELECT {key}, CAST(total AS BIGINT) AS total_tokens, CAST(uniq AS BIGINT) AS unique_tokens,
    round(uniq / (SELECT CAST(v AS DOUBLE) FROM vsize) * 100, 6) AS vocab_coverage_pct,
    round(CASE WHEN uniq > 10 THEN c10 / CAST(total AS DOUBLE) * 100 ELSE 100.0 END, 6) AS top10_coverage_pct,
    round(CASE WHEN uniq > 10 THEN c20 / CAST(total AS DOUBLE) * 100 ELSE 100.0 END, 6) AS top20_coverage_pct,
    round(CASE WHEN uniq > 10 THEN c50 / CAST(total AS DOUBLE) * 100 ELSE 100.0 END, 6) AS top50_coverage_pct,
    round(CASE WHEN floor(CAST(0.2 AS DOUBLE) * uniq) > 0 THEN both_top / floor(CAST(0.2 AS DOUBLE) * uniq) * 100
               ELSE 100.0 END, 6) AS freq_importance_overlap_pct
  FROM agg)"""


A7_SQL = with_ctes(*doc_ctes(), sql_token_stats("words", "split"), body="SELECT * FROM stats")


@register("a7_token_stats", A7_SQL)
def a7_token_stats(spark, sf_dir):
    """A7 (+W6 coverage, W7 ranking overlap, A5 burstiness): token statistics per split."""
    inp = Inputs(spark, sf_dir)
    out = token_stats(None, inp.vocab(), inp.vocab_rows(), counts=split_counts(inp))
    return out.select(*[r6(F.col(c)).alias(c) if c.endswith("_pct") else F.col(c) for c in out.columns])


# ---------------------------------------------------------------- A2 / A3 / A5
A2_SQL = with_ctes(*doc_ctes(), body=r"""
SELECT token_id, count(*) AS cnt, count(DISTINCT CAST(example_id AS VARCHAR) || ':' || side) AS df
FROM tokens WHERE split = 'train' GROUP BY token_id""")


@register("a2_token_counts", A2_SQL)
def a2_token_counts(spark, sf_dir):
    """A2 + A3: occurrences and document frequency per token id (train split, specials included)."""
    inp = Inputs(spark, sf_dir)
    train = inp.text_corpus().filter(F.col("split") == "train")
    c = token_counts_from_words(inp.counting_words(train, specials=True), inp.vocab())
    return c.select("token_id", F.col("cnt").cast("long"), F.col("df").cast("long"))


# ---------------------------------------------------------------- P2 / A5 / A8 / U2 / U3
@register("p2_word_counts", with_ctes(*doc_ctes(), body=r"""
SELECT word, count(*) AS cnt, count(DISTINCT CAST(example_id AS VARCHAR) || ':' || side) AS df FROM words GROUP BY word"""))
def p2_word_counts(spark, sf_dir):
    """Word tokenizer (lower-cased runs of >= 2 word characters) counted over the corpus."""
    wc = word_counts(Inputs(spark, sf_dir).counting_words())
    return wc.select("word", F.col("cnt").cast("long"), F.col("df").cast("long"))


SPLIT_COUNTS = r"""sc AS (
  SELECT t.split, t.token_id, count(*) AS cnt, count(DISTINCT CAST(example_id AS VARCHAR) || ':' || side) AS df
  FROM tokens_ns t GROUP BY t.split, t.token_id)"""


def split_counts(inp: Inputs):
    """Per-split token counts and document frequencies (no specials), materialised
    once per session: statistics, burstiness, overlap and set queries read them."""
    return inp.shared("split_counts", lambda: (
        inp.split_words().filter(~F.col("word").isin(list(SPECIAL_TOKENS)))
           .join(inp.vocab(), "word").select("split", "token_id", "cnt", "df")))


@register("a5_burstiness", with_ctes(*doc_ctes(SPLIT_COUNTS), body="""
SELECT token_id, round(CASE WHEN df > 0 THEN cnt / CAST(df AS DOUBLE) ELSE 0.0 END, 6) AS burstiness
FROM sc WHERE split = 'train'"""))
def a5_burstiness(spark, sf_dir):
    """A5: count / document frequency per token of the train split."""
    c = split_counts(Inputs(spark, sf_dir)).filter(F.col("split") == "train")
    return c.select("token_id", r6(F.when(F.col("df") > 0, F.col("cnt") / F.col("df")).otherwise(0.0))
                    .alias("burstiness"))


A8_SQL = with_ctes(*doc_ctes(SPLIT_COUNTS), body="""
, tr AS (SELECT token_id, cnt FROM sc WHERE split = 'train'),
te AS (SELECT token_id, cnt FROM sc WHERE split = 'test'),
j AS (SELECT te.token_id, te.cnt, tr.token_id IS NULL AS oov FROM te LEFT JOIN tr ON te.token_id = tr.token_id)
SELECT CAST(sum(CASE WHEN oov THEN 1 ELSE 0 END) AS BIGINT) AS test_unique_not_in_train,
       round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN oov THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100 ELSE 0.0 END, 6)
         AS test_unique_not_in_train_pct,
       CAST(sum(CASE WHEN oov THEN cnt ELSE 0 END) AS BIGINT) AS test_oov_occurrences,
       round(CASE WHEN sum(cnt) > 0 THEN sum(CASE WHEN oov THEN cnt ELSE 0 END) / CAST(sum(cnt) AS DOUBLE) * 100 ELSE 0.0 END, 6)
         AS test_oov_occurrences_pct
FROM j""")


@register("a8_vocab_overlap", A8_SQL)
def a8_vocab_overlap(spark, sf_dir):
    """Test-split token types missing from train, and their occurrences."""
    c = split_counts(Inputs(spark, sf_dir))
    o = vocab_overlap(c.filter(F.col("split") == "train"), c.filter(F.col("split") == "test"))
    return o.select(*[r6(F.col(x)).alias(x) if x.endswith("_pct") else F.col(x) for x in o.columns])


@register("u2_vocab_difference", with_ctes(*doc_ctes(SPLIT_COUNTS), body="""
SELECT token_id FROM sc WHERE split = 'test' EXCEPT SELECT token_id FROM sc WHERE split = 'train'"""))
def u2_vocab_difference(spark, sf_dir):
    """Test vocabulary minus train vocabulary."""
    c = split_counts(Inputs(spark, sf_dir))
    return (c.filter(F.col("split") == "test").select("token_id")
             .subtract(c.filter(F.col("split") == "train").select("token_id")))


@register("u3_vocab_intersection", with_ctes(*doc_ctes(SPLIT_COUNTS), body="""
, tr AS (SELECT * FROM sc WHERE split = 'train'),
n AS (SELECT CAST(floor(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS t FROM tr),
f AS (SELECT token_id, row_number() OVER (ORDER BY cnt DESC, token_id) AS r FROM tr),
i AS (SELECT token_id, row_number() OVER (ORDER BY CAST(cnt AS DOUBLE) / df DESC, token_id) AS r FROM tr)
SELECT token_id FROM f WHERE r <= (SELECT t FROM n)
INTERSECT SELECT token_id FROM i WHERE r <= (SELECT t FROM n)"""))
def u3_vocab_intersection(spark, sf_dir):
    """U3 (+W7): top 20 % by frequency intersected with top 20 % by burstiness (train)."""
    c = split_counts(Inputs(spark, sf_dir)).filter(F.col("split") == "train").drop("split")
    r = ranked_counts(c, by=())
    t = int(0.2 * r.count())
    return (r.filter(F.col("rank_freq") <= t).select("token_id")
             .intersect(r.filter(F.col("rank_imp") <= t).select("token_id")))


# ---------------------------------------------------------------- M11 / A19
STAT_COLS = ["total_tokens", "unique_tokens", "vocab_coverage_pct", "top10_coverage_pct", "top20_coverage_pct",
             "top50_coverage_pct", "freq_importance_overlap_pct"]
OVERLAP_COLS = ["test_unique_not_in_train", "test_unique_not_in_train_pct", "test_oov_occurrences",
                "test_oov_occurrences_pct"]


def _m11_sql(body: str) -> str:
    from .q_encode import D2_PARTS
    pw = """pw AS (SELECT p.part, w.example_id, w.side, w.word FROM words w JOIN parts p ON w.example_id = p.example_id
         WHERE p.part IN ('train', 'test'))"""
    ov = """ptc AS (SELECT p.part, v.token_id, count(*) AS cnt FROM pw p JOIN vocab v ON p.word = v.word GROUP BY 1, 2),
ovl AS (
  SELECT CAST(sum(CASE WHEN tr.token_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS test_unique_not_in_train,
         round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN tr.token_id IS NULL THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100
               ELSE 0.0 END, 6) AS test_unique_not_in_train_pct,
         CAST(sum(CASE WHEN tr.token_id IS NULL THEN te.cnt ELSE 0 END) AS BIGINT) AS test_oov_occurrences,
         round(CASE WHEN sum(te.cnt) > 0 THEN sum(CASE WHEN tr.token_id IS NULL THEN te.cnt ELSE 0 END) / CAST(sum(te.cnt) AS DOUBLE) * 100
               ELSE 0.0 END, 6) AS test_oov_occurrences_pct
  FROM (SELECT * FROM ptc WHERE part = 'test') te LEFT JOIN (SELECT * FROM ptc WHERE part = 'train') tr
    ON te.token_id = tr.token_id),
wide AS (
  SELECT CASE WHEN part = 'train' THEN 'Train' ELSE 'Test' END AS split, 'documents' AS task, """ + \
        ", ".join(STAT_COLS) + ", " + ", ".join(f"NULL AS {c}" for c in OVERLAP_COLS) + """ FROM stats
  UNION ALL
  SELECT 'Overlap', 'documents', """ + ", ".join(f"NULL AS {c}" for c in STAT_COLS) + ", " + \
        ", ".join(OVERLAP_COLS) + " FROM ovl)"
    return with_ctes(*doc_ctes(), *D2_PARTS, pw, sql_token_stats("pw", "part"), ov, body=body)


def _m11(spark, sf_dir):
    from .q_encode import d2_split
    inp = Inputs(spark, sf_dir)
    parts = d2_split(inp).filter(F.col("part").isin("train", "test")).withColumnRenamed("part", "split")
    # the part joins whole texts, and one count serves the statistics and the overlap
    c = inp.shared("d2_counts", lambda: token_counts_from_words(
        counting_words(inp.texts().drop("split").join(parts, "example_id")), inp.vocab(), by=["split"]))
    stats = token_stats(None, inp.vocab(), inp.vocab_rows(), counts=c)
    stats = stats.select(F.when(F.col("split") == "train", "Train").otherwise("Test").alias("split"),
                         F.lit("documents").alias("task"),
                         *[r6(F.col(c)).alias(c) if c.endswith("_pct") else F.col(c) for c in STAT_COLS],
                         *[F.lit(None).cast("double" if c.endswith("_pct") else "long").alias(c) for c in OVERLAP_COLS])
    ov = vocab_overlap(c.filter(F.col("split") == "train"), c.filter(F.col("split") == "test"))
    ov = ov.select(F.lit("Overlap").alias("split"), F.lit("documents").alias("task"),
                   *[F.lit(None).cast("double" if c_.endswith("_pct") else "long").alias(c_) for c_ in STAT_COLS],
                   *[r6(F.col(c_)).alias(c_) if c_.endswith("_pct") else F.col(c_) for c_ in OVERLAP_COLS])
    return stats.unionByName(ov)


@register("m11_token_statistics", _m11_sql("SELECT * FROM wide"))
def m11_token_statistics(spark, sf_dir):
    """M11 = D2 -> A7 (train, test) + A8 (overlap row): the token statistics table."""
    return _m11(spark, sf_dir)


@register("a19_split_pivot", _m11_sql("SELECT task, " + ", ".join(
    f"round(avg({c}) FILTER (WHERE split = '{s}'), 6) AS {c}_{s.lower()}"
    for c in STAT_COLS for s in ("Train", "Test")) + " FROM wide GROUP BY task"))
def a19_split_pivot(spark, sf_dir):
    """The statistics pivoted to one row per task, ``<value>_<split>`` columns."""
    from ..operators.report import split_pivot
    p = split_pivot(_m11(spark, sf_dir).filter(F.col("split") != "Overlap"), STAT_COLS, ["Train", "Test"])
    return p.select("task", *[r6(F.col(c)).alias(c) for c in p.columns if c != "task"])


# ---------------------------------------------------------------- P4 / P5
def _p4_sql() -> str:
    from .oracle_sql import PAIR_CTES
    ctes = list(doc_ctes(*PAIR_CTES))
    ctes.append(r"""base AS (
  SELECT word FROM vocab WHERE token_id >= 5
  UNION SELECT DISTINCT c AS word FROM (SELECT unnest(string_split(word, '')) AS c FROM words) WHERE c <> ''),
pieces AS (SELECT word AS piece FROM base UNION SELECT '##' || word FROM base),
dw AS (SELECT DISTINCT word FROM pwords)""")
    ctes.append(r"""seg(word, off, pcs) AS (
  SELECT word, 0, CAST([] AS VARCHAR[]) FROM dw
  UNION ALL
  SELECT s.word, s.off + b.l, list_append(s.pcs, b.p)
  FROM seg s, LATERAL (
    SELECT c.l, c.p FROM (
      SELECT range AS l,
             CASE WHEN s.off = 0 THEN substr(s.word, s.off + 1, range) ELSE '##' || substr(s.word, s.off + 1, range) END AS p
      FROM range(1, length(s.word) - s.off + 1)) c
    WHERE c.p IN (SELECT piece FROM pieces) ORDER BY c.l DESC LIMIT 1) b
  WHERE s.off < length(s.word))""")
    body = """
, fullseg AS (SELECT word, pcs FROM seg WHERE off = length(word))
SELECT d.word, array_to_string(coalesce(f.pcs, ['[UNK]']), ' ') AS pieces,
       CASE WHEN f.pcs IS NULL THEN '[UNK]' ELSE array_to_string(list_transform(f.pcs, lambda x: replace(x, '##', '')), '') END
         AS rejoined
FROM dw d LEFT JOIN fullseg f ON d.word = f.word"""
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


@register("p4_subword_encode", _p4_sql())
def p4_subword_encode(spark, sf_dir):
    """P4 (+P5): greedy longest-match subword segmentation of the pair corpus's
    distinct words over pieces derived from the vocabulary; pieces re-joined
    after stripping the ``##`` marker."""
    from ..functions.text import SPECIAL_TOKENS, strip_marker
    from ..operators.tokens import encode_subwords, subword_pieces
    inp = Inputs(spark, sf_dir)
    # the words of the one counting pass, which has the markers too
    pieces = subword_pieces(inp.vocab(), inp.split_words().filter(~F.col("word").isin(list(SPECIAL_TOKENS))))
    seg = encode_subwords(inp.words(inp.pairs()), pieces)
    rejoined = F.when(F.array_contains("pieces", "[UNK]"), F.lit("[UNK]")).otherwise(
        F.array_join(F.transform("pieces", lambda x: strip_marker(x)), ""))
    return seg.select("word", F.array_join("pieces", " ").alias("pieces"), rejoined.alias("rejoined"))
