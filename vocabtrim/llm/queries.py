"""Registered queries of the operators and their DuckDB oracles.

Each query applies its operator to its whole table and derives the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query()
def op1_katz_scoring(spark, sf_dir):
    """Every document's log10 probability under a Katz model of the training fold."""
    from . import lm_scoring as op
    return op.score(table(spark, sf_dir, "documents"), order=2, min_count=1)


@query()
def op2_separator_scan(spark, sf_dir):
    """Token counts of all documents from flat token files written in the shared folder."""
    from . import separator_scan as op
    return op.documents(op.token_files(table(spark, sf_dir, "documents")))


def _op3_sql() -> str:
    from .quality_rules import METRICS, RULES, STOP_WORDS
    ratio = {"mean_word_length": "word_chars / greatest(n_words, 1)",
             "symbol_char_ratio": "n_symbols / greatest(word_chars, 1)",
             "letter_word_ratio": "n_letter_words / greatest(n_words, 1)",
             "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
             "duplicate_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
             "bullet_line_ratio": "n_bullet_lines / greatest(n_lines, 1)",
             "ellipsis_line_ratio": "n_ellipsis_lines / greatest(n_lines, 1)"}
    assert set(ratio) == set(METRICS)
    broken = []
    for r in RULES:
        tests = [f"{ratio[r.metric]} < {r.low}"] * (r.low is not None) + [f"{ratio[r.metric]} > {r.high}"] * (r.high is not None)
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1),
cov AS (SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM m) GROUP BY r),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words, len(ls)::BIGINT AS n_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•]')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (r)),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        concat_ws(',', {', '.join(broken)}) AS failed_rules FROM c)
SELECT *, (NOT base_failed AND failed_rules = '') AS kept FROM v"""


@query(_op3_sql())
def op3_quality_rules(spark, sf_dir):
    """Threshold rules over every document."""
    from . import quality_rules as op
    out = op.score(table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words",
                      "n_letter_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "base_failed", "failed_rules",
                      "kept")


@query()
def op4_text_density(spark, sf_dir):
    """Main text of every page."""
    from . import html_density as op
    return op.extract(table(spark, sf_dir, "pages"))


@query()
def op5_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    from . import packing as op
    return op.pack(table(spark, sf_dir, "documents"))


@query()
def op6_simhash(spark, sf_dir):
    """Near-duplicate classes of all documents: 3-word shingles, 3 differing bits."""
    from . import simhash as op
    return op.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)


@query()
def op7_suffix_dedup(spark, sf_dir):
    """Bytes of every document that lie in a 400-byte string met twice."""
    from . import suffix_dedup as op
    return op.removed(table(spark, sf_dir, "documents"), length=400)


@query()
def op8_language_id(spark, sf_dir):
    """Language of every document, learned from those outside the held-out fold."""
    from . import language_id as op
    docs = table(spark, sf_dir, "documents")
    # a row without an id is not held out
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = op.train(docs.filter(~held))
    return op.label(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_spans")


def _op9_sql() -> str:
    from .license_scan import EQUIVALENT, KNOWN
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in EQUIVALENT.items())
    plain = (r"trim(regexp_replace(translate(regexp_replace(lower(coalesce(t, '')), "
             r"'(?m)^[ \t*#/]*(?:copyright |copyright$|\(c\)|©|all rights reserved).*$', '', 'g'), '-‐‑', ''), "
             r"'[^\p{L}\p{N}]+', ' ', 'g'))")
    spelled = (f"array_to_string(list_transform(string_split(p, ' '), lambda w: coalesce(map_extract(MAP {{{pairs}}}, w)[1], w)), ' ')")
    return f"""
WITH k AS (SELECT license_id, {spelled} AS c FROM (SELECT license_id, {plain} AS p FROM (VALUES {known}) AS x(license_id, t))
           WHERE p <> '' GROUP BY ALL),
u AS (SELECT doc_id, 'document' AS unit, text AS t FROM documents
      UNION ALL SELECT doc_id, 'line', unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
n AS (SELECT doc_id, unit, p FROM (SELECT doc_id, unit, {plain} AS p FROM u) WHERE p <> '' AND length(p) < 5000)
SELECT doc_id, license_id, unit, count(*) AS n_found
FROM (SELECT doc_id, unit, {spelled} AS c FROM n) JOIN k USING (c) GROUP BY ALL"""


@query(_op9_sql())
def op9_license_scan(spark, sf_dir):
    """Known licence texts and notices in all documents."""
    from . import license_scan as op
    return op.scan(table(spark, sf_dir, "documents"))


@query()
def op10_decontamination(spark, sf_dir):
    """Documents that hold a benchmark passage within the edit budget."""
    from . import decontaminate as op
    return op.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op11_sentencepiece(spark, sf_dir):
    """Ids of every document through the distinct-chunk table, and their decoded text."""
    from public_tokenizers import path

    from . import sentencepiece_chunks as op
    model = path("piece_bpe_32k.model")
    out = op.encode(table(spark, sf_dir, "documents"), model, with_text=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("text", 256).alias("decoded_sha256"))


def _op12_sql() -> str:
    crc = """list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
             lambda acc, x: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
                                        xor(acc, x)), 4294967295)"""
    return rf"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER
               (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
             FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY i) AS s FROM own GROUP BY conv_id),
h AS (SELECT conv_id, s, xor({crc}, 4294967295) % 4 AS h FROM s),
b AS (SELECT h.conv_id, list_concat(coalesce(start.s[1:h.h], []), h.s[h.h + 1:]) AS s
      FROM h LEFT JOIN s AS start ON start.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, s[1:d] AS k, len(s) AS n, s[d].t AS t FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM b)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * any_value(CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) END) AS w,
           sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
         FROM p GROUP BY k, d),
child AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS c FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(c, 0) AS c FROM node LEFT JOIN child USING (k, d)),
sub AS (SELECT k[1:e] AS k, e AS d, sum((c = 0)::INT)::BIGINT AS n_leaves, sum(w)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_node) GROUP BY ALL)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs,
  v.c::BIGINT AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM full_node v JOIN sub USING (k, d) LEFT JOIN node up ON v.d > 0 AND up.d = v.d - 1 AND up.k = v.k[1:v.d - 1]"""


@query(_op12_sql())
def op12_prefix_trie(spark, sf_dir):
    """Prefix trie of all conversations, rebuilt on common starts."""
    from . import prefix_trie as op
    return op.trie(op.rebuilt(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, r, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, sum(n) AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(n.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n.n, 0)::HUGEINT + 5)) // (gn.total::HUGEINT + 5 * v.v::HUGEINT) AS p
      FROM gn JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = gn.lang AND n.source = gn.source AND n.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 5)) // (any_value(ln.total)::HUGEINT + 5 * any_value(v.v)::HUGEINT) AS q
      FROM n JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value
         FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query(OP13_SQL)
def op13_source_divergence(spark, sf_dir):
    """How far the sources of each language lie apart, and the terms that set them apart."""
    from . import source_divergence as op
    return op.audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)
