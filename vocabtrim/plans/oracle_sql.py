"""DuckDB oracle SQL for every registered query.

The CTEs below restate, in plain SQL over the driver's views, the corpus, word
and vocabulary definitions of :mod:`vocabtrim.plans.common`; each query then
states its operator directly (window functions, joins, aggregates).
"""

from __future__ import annotations

from ..functions.stopwords import stop_words_sql_values

CORPUS = r"""corpus AS (
  SELECT d.doc_id AS example_id,
         CASE WHEN substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) < 'e' THEN 'train'
              WHEN substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) = 'e' THEN 'validation'
              ELSE 'test' END AS split,
         d.text AS text_a, CAST(NULL AS VARCHAR) AS text_b,
         CAST(coalesce(l.quality, -1) AS DOUBLE) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PAIRS = r"""corpus AS (
  SELECT CAST(u.conv_id * 1000 + u.turn AS BIGINT) AS example_id,
         CASE WHEN substr(md5(CAST(u.conv_id * 1000 + u.turn AS VARCHAR)), 1, 1) < 'e' THEN 'train'
              WHEN substr(md5(CAST(u.conv_id * 1000 + u.turn AS VARCHAR)), 1, 1) = 'e' THEN 'validation'
              ELSE 'test' END AS split,
         u.text AS text_a, a.text AS text_b, CAST(-1 AS DOUBLE) AS label
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""

TEXTS = r"""texts AS (
  SELECT example_id, split, label, 'a' AS side, text_a AS text FROM corpus WHERE text_a IS NOT NULL
  UNION ALL
  SELECT example_id, split, label, 'b' AS side, text_b AS text FROM corpus WHERE text_b IS NOT NULL)"""

WORDS = r"""words AS (
  SELECT example_id, split, label, side, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM texts))"""

# words with CLS at position 0 and SEP at n+1 (add_special_tokens=True)
SWORDS = r"""swords AS (
  SELECT example_id, split, label, side, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT *, list_concat(['[CLS]'], regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ['[SEP]']) AS w
        FROM texts))"""

# the vocabulary is always built from the documents corpus (all splits)
VOCAB = r"""vdoc AS (
  SELECT d.text AS text FROM documents d WHERE d.text IS NOT NULL),
vwords AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM vdoc),
vocab AS (
  SELECT word, CAST(4 + row_number() OVER (ORDER BY cnt DESC, word) AS INTEGER) AS token_id
  FROM (SELECT word, count(*) AS cnt FROM vwords GROUP BY word)
  UNION ALL
  SELECT * FROM (VALUES ('[UNK]', 0), ('[PAD]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[MASK]', 4)) v(word, token_id)),
vsize AS (SELECT count(*) AS v FROM vocab)"""

# occurrences with ids (specials included), unknown words -> 0
TOKENS = r"""tokens AS (
  SELECT s.example_id, s.split, s.label, s.side, s.pos, CAST(coalesce(v.token_id, 0) AS INTEGER) AS token_id
  FROM swords s LEFT JOIN vocab v ON s.word = v.word)"""

TOKENS_NS = r"""tokens_ns AS (
  SELECT s.example_id, s.split, s.label, s.side, s.pos, CAST(coalesce(v.token_id, 0) AS INTEGER) AS token_id
  FROM words s LEFT JOIN vocab v ON s.word = v.word)"""

STOP = "stop(word) AS (VALUES " + stop_words_sql_values() + ")"


# the pair corpus under its own names, so it can sit next to the documents CTEs
PAIR_CTES = (PAIRS.replace("corpus AS (", "pcorpus AS (", 1),
             TEXTS.replace("texts AS (", "ptexts AS (", 1).replace("FROM corpus", "FROM pcorpus"),
             WORDS.replace("words AS (", "pwords AS (", 1).replace("FROM texts", "FROM ptexts"))


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def doc_ctes(*extra: str) -> tuple[str, ...]:
    return (CORPUS, TEXTS, WORDS, SWORDS, VOCAB, TOKENS, TOKENS_NS) + extra
