"""Text unpivot, word tokenization, vocabulary and encoding.

Data flow (all lazy):

    corpus --texts()--> (example_id, split, label, side, text)
           --words()--> (example_id, split, label, side, pos, word)
           --encode(vocab)--> (example_id, split, label, side, pos, token_id)
           --sequences()--> (example_id, side, input_ids ARRAY<INT>)

The vocabulary stands in for the tokenizer's: ids 0-4 are the reserved tokens,
then ``4 + row_number`` over (count DESC, word ASC) of the vocabulary corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPECIAL_TOKENS, UNK_ID, with_specials, word_array
from .blocks import looked_up
from .ordering import scalar, stored, with_row_number


def texts(corpus: DataFrame, a: str = "text_a", b: str | None = "text_b", extra=()) -> DataFrame:
    """One row per (example, side); side ``b`` optional; NULL texts skipped.
    ``extra`` names further columns of the corpus to carry (e.g. a group to count by)."""
    keep = [c for c in ("example_id", "split", "label", *extra) if c in corpus.columns]
    if b is None or b not in corpus.columns:
        out = corpus.select(*keep, F.lit("a").alias("side"), F.col(a).alias("text"))
    else:
        out = corpus.select(*keep, F.expr(f"stack(2, 'a', `{a}`, 'b', `{b}`) AS (side, text)"))
    return out.filter(F.col("text").isNotNull())


def words(text_rows: DataFrame, add_special_tokens: bool = False, keep_empty: bool = False,
          limit: int | None = None) -> DataFrame:
    """One row per word occurrence with its 0-based position in the text.

    With ``add_special_tokens`` the CLS / SEP markers are part of the exploded
    array (positions 0 and n+1), so one explode serves encoding and counting.
    With ``keep_empty`` a text without a word stays as one row without position and word.
    With ``limit`` only the first words of a text come out, for encodings of a fixed
    length, and every row carries the full count as ``n_words``.
    """
    arr = word_array(F.col("text"))
    if add_special_tokens:
        arr = with_specials(arr)
    keep = [c for c in text_rows.columns if c != "text"]
    explode = F.posexplode_outer if keep_empty else F.posexplode
    if limit is not None:
        cut = text_rows.select(*keep, F.size(arr).alias("n_words"), F.slice(arr, 1, limit).alias("_w"))
        return cut.select(*keep, "n_words", explode("_w").alias("pos", "word"))
    return text_rows.select(*keep, explode(arr).alias("pos", "word"))


def counting_words(text_rows: DataFrame, add_special_tokens: bool = False) -> DataFrame:
    """P2 for counting: one row per word occurrence, ``first`` true once per distinct word
    of a text.  The words of a text are sorted inside its row, so document frequency is
    the sum of ``first`` and needs no distinct aggregate."""
    arr = word_array(F.col("text"))
    if add_special_tokens:
        arr = with_specials(arr)
    keep = [c for c in text_rows.columns if c != "text"]
    by_word = text_rows.select(*keep, F.sort_array(arr).alias("_w"))
    before = F.concat(F.array(F.lit("")), F.col("_w"))  # no word is empty
    zipped = by_word.select(*keep, F.inline(F.arrays_zip(F.col("_w"), before)).alias("word", "_b"))
    return zipped.filter(F.col("word").isNotNull()).select(*keep, "word", (F.col("word") != F.col("_b")).alias("first"))


def text_word_counts(text_rows: DataFrame) -> DataFrame:
    """One row per distinct word of a text, ``(columns..., word, tf)``: the words are sorted
    inside the text's row and their runs measured, so nothing is shuffled."""
    keep = [c for c in text_rows.columns if c != "text"]
    w = text_rows.select(*keep, F.sort_array(word_array(F.col("text"))).alias("_w")).filter(F.size("_w") > 0)
    last = F.size("_w") - 1
    begins = F.filter(F.sequence(F.lit(0), last),
                      lambda i: (i == 0) | (F.try_element_at("_w", i + 1) != F.try_element_at("_w", F.greatest(i, F.lit(1)))))
    w = w.select(*keep, "_w", begins.alias("_b"))
    runs = F.transform("_b", lambda b, k: F.struct(
        F.try_element_at("_w", b + 1).alias("word"),
        (F.coalesce(F.try_element_at("_b", k + 2), last + 1) - b).alias("tf")))
    return w.select(*keep, F.inline(runs))


def specials_df(spark) -> DataFrame:
    return spark.createDataFrame([(w, i) for i, w in enumerate(SPECIAL_TOKENS)], "word string, token_id int")


def build_vocabulary(word_rows: DataFrame) -> DataFrame:
    """Vocabulary table ``(word, token_id INT)`` of word rows: see :func:`vocabulary_of`."""
    return vocabulary_of(word_rows.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))


def vocabulary_of(counts: DataFrame) -> DataFrame:
    """Vocabulary table ``(word, token_id INT)`` of ``(word, cnt)``: reserved 0-4, then by count
    desc, word asc.

    Counting is a partial+final hash aggregate; the dense numbering uses the
    range-partitioned row number, so no single task sees the whole vocabulary.
    """
    ranked = with_row_number(counts.select("word", "cnt"), [F.col("cnt").desc(), F.col("word").asc()])
    vocab = ranked.select("word", (F.col("rn") + 4).cast("int").alias("token_id"))
    # every encoding query reads it: written once to the checkpoint folder
    return stored(vocab.unionByName(specials_df(counts.sparkSession)), "vocabulary")


def vocab_size(vocab: DataFrame) -> int:
    """V, the number of rows of the vocabulary (one scalar on the driver)."""
    return int(scalar(vocab, F.count(F.lit(1))))


def encode(word_rows: DataFrame, vocab: DataFrame, unk: int = UNK_ID) -> DataFrame:
    """Word -> token id through the vocabulary; unknown words -> ``unk``.

    An equi-join on ``word``: broadcast when AQE sees a small vocabulary at run
    time, otherwise a shuffle join whose hot keys AQE's skew handling splits.
    """
    joined = word_rows.join(vocab, "word", "left")
    known = F.coalesce(F.col("token_id"), F.lit(unk)).cast("int")  # no word (an empty text): no id
    return joined.withColumn("token_id", F.when(F.col("word").isNotNull(), known)).drop("word")


def encode_with(text_rows: DataFrame, tokenizer: Callable[[Column], Column], col: str = "input_ids") -> DataFrame:
    """P3 by a tokenizer of one's own: ``tokenizer`` maps the text column to an id array, as a
    pandas UDF returning ``array<int>`` does in Arrow batches.  Rows keep their columns but
    ``text`` and get ``col``; a null array is empty."""
    keep = [c for c in text_rows.columns if c not in ("text", col)]
    ids = tokenizer(F.col("text")).cast("array<int>")
    return text_rows.select(*keep, F.coalesce(ids, F.array().cast("array<int>")).alias(col))


def token_counts_of(encoded: DataFrame, by=(), col: str = "input_ids") -> DataFrame:
    """A2 + A3 of encoded rows: ``(by..., token_id, cnt, df)``.  The ids of a row are sorted in
    it and each distinct one flagged once, so ``df`` needs no distinct aggregate."""
    ids = F.sort_array(col)
    before = F.concat(F.array(F.lit(None).cast("int")), ids)
    rows = encoded.select(*by, F.inline(F.arrays_zip(ids.alias("i"), before.alias("b"))).alias("token_id", "_b"))
    rows = rows.filter(F.col("token_id").isNotNull())
    return rows.groupBy(*by, "token_id").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if(~F.col("token_id").eqNullSafe(F.col("_b"))).alias("df"))


def sequences(tokens: DataFrame, keys=("example_id", "side"), id_col: str = "token_id",
              out: str = "input_ids") -> DataFrame:
    """Rebuild ordered id arrays per text (one shuffle by example)."""
    others = [c for c in ("split", "label") if c in tokens.columns and c not in keys]
    agg = [F.array_sort(F.collect_list(F.struct("pos", id_col))).alias("_ps")]
    agg += [F.first(c).alias(c) for c in others]
    return (tokens.groupBy(*keys).agg(*agg)
                  .select(*keys, *others, F.transform("_ps", lambda s: s[id_col]).alias(out)))


def encode_texts(text_rows: DataFrame, vocab: DataFrame, vocab_rows: int, add_special_tokens: bool = False,
                 unk: int = UNK_ID, keys=("example_id", "side"), out: str = "input_ids") -> DataFrame:
    """P2 + P3 of whole texts, the rows of ``sequences(encode(words(...)))``: the words of a text stay an
    array, and the distinct words of blocks of texts meet the vocabulary (:mod:`.blocks`), so
    no row a word is shuffled.  ``vocab_rows``: the size of the vocabulary."""
    arr = word_array(F.col("text"))
    if add_special_tokens:
        arr = with_specials(arr)
    others = [c for c in ("split", "label") if c in text_rows.columns and c not in keys]
    rows = text_rows.select(*keys, *others, arr.alias(out))
    if not add_special_tokens:
        rows = rows.filter(F.size(out) > 0)  # a text without a word has no row
    lookup = vocab.select(F.col("word").alias("_k"), F.col("token_id").alias("_v"))
    return looked_up(rows, out, lookup, vocab_rows, keys, unk)


def word_counts(word_rows: DataFrame, by=(), with_df: bool = True) -> DataFrame:
    """Word-level count and (``with_df``) document frequency (texts containing the word).

    Aggregated before any join, so a word holding a third of all occurrences
    is collapsed by the map-side partial aggregate.  Rows of ``counting_words`` give
    ``df`` in the same aggregate; plain ``words`` rows need a distinct count for it.
    """
    aggs = [F.count(F.lit(1)).alias("cnt")]
    if with_df and "first" in word_rows.columns:
        aggs.append(F.sum(F.col("first").cast("long")).alias("df"))
    elif with_df:
        aggs.append(F.count_distinct("example_id", "side").alias("df"))
    return word_rows.groupBy(*by, "word").agg(*aggs)


def token_counts_from_words(word_rows: DataFrame, vocab: DataFrame, by=(), unk: int = UNK_ID,
                            with_df: bool = True) -> DataFrame:
    """A2+A3 via the word level: ``(by..., token_id, cnt, df)``.

    Known words map 1:1 to ids, so their counts carry over after one
    word-level join.  Words missing from the vocabulary are found at the word
    level too; only if there are any does a second pass over the occurrences
    (a semi-join with those words) count the texts that contain one, which is
    the document frequency of ``unk``.
    """
    from .ordering import materialize
    by = list(by)
    wc = materialize(word_counts(word_rows, by, with_df))
    cols = ["cnt", "df"] if with_df else ["cnt"]
    known = wc.join(vocab, "word", "inner").select(*by, "token_id", *cols)
    unknown_words = wc.join(vocab, "word", "left_anti")
    if scalar(unknown_words, F.count(F.lit(1))) == 0:
        return known
    unknown_rows = word_rows.join(unknown_words.select(*by, "word"), [*by, "word"], "left_semi")
    aggs = [F.count(F.lit(1)).alias("cnt")]
    if with_df:
        aggs.append(F.count_distinct("example_id", "side").alias("df"))
    unk_counts = (unknown_rows.groupBy(*by).agg(*aggs)
                  .select(*by, F.lit(unk).cast("int").alias("token_id"), *cols))
    return known.unionByName(unk_counts)


def subword_pieces(vocab: DataFrame, word_rows: DataFrame, marker: str = "##") -> DataFrame:
    """Piece inventory for P4, derived from the vocabulary: every word and every character
    seen, each as an initial piece and as a ``##`` continuation piece."""
    whole = vocab.filter(F.col("token_id") >= len(SPECIAL_TOKENS)).select("word")
    # characters of distinct words: the occurrences are brought together before they are split
    chars = word_rows.select("word").distinct().select(F.explode(F.split("word", "")).alias("word")).filter(F.col("word") != "").distinct()
    base = whole.unionByName(chars).distinct()
    return base.select(F.explode(F.array(F.col("word"), F.concat(F.lit(marker), F.col("word")))).alias("piece")).distinct()


def piece_prefixes(pieces: DataFrame, marker: str = "##") -> tuple[DataFrame, int]:
    """``(inner, prefix, best)`` and the number of bisection steps: for a piece of length L the
    prefixes whose lengths are the leading bits of L, at most log2(L) + 1 of them, each with
    the length of the longest piece that begins it (0: none).  ``inner``: for the inside of words."""
    inner = F.startswith("piece", F.lit(marker))
    pcs = pieces.select(inner.alias("inner"), F.when(inner, F.substring(F.col("piece"), len(marker) + 1, F.length("piece")))
                        .otherwise(F.col("piece")).alias("body")).filter(F.col("body") != "").distinct()
    steps = int(scalar(pcs, F.max(F.length("body"))) or 0).bit_length()
    size = F.length("body")
    leading = F.transform(F.sequence(F.lit(0), F.lit(max(steps - 1, 0))),
                          lambda j: F.call_function("shiftleft", F.call_function("shiftright", size, j), j))
    marks = (pcs.select("inner", "body", F.explode(F.array_distinct(leading)).alias("l")).filter("l > 0")
                .select("inner", F.substring(F.col("body"), F.lit(1), F.col("l")).alias("prefix")).distinct())
    begins = (marks.select("inner", "prefix", F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("l"))
                   .withColumn("body", F.substring(F.col("prefix"), F.lit(1), F.col("l"))))
    best = begins.join(pcs, ["inner", "body"], "left_semi").groupBy("inner", "prefix").agg(F.max("l").alias("best"))
    return marks.join(best, ["inner", "prefix"], "left").fillna(0, ["best"]), steps


def encode_subwords(words_df: DataFrame, pieces: DataFrame, marker: str = "##", unk: str = "[UNK]") -> DataFrame:
    """Greedy longest-match subword segmentation of *distinct* words.

    A word that is a piece is its own segmentation.  For the others the longest piece at
    each place is found by bisection over lengths in the table of piece prefixes: one row
    a place, one equi-join a bit of the longest piece's length, whatever the number of
    pieces.  One fold over the places of a word then walks them; words that cannot be
    segmented become ``unk``.  Output ``(word, pieces ARRAY<STRING>)``.
    """
    distinct = stored(words_df.select("word").filter(F.col("word") != "").distinct(), "words")
    known = distinct.join(pieces.select(F.col("piece").alias("word")).filter(~F.startswith("word", F.lit(marker))).distinct(),
                          "word", "left_semi")
    whole = known.select("word", F.array("word").alias("pieces"))
    rest = stored(distinct.join(known, "word", "left_anti"), "split-words")
    if rest.isEmpty():
        return whole
    table, steps = piece_prefixes(pieces, marker)
    table = stored(table, "piece-prefixes")
    at = rest.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("off"))
    at = at.withColumns({"inner": F.col("off") > 0, "cur": F.lit(0), "l": F.lit(0)})
    for j in range(steps - 1, -1, -1):
        probe = F.col("cur") + (1 << j)
        ask = F.when(F.col("off") + probe <= F.length("word"), F.substring(F.col("word"), F.col("off") + 1, probe))
        at = (at.withColumn("prefix", ask).join(table, ["inner", "prefix"], "left")
                .select("word", "off", "inner", F.when(F.col("best").isNull(), F.col("cur")).otherwise(probe).alias("cur"),
                        F.coalesce("best", "l").alias("l")))
    best = (at.filter("l > 0").groupBy("word")
              .agg(F.map_from_entries(F.collect_list(F.struct("off", "l"))).alias("best")))
    none = F.array().cast("array<string>")

    def step(state, i):
        l = F.try_element_at(F.col("best"), i)
        piece = F.substring(F.col("word"), i + 1, l)
        piece = F.when(i == 0, piece).otherwise(F.concat(F.lit(marker), piece))
        moved = F.struct((i + l).alias("next"), F.concat(state["out"], F.array(piece)).alias("out"))
        stuck = F.struct(F.lit(-1).alias("next"), none.alias("out"))
        return F.when(i != state["next"], state).when(l.isNull(), stuck).otherwise(moved)
    walk = F.aggregate(F.sequence(F.lit(0), F.length("word") - 1),
                       F.struct(F.lit(0).alias("next"), none.alias("out")), step)
    done = rest.join(best, "word", "left").withColumn("walk", walk)
    return whole.unionByName(done.select("word", F.when(F.col("walk.next") == F.length("word"), F.col("walk.out"))
                                                  .otherwise(F.array(F.lit(unk))).alias("pieces")))
