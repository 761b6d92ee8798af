"""Column-level text, array and parsing functions (P-operators).

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage code generation; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern of the TF-IDF vectorizer (lower-cased runs of
# two or more Unicode word characters) and the reserved token ids 0-4.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
SPECIAL_TOKENS = ("[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]")
UNK_ID, PAD_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4


def word_array(text: Column) -> Column:
    """P2 word tokenizer: lower-case, runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def with_specials(words: Column) -> Column:
    """One CLS at the start and one SEP at the end of every text."""
    return F.concat(F.array(F.lit(SPECIAL_TOKENS[CLS_ID])), words, F.array(F.lit(SPECIAL_TOKENS[SEP_ID])))


def strip_marker(token: Column, marker: str = "##") -> Column:
    """P5: subword continuation marker removed (token -> word)."""
    return F.replace(token, F.lit(marker), F.lit(""))


def clamp(ids: Column, size) -> Column:
    """Clamp an id (or every id of an array) into ``[0, size-1]``."""
    hi = F.lit(size - 1) if isinstance(size, int) else size - 1
    return F.least(F.greatest(ids, F.lit(0)), hi)


def clamp_array(ids: Column, size) -> Column:
    return F.transform(ids, lambda x: clamp(x, size))


def _try_double(s: Column) -> Column:
    """Cast to double only when the text is a plain decimal number, else NULL."""
    return F.when(s.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), s.cast("double"))


def locale_double(value: Column) -> Column:
    """``"0,65"`` -> 0.65; empty or invalid -> 0.0."""
    return F.coalesce(_try_double(F.replace(F.trim(value), F.lit(","), F.lit("."))), F.lit(0.0))


def size_to_number(s: Column) -> Column:
    """``"8.5k"`` -> 8500, ``"634"`` -> 634, anything else -> 0."""
    low = F.lower(F.trim(s))
    is_k = low.endswith("k")
    val_k = _try_double(F.regexp_replace(low, "k$", ""))
    val = _try_double(low)
    return F.coalesce(F.when(is_k, val_k * 1000).otherwise(val), F.lit(0.0))


def decode_prediction(logits: Column) -> Column:
    """Arg-max of the logits (first maximum wins); one column -> the value itself."""
    return F.when(F.size(logits) == 1, F.element_at(logits, 1)).otherwise(
        (F.array_position(logits, F.array_max(logits)) - 1).cast("double"))


def l2_normalise(vec: Column) -> Column:
    """Divide by the Euclidean norm; the zero vector becomes NULL."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))
    return F.transform(vec, lambda x: x / F.nullif(norm, F.lit(0.0)))


def concat_pair(a: Column, b: Column) -> Column:
    """P20: ``"a b"``, or ``a`` alone when ``b`` is NULL."""
    return F.concat_ws(" ", a, b)
