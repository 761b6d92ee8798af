"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the words and lines of a text; a rule
row ``(name, metric, low, high)`` becomes one comparison of the same projection.
No user function runs, and no row leaves its task: there is no shuffle at all.

Edge cases: a null or empty text has no words (all counts 0, base_failed, not
kept); repeated rows are judged alike; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, need, whole_row

SYMBOLS = "#*$%&|<>"

# The most frequent function words of the four corpus languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as are was this by or at from not an "
    "le la les de des du un une et en est que qui dans pour pas sur avec par au aux "
    "der die das und ist von zu den mit im auf ein eine nicht auch für dem sich "
    "el los las del y es por una para con se no como su al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; None leaves a side open."""
    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Thresholds beside the base rules.  Ratios are of words unless the name says otherwise.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbol_chars", "symbol_char_ratio", None, 0.10),
    Rule("letter_words", "letter_word_ratio", 0.60, None),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.60),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.90),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.30),
)


def measures(text: Column) -> Column:
    """One struct of counts for a text (null: none of anything)."""
    t = F.coalesce(text, F.lit(""))
    flat = F.translate(t, SPACES[1:], " " * (len(SPACES) - 1))
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")

    def counts(ws: Column) -> Column:
        def windows(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"])
                             | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            at = F.sort_array(F.transform(again, lambda x: x["i"]))
            return F.aggregate(
                F.transform(F.array(at), lambda a: F.aggregate(
                    F.transform(a, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - v, F.lit(3)))),
                    F.lit(0), lambda x, y: x + y)), F.lit(0), lambda x, y: x + y)
        hashed = F.when(F.size(ws) >= 3, F.sort_array(F.transform(
            F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))))
        repeat = F.coalesce(F.get(F.transform(F.array(hashed), windows), F.lit(0)), F.lit(0))
        stop = [F.lit(w) for w in STOP_WORDS]
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            repeat.cast("long").alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(*stop))).cast("long").alias("n_stop_words"),
            F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(ls, lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipsis_lines"))

    return F.struct(
        F.get(F.transform(F.array(words), counts), F.lit(0)).alias("w"),
        F.get(F.transform(F.array(lines), of_lines), F.lit(0)).alias("l"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


METRICS = {
    "mean_word_length": lambda: _ratio("word_chars", "n_words"),
    "symbol_char_ratio": lambda: _ratio("n_symbols", "word_chars"),
    "letter_word_ratio": lambda: _ratio("n_letter_words", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "duplicate_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "bullet_line_ratio": lambda: _ratio("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": lambda: _ratio("n_ellipsis_lines", "n_lines"),
}


def compile_rules(rules=RULES) -> Column:
    """Array of the names of the rules a row breaks."""
    broken = []
    for r in rules:
        v = METRICS[r.metric]()
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (v < F.lit(r.low))
        if r.high is not None:
            bad = bad | (v > F.lit(r.high))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def score(docs: DataFrame, rules=RULES, min_words: int = 50, max_repeat_percent: int = 50,
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the counts, ``base_failed``, ``failed_rules`` and ``kept`` of each row."""
    # a one-element explode: the counts are computed once a row, whatever a later filter asks of them
    m = need(docs, *dict.fromkeys((*keep, "text")))
    m = m.select("*", F.explode(F.array(measures(F.col("text")))).alias("_m"))
    cols = [c for c in keep]
    m = m.select(*cols, "_m.w.*", "_m.l.*", "_m.word_chars", "_m.n_symbols")
    base = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (m.withColumn("base_failed", base)
             .withColumn("failed_rules", compile_rules(rules))
             .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def kept_rows(docs: DataFrame, rules=RULES, **how) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with all their columns."""
    rows = docs.select(whole_row(docs).alias("_row"), F.col("`text`").alias("text"))
    return score(rows, rules, keep=("_row",), **how).filter("kept").select("_row.*")
