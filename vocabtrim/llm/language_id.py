"""Language identification of mixed-language text.

A word scores its byte trigrams and itself under each learned language (hashed
bins, add-half smoothing).  The Unicode script of the word narrows the candidate
languages to those that use the script in training.  Viterbi with a penalty for
every change of language labels the words of a text; equal neighbours form spans,
and the text gets the language of most of its letter bytes.

The model is a bounded table (``BINS`` rows a language).  It is fitted on a bounded,
documented sample (``max_rows`` rows a language, chosen by a hash of the id); every
text is then predicted whole.

Edge cases: null text or one without a letter gives ``und`` with score 0 and no
spans, as does a model without languages; repeated rows come back repeated; equal
scores go to the alphabetically first language; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, Roller, chunks, mix, need, word_bounds

BINS = 1 << 16
UND = "und"

# First code point of each script range and its script (0: common).
SCRIPTS = (
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1),
    (0xF7, 0), (0xF8, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0),
    (0x900, 7), (0x980, 8), (0xA00, 9), (0xB80, 10), (0xC00, 11), (0xE00, 12), (0xE80, 0), (0x10A0, 13),
    (0x1100, 14), (0x1200, 15), (0x1400, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 16), (0x3100, 0),
    (0x3400, 17), (0xA000, 0), (0xAC00, 14), (0xD7B0, 0), (0xF900, 17), (0xFB00, 0),
)
N_SCRIPTS = 18


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray      # (BINS, languages) log probabilities
    candidates: np.ndarray  # (scripts, languages) 0 for a candidate, a penalty otherwise
    switch: float


def _features(data, offs, roller):
    """Of a chunk: words (starts, ends, rows), a bin for each word byte and word, scripts."""
    s, e, row = word_bounds(data, offs)
    if len(s) == 0:
        return s, e, row, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = LOWER[data].astype(np.uint64)
    space = IS_SPACE[data]
    d[space] = 32
    left, right = np.empty_like(d), np.empty_like(d)
    left[1:], right[:-1] = d[:-1], d[1:]
    left[s], right[e - 1] = 32, 32
    code = (left << np.uint64(16)) | (d << np.uint64(8)) | right
    bins = (mix(code) & np.uint64(BINS - 1)).astype(np.int64)
    low = LOWER[data]
    word = (roller.spans(roller.prefix(low), s, e) & np.uint64(BINS - 1)).astype(np.int64)
    # scripts: of each character's first byte
    script = np.zeros(len(data), np.int8)
    ascii_ = ((low >= 97) & (low <= 122))
    script[ascii_] = 1
    for lead, width in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero((data >= lead) & (data < (0xE0, 0xF0, 0xF8)[width - 2]))
        at = at[at + width <= len(data)]
        if len(at):
            cp = data[at].astype(np.int64) & (0xFF >> (width + 1))
            for k in range(1, width):
                cp = (cp << 6) | (data[at + k] & 0x3F)
            starts = np.array([x for x, _ in SCRIPTS])
            kinds = np.array([x for _, x in SCRIPTS], np.int8)
            found = kinds[np.searchsorted(starts, cp, "right") - 1]
            script[at] = np.where((found == 0) & (cp >= 0x10000), 17, found)
    of_word = np.maximum.reduceat(script, s).astype(np.int64)  # white space between words has script 0
    return s, e, row, bins, word, of_word


def _word_scores(s, bins, word, table):
    """Sum of the scores of a word's bytes and of the word itself."""
    total = np.cumsum(np.vstack([np.zeros((1, table.shape[1]), np.float64), table[bins]]), axis=0)
    return total, table[word]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          max_rows: int = 20_000, switch: float = 15.0) -> Model:
    """Fit on at most about ``max_rows`` labelled rows a language (all if there are fewer)."""
    rows = need(docs, key, text, lang).toDF("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    seen = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(seen)
    if not langs:
        return Model([], np.zeros((BINS, 0)), np.zeros((N_SCRIPTS, 0)), switch)
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, max_rows / seen[x]))) for x in langs])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        roller = Roller(8)
        for batch in batches:
            lang_of = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            total: dict[int, np.ndarray] = {}
            for first, last, data, offs in chunks(batch):
                s, e, row, bins, word, script = _features(data, offs, roller)
                if len(s) == 0:
                    continue
                length = e - s
                at = np.repeat(s - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
                mine = lang_of[first + row]
                for g in np.unique(mine).tolist():
                    here = mine == g
                    n = total.setdefault(g, np.zeros(BINS + N_SCRIPTS, np.int64))
                    n[:BINS] += np.bincount(bins[at[np.repeat(here, length)]], minlength=BINS)
                    n[:BINS] += np.bincount(word[here], minlength=BINS)
                    n[BINS:] += np.bincount(script[here], minlength=N_SCRIPTS)
            for g, n in total.items():
                full = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), g, np.int32)),
                                                  pa.array(full.astype(np.int32)), pa.array(n[full])],
                                                 names=["lang", "bin", "n"])
    got = (rows.filter(draw < share).mapInArrow(count, "lang int, bin int, n long")
               .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((BINS + N_SCRIPTS, len(langs)))
    counts[got["bin"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    grams, scripts = counts[:BINS], counts[BINS:]
    scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BINS)).astype(np.float32)
    used = scripts / np.maximum(scripts.sum(0), 1) >= 0.01
    used[0] = True
    used[~used.any(1)] = True
    return Model(langs, scores, np.where(used, 0.0, -30.0).astype(np.float32), switch)


def viterbi(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word.  Texts are advanced together, one word a step, longest first."""
    path = np.zeros(len(scores), np.int16)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), "left")  # texts longer than t
    value = np.zeros((len(order), scores.shape[1]), np.float64)
    moved = np.zeros(scores.shape, bool)
    prev = np.zeros(len(scores), np.int16)
    for t in range(steps):
        n = live[t]
        at = begin[:n] + t
        v = value[:n]
        if t:
            best = v.argmax(1)
            top = v[np.arange(n), best][:, None] - switch
            jump = top > v
            moved[at], prev[at] = jump, best
            v = np.where(jump, top, v)
        value[:n] = v + scores[at]
    last = value.argmax(1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        path[at] = last[:n]
        last[:n] = np.where(moved[at, last[:n]], prev[at], last[:n])
    return path


def label(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``(doc_id, lang_pred, score, n_spans)`` of every row, and with ``spans`` their
    ``(begin, end, lang)`` in bytes of the UTF-8 text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        m, roller = shared.value, Roller(8)
        for batch in batches:
            n, k = batch.num_rows, len(m.langs)
            begins, ends, rows, values, letter = [], [], [], [], []
            has = np.zeros(n, bool)
            for first, last, data, offs in chunks(batch):
                s, e, row, bins, word, script = _features(data, offs, roller)
                low = LOWER[data]
                plain = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
                has[first:last] = plain[offs[1:]] > plain[offs[:-1]]
                for i in np.flatnonzero(~has[first:last]).tolist():
                    rest = data[offs[i]:offs[i + 1]]
                    if len(rest) and rest.max() >= 128:
                        has[first + i] = any(c.isalpha() for c in rest.tobytes().decode("utf-8", "replace"))
                if len(s) == 0 or k == 0:
                    continue
                total, own = _word_scores(s, bins, word, m.scores)
                v = total[e] - total[s] + own + m.candidates[script]
                high = np.concatenate(([0], np.cumsum(((low >= 97) & (low <= 122)) | (low >= 128))))
                weight = high[e] - high[s]
                v[weight == 0] = 0
                values.append(v.astype(np.float32))
                letter.append(weight)
                rows.append(first + row)
                begins.append(s - offs[row])
                ends.append(e - offs[row])
            lang = np.full(n, UND, dtype=object)
            score, n_spans = np.zeros(n), np.zeros(n, np.int64)
            lists = [[] for _ in range(n)] if spans else None
            if values:
                v, row, weight = np.concatenate(values), np.concatenate(rows), np.concatenate(letter)
                length = np.bincount(row, minlength=n)
                begin = np.concatenate(([0], np.cumsum(length)[:-1]))
                some = np.flatnonzero(length)
                path = viterbi(v, begin[some], length[some], m.switch)
                mass = np.zeros((n, k))
                np.add.at(mass, (row, path), weight)
                top = mass.argmax(1)
                good = has & (mass.sum(1) > 0)
                lang[good] = np.array(m.langs, dtype=object)[top[good]]
                score[good] = mass[good, top[good]] / mass[good].sum(1)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (path[1:] != path[:-1])
                n_spans = np.where(good, np.bincount(row[new], minlength=n), 0)
                if spans:
                    b, e = np.concatenate(begins), np.concatenate(ends)
                    at = np.flatnonzero(new)
                    to = np.concatenate((at[1:], [len(row)])) - 1
                    for r, x, y, g in zip(row[at].tolist(), b[at].tolist(), e[to].tolist(), path[at].tolist()):
                        if good[r]:
                            lists[r].append({"begin": x, "end": y, "lang": m.langs[g]})
            cols = [batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(n_spans)]
            names = ["doc_id", "lang_pred", "score", "n_spans"]
            if spans:
                cols.append(pa.array(lists, span_type))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    schema = "doc_id long, lang_pred string, score double, n_spans long"
    if spans:
        schema += ", spans array<struct<begin:long,end:long,lang:string>>"
    return need(docs, "doc_id", "text").mapInArrow(run, schema)
