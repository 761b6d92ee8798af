"""Language-model scoring with a Katz backoff model.

The model: unigram counts are discounted by Good-Turing and the mass that is left goes
to one unknown word.  Bigrams met at least ``min_count`` times are stored with
discounted probabilities; the backoff weight of a context makes its probabilities
over all known words and the unknown one sum to exactly one:

    p(w | h) = d(c(hw)) c(hw) / n(h)   if hw is stored, else   a(h) p(w)
    a(h) = (1 - sum of stored p(. | h)) / (1 - sum of p(.) over the stored successors)

A token's recursion telescopes: log p(w | h) = log p(w) + log a(h), plus, where hw is
stored, log p(w | h) - log p(w) - log a(h).  So a text's score is a sum over its words
and its stored bigrams, and each part of the model can add its share alone.

The work:
1. Words are counted (blocks are pre-aggregated, packed and merged by hash).
2. Each block of texts sends its distinct bigrams with the texts they occur in, packed,
   to the part of the bigram's first word.  Words that would fill a part alone (at most
   ``4 * parts`` of them, found in 1.) are dealt by the whole bigram instead.  This is one
   shuffle, read twice: to count, and to score against the part's share of the model.
3. A part makes its share of the model itself, from its bigrams and the counts of their
   second words, which it asks of the word table (each distinct word once a part).  Only the
   sums of contexts that are dealt over parts are put together outside.
4. The parts' sums are added per text.

Words are known by 64-bit hashes.  Edge cases: null and empty texts have one token, the
end; a row without an id is learned from and keeps its null; repeated rows come back
repeated; without training text nothing is known; ties do not arise; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Roller, chunks, mix, pair_hash, parts as shuffle_parts, word_bounds, written

BEGIN = int(mix(np.array([0xB0], np.uint64)).view(np.int64)[0])
END = int(mix(np.array([0xE0], np.uint64)).view(np.int64)[0])
BLOCK_TOKENS = 1_000_000
"""Tokens of a block of texts."""
PART_TOKENS = 2_000_000
"""Tokens of a part's share of the corpus."""
K = 5
"""Counts up to this one are discounted."""


# ------------------------------------------------------------- packed arrays

def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 2 ** 8 else "<u2" if top < 2 ** 16 else "<u4" if top < 2 ** 32 else "<u8")


def pack(*arrays: np.ndarray) -> bytes:
    head = b"".join(struct.pack("<3sq", a.dtype.str.encode()[-3:].rjust(3, b"|"), len(a)) for a in arrays)
    return struct.pack("<i", len(arrays)) + head + b"".join(a.tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<i", data)[0]
    at, out = 4 + 11 * n, []
    for k in range(n):
        kind, size = struct.unpack_from("<3sq", data, 4 + 11 * k)
        a = np.frombuffer(data, np.dtype(kind.decode()), size, at)
        at += a.nbytes
        out.append(a)
    return out


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**24 as their low bytes and, compressed, the rest: rows of a block are
    few, so the rest takes some bits each, which the shuffle's own compression does not find."""
    high = (a >> 8).astype("<u2")
    return (a & 255).astype("<u1"), np.frombuffer(pa.compress(high.tobytes(), codec="zstd", asbytes=True), "<u1")


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    if len(low) == 0:
        return np.zeros(0, np.int64)
    raw = pa.decompress(high.tobytes(), decompressed_size=2 * len(low), codec="zstd", asbytes=True)
    return low + (np.frombuffer(raw, "<u2").astype(np.int64) << 8)


# ------------------------------------------------------------- tokens of a block

def _blocks(batches, tokens: int = BLOCK_TOKENS):
    """Gather ``(ids, held, word hashes, row of each word)`` of runs of whole texts."""
    roller = Roller(1)
    got, n_rows, n_words = ([], [], [], []), 0, 0

    def take():
        # nothing here keeps the block alive once it is handed on
        out = [np.concatenate(x, axis=-1) for x in got]
        for x in got:
            x.clear()
        return out
    for batch in batches:
        for first, last, data, offs in chunks(batch):
            s, e, row = word_bounds(data, offs)
            doc = batch.column("doc_id").slice(first, last - first)
            new = (np.stack((doc.cast(pa.int64()).fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))),
                   batch.column("held").slice(first, last - first).to_numpy(zero_copy_only=False),
                   roller.spans(roller.prefix(LOWER[data]), s, e), (row + n_rows).astype(np.int32))
            for x, y in zip(got, new):
                x.append(y)
            n_rows += last - first
            n_words += len(s)
            if n_words >= tokens or n_rows >= 2 ** 18:
                del new, s, e, row, doc
                yield take()
                n_rows, n_words = 0, 0
    if n_rows:
        yield take()


def count_words(docs: DataFrame) -> DataFrame:
    """``(w, c)``: the training count of every word hash, the end among them."""
    n = shuffle_parts(docs.sparkSession)

    def count(batches):
        for ids, held, words, rows in _blocks(batches):
            train = ~held
            w, c = np.unique(words[train[rows]], return_counts=True)
            ends = int(train.sum())
            if ends:
                w, c = np.append(w, np.uint64(END % 2 ** 64)), np.append(c, ends)
            part = part_of(w, n)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n + 1))
            keys = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([pack(w[o], _narrow(c[o])) for o in
                                           (order[cuts[k]:cuts[k + 1]] for k in keys)], pa.binary())],
                names=["part", "data"])

    def merge(batches):
        got = [unpack(x) for b in batches for x in b.column("data").to_pylist()]
        if got:
            w, where = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
            c = np.bincount(where, np.concatenate([x[1] for x in got]).astype(np.float64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["w", "c"])
    packed = docs.mapInArrow(count, "part long, data binary").repartition(n, "part")
    return packed.mapInArrow(merge, "w long, c long")


def _index(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and the place of each value among them (32 bits)."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return x[new], place


def _block_bigrams(block: list, size: np.ndarray):
    """Bigrams of a block: ``h, w`` (sorted), the places of their rows, rows that hold each,
    those rows and the times there.  ``block`` ends with the words and their rows, which are
    taken from it; ``size`` are the words of each row.  Arrays go as soon as they are used,
    so a block's peak is a few times its tokens."""
    m = len(size)
    at, words = block.pop(), block.pop()
    at = at + np.arange(len(words))  # among the tokens
    last = np.cumsum(size + 1) - 1  # a text of k words has k + 1 bigrams
    seen = np.empty(len(words) + m, np.uint64)
    seen[at + 1], seen[last - size] = words, np.uint64(BEGIN % 2 ** 64)
    hs, hid = _index(seen)
    seen[at], seen[last] = words, np.uint64(END % 2 ** 64)
    del words, at
    ws, wid = _index(seen)
    del seen, last
    key = hid.astype(np.uint64)
    del hid
    key *= np.uint64(len(ws))
    key += wid.astype(np.uint64)
    del wid
    doc = np.repeat(np.arange(m, dtype=np.int32), size + 1)
    new = np.ones(len(key), bool)
    if len(hs) * len(ws) < 2 ** 63 // max(m, 1):
        key *= np.uint64(m)
        key += doc.astype(np.uint64)
        key.sort()
        new[1:] = key[1:] != key[:-1]
        times = np.diff(np.append(np.flatnonzero(new), len(key))).astype(np.int32)
        key = key[new]
        doc = (key % np.uint64(m)).astype(np.int32)
        key //= np.uint64(m)
    else:
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        times = np.diff(np.append(np.flatnonzero(new), len(key))).astype(np.int32)
        key, doc = key[new], doc[new]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    many = np.diff(np.append(first, len(key))).astype(np.int32)
    key = key[first]
    h = hs[(key // np.uint64(len(ws))).astype(np.int64)]
    key %= np.uint64(len(ws))
    return h, ws[key.astype(np.int64)], first, many, doc, times


def send_bigrams(docs: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """Rows ``(part, kind, block, data)``: of each block its rows (``d``) and, by part, its
    bigrams with the rows that hold them (``b``)."""
    def run(batches):
        name = TaskContext.get().partitionId() << 32
        for block in _blocks(batches):
            yield from _shares(name, n, hot, block)
            name += 1

    return docs.mapInArrow(run, "part long, kind string, block long, data binary")


def _shares(name: int, n: int, hot: np.ndarray, block: list):
    """The packed rows of one block (see ``send_bigrams``)."""
    (ids, no_id), held = block[:2]
    m = len(ids)
    size = np.bincount(block[3], minlength=m)
    h, w, b, many, doc, times = _block_bigrams(block, size)
    part = part_of(h, n).astype(np.int32)
    common = np.isin(h, hot)
    part[common] = part_of(pair_hash(h[common], w[common]), n)
    del common
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n + 1))
    del part
    yield _rows([(name % n, "d", name, pack(ids.astype("<i8"), held.astype("<u1"), size.astype("<i8"), no_id.astype("<u1")))])
    for k in range(n):
        o = order[cuts[k]:cuts[k + 1]]
        if len(o):
            run_of = np.flatnonzero(np.concatenate(([True], h[o][1:] != h[o][:-1])))
            reps = many[o].astype(np.int64)
            post = np.repeat(b[o] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
            yield _rows([(k, "b", name, pack(h[o][run_of], _narrow(np.diff(np.append(run_of, len(o)))), w[o],
                                             _narrow(reps), *_split(doc[post]), _narrow(times[post]),
                                             np.packbits(held), np.array([m], "<i8")))])


def _rows(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      names=["part", "kind", "block", "data"])


def _entries(data: bytes):
    """A packed share of a block: h, w, postings a bigram, their rows and times, held, rows."""
    hs, runs, w, many, low, high, times, held, m = unpack(data)
    m = int(m[0])
    return np.repeat(hs, runs), w, many.astype(np.int64), _joined(low, high), times.astype(np.int64), \
        np.unpackbits(held)[:m].astype(bool), m


def _train_counts(blobs):
    """Distinct bigrams of a part (h, w) with their training counts."""
    hs, ws, cs = [], [], []
    for data in blobs:
        h, w, many, doc, times, held, _ = _entries(data)
        cum = np.concatenate(([0], np.cumsum(times * ~held[doc])))
        end = np.cumsum(many)
        c = cum[end] - cum[end - many]
        k = c > 0
        hs.append(h[k])
        ws.append(w[k])
        cs.append(c[k])
    if not hs:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int64)
    h, w, c = (np.concatenate(x) for x in (hs, ws, cs))
    g, first, where = np.unique(pair_hash(h, w), return_index=True, return_inverse=True)
    return h[first], w[first], np.bincount(where, c, len(g)).astype(np.int64)


# ------------------------------------------------------------- the model

def discounts(n: dict[int, int], k: int = K) -> list[float]:
    """Good-Turing factors of the counts 0..k (1 beyond); where the counts of counts do
    not give one between 0 and 1, half a count is taken off."""
    out = [1.0]
    n1, tail = n.get(1, 0), 0.0
    if n1:
        tail = (k + 1) * n.get(k + 1, 0) / n1
    for r in range(1, k + 1):
        d = 0.0
        if n.get(r, 0) and n1 and tail < 1:
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


def _times(c: np.ndarray, d) -> np.ndarray:
    """Discount of the count times the count."""
    return np.asarray(d)[np.minimum(c, len(d) - 1) * (c < len(d))] * c


def score(docs: DataFrame, order: int = 2, min_count: int = 2, fold: int = 5, held_fold: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every
    row; the rows with crc32 of the id modulo ``fold`` equal to ``held_fold`` are not learned from."""
    if order not in (1, 2):
        raise ValueError("order must be 1 or 2")
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.col("`doc_id`").cast("string")), F.lit(fold)) == held_fold
    docs = docs.select(F.col("`doc_id`").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"),
                       F.col("`text`").alias("text"))
    words = written(count_words(docs), "words")
    total = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, known = total["n"] or 0, total["v"]
    n1 = {r["c"]: r["count"] for r in words.filter(F.col("c") <= K + 1).groupBy("c").count().collect()}
    d1 = discounts(n1)
    left = sum((1 - d1[r]) * r * n1.get(r, 0) for r in range(1, K + 1))  # mass of the unknown word, in tokens
    if left <= 0:
        left = 1.0
        norm1 = tokens + 1.0
    else:
        norm1 = float(tokens)
    unknown = left / norm1 if tokens else 1.0

    n = max(1, -(-tokens // PART_TOKENS), min(shuffle_parts(spark), 12))
    often = words.filter(F.col("c") > max(1, tokens // (4 * n))).collect()  # at most 4 * n rows
    end = next((r["c"] for r in words.filter(F.col("w") == END).collect()), 0)
    hot = {r["w"] % 2 ** 64: r["c"] for r in often if r["w"] != END} | {BEGIN % 2 ** 64: end}
    hot_keys = np.array(sorted(hot), np.uint64)
    hot_counts = np.array([hot[x] for x in sorted(hot)], np.int64)

    sent = send_bigrams(docs, n, hot_keys).rdd.map(lambda r: (r[0], (r[1], r[2], bytes(r[3])))).partitionBy(n)

    def count(rows):
        by: dict[int, list[bytes]] = {}
        for part, (kind, _, data) in rows:
            if kind == "b":
                by.setdefault(part, []).append(data)
        for part, blobs in by.items():
            h, w, c = _train_counts(blobs)
            counts = np.bincount(np.minimum(c, K + 2), minlength=K + 3).astype(np.int64)
            h, w, c = (x[c >= min_count] for x in (h, w, c))
            common = np.isin(h, hot_keys)
            w, place = _index(w)
            yield part, counts.tolist(), bytearray(pack(w)), bytearray(
                pack(_narrow(np.searchsorted(hot_keys, h[common])), _narrow(place[common]), _narrow(c[common])))

    asked = hot_x = hot_p1 = None
    if order == 2 and tokens:
        counted = written(spark.createDataFrame(sent.mapPartitions(count), "part long, counts array<long>, data binary, "
                                                                           "hot binary"), "bigram-counts")
        got = counted.select(F.posexplode("counts").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("x")).collect()
        d2 = np.array(discounts({r["c"]: r["x"] for r in got}))

        def words_of(batches):
            for b in batches:
                for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
                    w = unpack(data)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), part)), pa.array(w.view(np.int64))],
                                                     names=["part", "w"])

        def by_part(batches):
            held_: dict[int, list] = {}
            for b in batches:
                cols = [b.column(c).to_numpy() for c in ("part", "w", "c")]
                order_ = np.argsort(cols[0], kind="stable")
                cols = [c[order_] for c in cols]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(cols[0])) + 1, [len(order_)])) if len(order_) else [0]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    held_.setdefault(int(cols[0][x]), []).append([c[x:y] for c in cols[1:]])
            for part, got_ in held_.items():
                w, c = (np.concatenate(x) for x in zip(*got_))
                w = w.view("<u8")
                o = np.argsort(w)
                yield _rows([(part, "m", 0, pack(w[o], _narrow(c[o])))])
        need_counts = counted.select("part", "data").mapInArrow(words_of, "part long, w long")
        asked = written(need_counts.join(words, "w").select("part", "w", "c").repartition(n, "part")
                                   .mapInArrow(by_part, "part long, kind string, block long, data binary"), "part-words")

        def hot_sums(batches):
            for b in batches:
                for data, hot_ in zip(b.column("data").to_pylist(), b.column("hot").to_pylist()):
                    c1 = unpack(data)[1].astype(np.int64)
                    k, place, c = (x.astype(np.int64) for x in unpack(hot_))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(len(hot_keys))),  # a part without such bigrams gives whole zeros
                         pa.array(np.bincount(k, _times(c, d2), len(hot_keys)).astype(float)),
                         pa.array(np.bincount(k, _times(c1[place], d1) / norm1, len(hot_keys)).astype(float))],
                        names=["k", "x", "p1"])
        sums = (counted.select("part", "hot").join(asked, "part").select("data", "hot")
                       .mapInArrow(hot_sums, "k long, x double, p1 double")
                       .groupBy("k").agg(F.sum("x").alias("x"), F.sum("p1").alias("p1")).collect())
        hot_x, hot_p1 = np.zeros(len(hot_keys)), np.zeros(len(hot_keys))
        for r in sums:
            hot_x[r["k"]], hot_p1[r["k"]] = r["x"], r["p1"]

    def share(h, w, c, asked_):
        """The part's share of the model: contexts, their norms and backoff weights (logarithms);
        its bigrams, and what each adds to the backed-off score."""
        context, where = np.unique(h, return_inverse=True)
        total_ = np.bincount(where, c, len(context))
        k = c >= min_count
        w, c, where = w[k], c[k], where[k]
        x = _times(c, d2)
        p1 = _times(_look_up(w, *asked_, 0).astype(np.int64), d1) / norm1
        sx, sp = (np.bincount(where, v, len(context)) for v in (x, p1))
        g = pair_hash(context[where], w)
        own = ~np.isin(context, hot_keys)
        at = np.searchsorted(np.sort(np.concatenate((context[own], hot_keys))), context)
        o = np.argsort(np.concatenate((context[own], hot_keys)))
        context, total_, sx, sp = (np.concatenate((u[own], v))[o] for u, v in (
            (context, hot_keys), (total_, hot_counts), (sx, hot_x), (sp, hot_p1)))
        norm = np.maximum(np.where(sx < total_, total_, total_ + 1), 1)
        ca = np.log10(norm)
        cb = np.where(sx > 0, np.log10(1 - sx / norm) - np.log10(1 - sp), 0.0)
        ga = np.log10(x) - np.log10(p1) - (ca + cb)[at[where]]
        o = np.argsort(g)
        return context, cb, g[o], ga[o]

    fitted = asked is not None
    base_norm = math.log10(tokens + 0.5 * (known + 1))
    factors = np.array(d1)

    def unigram(c):
        d = factors[np.minimum(c, K) * (c <= K)]
        with np.errstate(divide="ignore"):
            return np.where(c > 0, np.log10(d * np.maximum(c, 1) / norm1 if tokens else 1.0), math.log10(unknown))

    def add(rows):
        by: dict[int, list] = {}
        for part, (kind, block, data) in rows:
            if kind == "d":
                yield block, kind, bytearray(data)
            else:
                by.setdefault(part, []).append((kind, block, data))
        for items in by.values():
            h, w, c = _train_counts(x[2] for x in items if x[0] == "b")
            seen, where = np.unique(h, return_inverse=True)
            count_ = np.bincount(where, c, len(seen)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
            if fitted:
                asked_ = next((unpack(x[2]) for x in items if x[0] == "m"), [np.zeros(0, np.uint64)] * 2)
                ch, cb, g, ga = share(h, w, c, asked_)
                del asked_
            sums: dict[int, np.ndarray] = {}
            for kind, block, data in items:
                if kind != "b":
                    continue
                h, w, many, doc, times, _, m = _entries(data)
                c = _look_up(h, seen, count_, 0)
                c = np.where(np.isin(h, hot_keys), _look_up(h, hot_keys, hot_counts, 0), c)
                word = h != np.uint64(BEGIN % 2 ** 64)
                value = np.where(word, unigram(c), 0.0)
                if fitted:
                    value = value + _look_up(h, ch, cb, 0.0) + _look_up(pair_hash(h, w), g, ga, 0.0)
                base = np.where(word, np.log10(c + 0.5), 0.0)
                got_ = sums.setdefault(block, np.zeros((3, m)))
                for k, v in enumerate((value, base, (word & (c > 0)).astype(float))):
                    got_[k] += np.bincount(doc, np.repeat(v, many) * times, m)
            for block, got_ in sums.items():
                yield block, "s", bytearray(got_.tobytes())
    both = sent
    if asked is not None:
        both = sent.union(asked.rdd.map(lambda r: (r[0], (r[1], r[2], bytes(r[3])))).partitionBy(n))
    results = spark.createDataFrame(both.mapPartitions(add), "block long, kind string, data binary")
    end_score = float(unigram(np.array([end]))[0])

    def finish(batches):
        block, rows_, sums = None, None, None

        def out():
            ids, held_, size, no_id = unpack(rows_)
            s = sums if sums is not None else np.zeros((3, len(ids)))
            size_ = size + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int64), mask=no_id.astype(bool)), pa.array(held_.astype(bool)), pa.array(size_.astype(np.int64)),
                 pa.array(np.rint(s[2]).astype(np.int64) + (end > 0)), pa.array(np.full(len(ids), tokens, np.int64)),
                 pa.array(s[1] + math.log10(end + 0.5) - size_ * base_norm), pa.array(s[0] + end_score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        for b in batches:
            for k, kind, data in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "data"))):
                if k != block:
                    if rows_ is not None:
                        yield out()
                    block, rows_, sums = k, None, None
                if kind == "d":
                    rows_ = data
                else:
                    x = np.frombuffer(data, np.float64).reshape(3, -1)
                    sums = x.copy() if sums is None else sums + x
        if rows_ is not None:
            yield out()
    return (results.repartition(shuffle_parts(spark), "block").sortWithinPartitions("block")
                   .mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                       "base_score double, score double"))


def _look_up(x, keys, values, missing):
    """``values`` at the places of ``x`` in the sorted ``keys``."""
    if len(keys) == 0:
        return np.full(len(x), missing)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], missing)
