"""Source divergence audit: how far the term distributions of a language's sources lie
apart, over the terms that enough of its documents use.

1. Each task packs its documents into blocks: the distinct terms of a block, sorted, and
   each document's terms as sorted places in that list with their counts.
2. Iceberg prefix refinement finds the kept terms.  A prefix of a term lies in at least
   as many documents as the term, so prefixes are extended level by level, and those in
   fewer than ``min_docs`` documents of the language go with all that they begin.  In a
   block the terms are sorted, so the documents of a prefix are its runs.  Tasks know
   the live prefixes of the last level by a bitmap of their hashes of fixed size; a
   prefix let through by a collision is only counted once more.  The loop ends when all
   that is live is a complete term, counted exactly.
3. The kept terms are counted by (language, source), pre-aggregated in each block.
4. Distances of sources are sums over blocks of terms by tiles of sources, so a group
   holds at most ``TERMS * 2 * TILE`` values, whatever a language or source holds.

All arithmetic is on integers.

Edge cases: null text, lang and source are ''; a group without terms counts as zero
everywhere; repeated rows are documents of their own; a language that keeps no term has
distance 0 between its sources; a language with one source has no pairs; an empty table
gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Roller, chunks, mix, need, parts, word_bounds, written

BLOCK_BYTES = 4 << 20
BITS = 1 << 25
"""Bits of the broadcast bitmap (4 MB)."""
STRIPE = 1 << 16
TERMS = 1024
TILE = 256
SCALE, PRIOR = 1_000_000_000, 5

NOT_TERM = np.zeros(256, bool)
NOT_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def levels():
    """Prefix lengths in bytes: 3, 5, 8, 12, 18, 27, each about half as long again."""
    length = 3
    while True:
        yield length
        length += (length + 1) // 2


# ---------------------------------------------------------------- blocks

BLOCK = "langs array<string>, sources array<string>, n_terms int, data binary, counts binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers (as byte planes, which compress better) and bytes."""
    out = [np.array([len(a) for a in arrays], "<u8").tobytes()]
    for a in arrays:
        out.append(a.tobytes() if a.dtype == np.uint8
                   else np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, words: int) -> list[np.ndarray]:
    """``words`` arrays of numbers and one of bytes."""
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = np.frombuffer(raw, "<u8", words + 1).astype(np.int64)
    out, at = [], 8 * (words + 1)
    for n in size[:-1].tolist():
        out.append(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))
        at += 4 * n
    return [*out, np.frombuffer(raw, np.uint8, int(size[-1]), at)]


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Packed blocks of ``(lang, source, text)``; documents lie by (lang, source)."""
    def run(batches):
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for first, last, data, offs in chunks(batch, size=block_bytes):
                group = sorted(set(zip(langs[first:last], sources[first:last])))
                at = {g: i for i, g in enumerate(group)}
                of = np.array([at[g] for g in zip(langs[first:last], sources[first:last])], np.int64)
                order = np.argsort(of, kind="stable")
                place = np.empty(len(of), np.int64)
                place[order] = np.arange(len(of))
                start, end, row = word_bounds(data, offs, NOT_TERM)
                borders = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
                letters = np.ascontiguousarray(LOWER[data[~NOT_TERM[data]]]) if len(data) else np.zeros(0, np.uint8)
                coded = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(start), [None, pa.py_buffer(borders), pa.py_buffer(letters)]).dictionary_encode()
                rank = pc.sort_indices(coded.dictionary)
                terms = coded.dictionary.take(rank)
                n = len(terms)
                to = np.empty(n, np.int64)
                to[np.asarray(rank)] = np.arange(n)
                if n:
                    key, count = np.unique(place[row] * n + to[np.asarray(coded.indices)], return_counts=True)
                else:
                    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
                sizes = np.diff(np.frombuffer(terms.buffers()[1], np.int64, n + 1)) if n else np.zeros(0, np.int64)
                text = np.frombuffer(terms.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
                docs_of = np.bincount(of, minlength=len(group))
                pairs_of = np.bincount(key // max(n, 1), minlength=len(of))
                yield pa.RecordBatch.from_pylist(
                    [{"langs": [g[0] for g in group], "sources": [g[1] for g in group], "n_terms": n,
                      "data": _pack(docs_of, pairs_of, key % max(n, 1), sizes, text), "counts": _pack(count, text[:0])}],
                    schema=pa.schema([("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
                                      ("n_terms", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())]))
    return docs.select("lang", "source", "text").mapInArrow(run, BLOCK)


class Block:
    """One unpacked block."""

    def __init__(self, langs, sources, n_terms, data, counts, roller: Roller):
        self.langs, self.sources = langs, sources
        docs_of, pairs_of, self.term, self.size, self.text = _unpack(data, 4)
        self.count = None if counts is None else _unpack(counts, 1)[0]
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        self.doc = np.repeat(np.arange(len(pairs_of)), pairs_of)
        pairs = np.concatenate(([0], np.cumsum(pairs_of)))
        self.cut = pairs[np.concatenate(([0], np.cumsum(docs_of)))]
        self.roller, self.sums = roller, roller.prefix(self.text)
        self.keys = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n_terms, [None, pa.py_buffer(self.begin.astype(np.int64)), pa.py_buffer(self.text)])

    def spans(self, by_source: bool):
        """(lang, source, first pair, last pair + 1) by language or by (lang, source)."""
        k = 0
        while k < len(self.langs):
            e = k + 1
            while not by_source and e < len(self.langs) and self.langs[e] == self.langs[k]:
                e += 1
            if self.cut[e] > self.cut[k]:
                yield self.langs[k], self.sources[k], int(self.cut[k]), int(self.cut[e])
            k = e

    def terms(self, x: int, y: int, weights: np.ndarray | None = None):
        """Distinct terms of pairs x .. y, and with ``weights`` their sums."""
        term, n = self.term[x:y], len(self.size)
        if 8 * (y - x) < n:
            some, at = np.unique(term, return_inverse=True)
            return some, None if weights is None else np.bincount(at, weights[x:y]).astype(np.int64)
        if weights is None:
            seen = np.zeros(n, bool)
            seen[term] = True
            return np.flatnonzero(seen), None
        total = np.bincount(term, weights[x:y], n)
        some = np.flatnonzero(total)
        return some, total[some].astype(np.int64)

    def hashes(self, lang: str, terms: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of the first ``size`` bytes of ``terms`` in ``lang``."""
        a = self.begin[terms]
        return mix(self.roller.spans(self.sums, a, a + size) ^ np.uint64(_of_lang(lang)))

    def prefixes(self, terms: np.ndarray, length: int | None = None) -> pa.Array:
        keys = self.keys.take(pa.array(terms)).cast(pa.binary())
        return keys if length is None else pc.binary_slice(keys, 0, length)


def _of_lang(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _each(batches):
    roller = Roller(13)
    for batch in batches:
        names = [c for c in ("langs", "sources", "n_terms", "data", "counts") if c in batch.schema.names]
        for i in range(batch.num_rows):
            row = [batch.column(c)[i].as_py() for c in names]
            yield Block(*row, *[None] * (5 - len(row)), roller)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits at the hashes of ``(lang, key)``: set by stripe, united in parallel; the driver
    receives at most ``bits / 8`` bytes."""
    schema = pa.schema([("stripe", pa.int64()), ("bits", pa.binary())])

    def rows(held):
        return pa.RecordBatch.from_pylist([{"stripe": s, "bits": pa.compress(np.packbits(b, bitorder="little").tobytes(),
                                                                            codec="zstd", asbytes=True)}
                                           for s, b in held.items()], schema=schema)

    def put(batches):
        roller, held = Roller(13), {}
        for batch in batches:
            key = batch.column("key").to_pylist()
            text = np.frombuffer(b"".join(key), np.uint8)
            end = np.cumsum(np.fromiter(map(len, key), np.int64, len(key)))
            start = np.concatenate(([0], end[:-1])).astype(np.int64) if len(key) else end
            langs = np.array([_of_lang(x) for x in batch.column("lang").to_pylist()], np.uint64)
            h = mix(roller.spans(roller.prefix(text), start, end) ^ langs) % np.uint64(bits)
            stripe, at = (h // np.uint64(STRIPE)).astype(np.int64), (h % np.uint64(STRIPE)).astype(np.int64)
            order = np.argsort(stripe, kind="stable")
            stripe, at = stripe[order], at[order]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(stripe)) + 1, [len(stripe)])) if len(stripe) else [0]
            for a, b in zip(cut[:-1], cut[1:]):
                held.setdefault(int(stripe[a]), np.zeros(STRIPE, bool))[at[a:b]] = True
        yield rows(held)

    def unite(batches):
        held, now = {}, None
        for batch in batches:
            for s, b in zip(batch.column("stripe").to_pylist(), batch.column("bits").to_pylist()):
                if s != now:
                    if held:
                        yield rows(held)
                    held, now = {s: np.zeros(STRIPE, bool)}, s
                raw = pa.decompress(b, decompressed_size=STRIPE // 8, codec="zstd", asbytes=True)
                held[s] |= np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)
        if held:
            yield rows(held)
    n = min(bits // STRIPE, parts(keys.sparkSession))
    out = np.zeros(bits // 8, np.uint8)
    found = (keys.select("lang", "key").mapInArrow(put, "stripe long, bits binary")
                 .repartition(n, "stripe").sortWithinPartitions("stripe").mapInArrow(unite, "stripe long, bits binary"))
    for r in found.collect():
        raw = pa.decompress(bytes(r["bits"]), decompressed_size=STRIPE // 8, codec="zstd", asbytes=True)
        out[r["stripe"] * STRIPE // 8:(r["stripe"] + 1) * STRIPE // 8] = np.frombuffer(raw, np.uint8)
    return out


# ---------------------------------------------------------------- kept terms

def _prefix_counts(packed: DataFrame, length: int, before: int, live) -> DataFrame:
    """``(lang, key, complete, n)``: documents of a block by prefix of ``length`` bytes, of
    terms whose prefix of ``before`` bytes is live.  A term no longer than ``length`` is
    complete."""
    schema = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("complete", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        for b in _each(batches):
            for lang, _, x, y in b.spans(by_source=False):
                term, doc = b.term[x:y], b.doc[x:y]
                some, _ = b.terms(x, y)
                if live is not None:
                    some = some[b.size[some] > before]
                    some = some[_has(live.value, b.hashes(lang, some, np.full(len(some), before)))]
                if not len(some):
                    continue
                whole = b.size[some] <= length
                size = np.minimum(b.size[some], length)
                h = b.hashes(lang, some, size)
                new = np.ones(len(some), bool)
                new[1:] = (h[1:] != h[:-1]) | whole[1:] | whole[:-1]
                code = np.full(len(b.size), -1, np.int64)
                code[some] = np.cumsum(new) - 1
                c = code[term]
                doc, c = doc[c >= 0], c[c >= 0]
                first = np.ones(len(c), bool)
                first[1:] = (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])
                n = np.bincount(c[first], minlength=int(new.sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(n)), b.prefixes(some[new], length), pa.array(whole[new]), pa.array(n)],
                    schema=schema)
    return packed.drop("counts").mapInArrow(run, "lang string, key binary, complete boolean, n long")


def kept_terms(packed: DataFrame, min_docs: int = 30, bits: int = BITS) -> DataFrame:
    """``(lang, key, n)``: terms in at least ``min_docs`` documents of their language, by
    iceberg refinement of prefixes.  The longest live prefix bounds the rounds."""
    sc = packed.sparkSession.sparkContext
    kept, live, before = [], None, 0
    for length in levels():
        found = written(_prefix_counts(packed, length, before, live).groupBy("lang", "key", "complete")
                        .agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs), "prefixes")
        kept.append(found.filter("complete").select("lang", "key", "n"))
        rest = found.filter("not complete")
        if rest.isEmpty():
            break
        live, before = sc.broadcast(bitmap(rest, bits)), length
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def term_counts(packed: DataFrame, kept: DataFrame, bits: int = BITS) -> DataFrame:
    """``(lang, source, key, count)`` of kept terms that occur, summed in each block first."""
    live = packed.sparkSession.sparkContext.broadcast(bitmap(kept, bits))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("key", pa.binary()), ("count", pa.int64())])

    def run(batches):
        for b in _each(batches):
            for lang, source, x, y in b.spans(by_source=True):
                some, n = b.terms(x, y, b.count)
                mine = _has(live.value, b.hashes(lang, some, b.size[some]))
                some, n = some[mine], n[mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(source), len(n)), b.prefixes(some), pa.array(n)],
                    schema=schema)
    counts = packed.mapInArrow(run, "lang string, source string, key binary, count long")
    return (counts.groupBy("lang", "source", "key").agg(F.sum("count").alias("count"))
                  .join(kept.select("lang", "key"), ["lang", "key"], "left_semi"))


# ---------------------------------------------------------------- distances

def _p(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kinds)), exactly; 0 without kinds."""
    high = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)")
    low = F.nullif(total + PRIOR * kinds, F.lit(0)).cast("decimal(19,0)")
    return F.coalesce(1 + F.call_function("div", high, low), F.lit(0)).cast("long")


def distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` of each pair of source numbers a < b of a language.

    ``groups``: ``(lang, sid, p0, kinds)``; ``counts``: ``(lang, key, sid, p, kinds, tiles)``."""
    schema = "lang string, a int, b int, value long, terms long"

    def run(key, table):
        lang, _, ti, tj = (k.as_py() for k in key)
        sid, p = table.column("sid").to_numpy(), table.column("p").to_numpy()
        term = table.column("key").combine_chunks()
        base = np.asarray(term.is_null())
        # one row a source holds its value where it has no count
        own = np.sort(sid[base])
        zero = p[base][np.argsort(sid[base])]
        coded = term.filter(pa.array(~base)).dictionary_encode()
        n = len(coded.dictionary)
        m = np.repeat(zero[None, :], n, axis=0)
        m[np.asarray(coded.indices, np.int64), np.searchsorted(own, sid[~base])] = p[~base]
        left = np.flatnonzero(own // TILE == ti)
        right = np.flatnonzero(own // TILE == tj)
        a, b, v = [], [], []
        for i in left.tolist():
            to = right[right > i]
            a.append(np.full(len(to), own[i], np.int32))
            b.append(own[to].astype(np.int32))
            v.append(np.abs(m[:, to] - m[:, i:i + 1]).sum(axis=0))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        a, b, v = cat(a, np.int32), cat(b, np.int32), cat(v, np.int64)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "value": v,
                         "terms": np.full(len(a), n, np.int64)})
    tile = F.floor(F.col("sid") / TILE).cast("int")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("kinds") / TERMS)).cast("int")
    some = counts.select("lang", "key", "sid", "p", "tiles", F.pmod(F.xxhash64("key"), n_blocks).cast("int").alias("block"))
    none = groups.select("lang", F.lit(None).cast("binary").alias("key"), "sid", F.col("p0").alias("p"), "tiles",
                         F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    rows = (some.unionByName(none).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
                .select("lang", "block", F.least(tile, "t").alias("ti"), F.greatest(tile, "t").alias("tj"), "key", "sid", "p"))
    return (rows.groupBy("lang", "block", "ti", "tj").applyInArrow(run, schema)
                .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, block_bytes: int = BLOCK_BYTES, bits: int = BITS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` gives every other source
    of the language with the sum of |p - q| over the kept terms, part ``term`` the ``top``
    kept terms that the source has more of than the language."""
    rows = need(docs, "lang", "source", "text").select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    packed = written(blocks(rows, block_bytes), "term-blocks")
    kept = written(kept_terms(packed, min_docs, bits), "kept-terms")
    counts = written(term_counts(packed, kept, bits), "term-counts")

    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    by_lang = Window.partitionBy("lang")
    groups = written(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
            .fillna(0, ["total", "kinds"])
            .select("*", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("sid"),
                    F.sum("total").over(by_lang).alias("lang_total"), F.count(F.lit(1)).over(by_lang).alias("n"))
            .withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
            .withColumn("p0", _p(F.lit(0), F.col("total"), F.col("kinds"))), "term-groups")

    known = counts.join(groups.drop("p0", "n"), ["lang", "source"])
    known = known.withColumn("p", _p(F.col("count"), F.col("total"), F.col("kinds")))
    sums = distances(known, groups)
    name = lambda s: groups.select("lang", F.col("sid").alias(s), F.col("source").alias(f"{s}_name"),
                                   F.col("p0").alias(f"{s}_p0"), *([F.col("kinds")] if s == "a" else []))
    apart = (sums.join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"])
                 .withColumn("value", F.col("value") + (F.col("kinds") - F.col("terms")) * F.abs(F.col("a_p0") - F.col("b_p0")))
                 .select("lang", "value", F.explode(F.array(F.struct(F.col("a_name").alias("source"), F.col("b_name").alias("item")),
                                                            F.struct(F.col("b_name").alias("source"), F.col("a_name").alias("item")))).alias("s"))
                 .select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value"))

    of_lang = F.sum("count").over(Window.partitionBy("lang", "key"))
    more = (known.withColumn("q", _p(of_lang, F.col("lang_total"), F.col("kinds"))).filter("p > q")
                 .select("lang", "source", F.lit("term").alias("part"), F.col("key").cast("string").alias("item"),
                         (F.col("p") - F.col("q")).alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    return (apart.withColumn("rank", rank)
                 .unionByName(more.withColumn("rank", rank).filter(F.col("rank") <= top)))
