"""Repeated substrings by suffix arrays: which bytes lie in a string of ``length`` bytes
that also starts somewhere else.

1. Every ``length``-byte window of a text has an anchor, the leftmost of its ``gram``-byte
   substrings with the smallest hash.  Equal windows have equal anchors at equal
   places, so a repeated window meets its copy under the anchor's hash.  Neighbouring
   windows with one anchor form a zone (on average about 170 windows).
2. Zones are shuffled once, by anchor, and equal ones counted (those of a batch beforehand, so
   a common passage fills no task); a zone met twice is repeated whole and enters a shard
   once.  Zones whose anchor occurs in no other zone are settled too.  Only the others need
   text; nothing else of the zones is written.
3. The zones' bytes are cut out of the texts and dealt by anchor to shards of bounded
   size.  Each shard builds its suffix array by induced sorting and the permuted common
   prefixes, and marks windows that share ``length`` bytes with another one.
4. An anchor with more zones than a shard holds is dealt over several shards at random;
   the digests of its windows, each repeated string once a shard, are then compared
   over all its shards (so a digest comes at most once or twice a shard).
5. The marked windows of a text are united and their bytes removed.

Substring hashes are 64-bit; a zone is known by its anchor's and its own hash.

Edge cases: null, empty and short texts lose nothing; rows that repeat a whole text lose
all of it; ids that come with several texts keep them apart; rows without an id are known
by their text; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Roller, chunks, mix, need, pair_hash, whole_row, written
from .suffix_arrays import repeated

LENGTH = 400
GRAM = 64
SHARD_BYTES = 2 << 20

ZONES = "_id long, _th int, first int, n int, anchor long, zone long, met int, more boolean"
KEY = ["_id", "_th"]


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` neighbours (block-wise prefix and suffix minima)."""
    n = len(keys) - w + 1
    if n <= 0:
        return keys[:0]
    a = np.full(-(-len(keys) // w) * w, np.iinfo(keys.dtype).max, keys.dtype)
    a[:len(keys)] = keys
    a = a.reshape(-1, w)
    ahead = np.minimum.accumulate(a, axis=1).ravel()
    behind = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def zones_of(data: np.ndarray, offs: np.ndarray, length: int, gram: int, roller: Roller):
    """Zones of a chunk: row, first window, number of windows, anchor hash, zone hash."""
    if len(data) < length:
        return None
    prefix = roller.prefix(data)
    place = np.arange(len(data) - gram + 1)
    h = roller.spans(prefix, place, place + gram)
    # high half of the hash, then the place: the smallest is the leftmost of the least
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    anchor = (sliding_min(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + length <= offs[row + 1])
    if len(at) == 0:
        return None
    a, r = anchor[at], row[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    b = np.flatnonzero(new)
    first, last = at[b], at[np.concatenate((b[1:], [len(at)])) - 1]
    a, r = a[b], r[b]
    whole = mix(roller.spans(prefix, first, last + length) + (a - first).astype(np.uint64))
    return r, first - offs[r], last - first + 1, h[a], whole


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``(_id, _th, text, _row)``: a text's key (its id, or its hash for want of one, and 31
    bits of its hash), and the whole row as a struct, so that no other column's name can clash."""
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.xxhash64(F.col("`text`"), F.lit("no id"))).alias("_id"),
                       F.xxhash64(F.col("`text`")).bitwiseAND(0x7FFFFFFF).cast("int").alias("_th"),
                       F.col("`text`").alias("text"), whole_row(docs).alias("_row"))


def zones(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row a zone of the keyed texts.  ``met``: how many of the batch equal it, on the first of
    them; the others (``more``) are known to be repeated, so their place stands for the anchor
    and they are spread evenly."""
    def run(batches):
        roller = Roller(7)
        for batch in batches:
            ids, th = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            out = [[] for _ in range(6)]
            for first, last, data, offs in chunks(batch):
                found = zones_of(data, offs, length, gram, roller)
                if found:
                    r, w, n, anchor, whole = found
                    for c, v in zip(out, (ids[first + r], th[first + r], w.astype(np.int32), n.astype(np.int32),
                                          anchor.view(np.int64), whole.view(np.int64))):
                        c.append(v)
            if out[0]:
                cols = [np.concatenate(c) for c in out]
                i, w, anchor, whole = cols[0], cols[2], cols[4], cols[5]
                order = np.lexsort((anchor, whole))
                new = np.ones(len(order), bool)
                new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (whole[order[1:]] != whole[order[:-1]])
                b = np.flatnonzero(new)
                met, more = np.full(len(order), 2, np.int32), np.ones(len(order), bool)
                met[order[b]], more[order[b]] = np.diff(b, append=len(order)), False
                anchor[more] = pair_hash(i[more].view(np.uint64), w[more].astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, met, more)],
                                                 names=["_id", "_th", "first", "n", "anchor", "zone", "met", "more"])
    return docs.filter(F.octet_length("text") >= length).select(*KEY, "text").mapInArrow(run, ZONES)


def _met(found: DataFrame, length: int) -> DataFrame:
    """The zones that are met twice or need text, with ``met``, how often the zone is met, and
    ``lead``, whether it stands for its kind and its anchor has other kinds, not all met
    twice; ``bytes``: those of the anchor's kinds.  One shuffle serves both windows."""
    kind = Window.partitionBy("more", "anchor", "zone").orderBy(*KEY, "first")
    whole = kind.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    anchor = Window.partitionBy("more", "anchor")
    rows = (found.repartition("more", "anchor")
                 .withColumns({"met": F.sum("met").over(whole), "lead": F.row_number().over(kind) == 1})
                 .withColumns({"kinds": F.count_if("lead").over(anchor),
                               "bytes": F.sum(F.when(F.col("lead"), F.col("n") + length)).over(anchor),
                               "open": F.min("met").over(anchor) == 1})
                 .withColumn("lead", F.col("lead") & (F.col("kinds") > 1) & F.col("open")))
    return rows.filter("met > 1 or lead").drop("kinds", "open", "more")


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """Zone bytes out of rows ``(_id, _th, text, zs)``."""
    def run(batches):
        for batch in batches:
            out = []
            for i, t, text, zs in zip(*(batch.column(c).to_pylist() for c in ("_id", "_th", "text", "zs"))):
                raw = text.encode()
                out += [{"_id": i, "_th": t, "first": z["first"], "once": z["once"], "shard": z["shard"], "hot": z["hot"],
                         "bytes": raw[z["first"]:z["first"] + z["n"] + length - 1]} for z in zs]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("_id", pa.int64()), ("_th", pa.int32()), ("first", pa.int32()), ("once", pa.bool_()),
                 ("shard", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())]))
    return rows.mapInArrow(run, "_id long, _th int, first int, once boolean, shard long, hot boolean, bytes binary")


FOUND = "_id long, _th int, first int, last int, digests binary"


def _runs(many: np.ndarray):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], many.astype(np.int8), [0]))))
    return zip(edge[::2].tolist(), (edge[1::2] - 1).tolist())


def _sort_shards(parts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of the zones met once; of an anchor dealt over several
    shards also the digests of its windows, those of a repeated string once a shard
    (0: left out)."""
    def flush(rows, roller):
        out, told = [], set()
        marks = repeated([x["bytes"] for x in rows], [len(x["bytes"]) - length + 1 for x in rows], length)
        for x, many in zip(rows, marks):
            if x["once"]:
                out += [(x["_id"], x["_th"], x["first"] + a, x["first"] + b, None) for a, b in _runs(many)]
            if x["hot"]:
                data = np.frombuffer(x["bytes"], np.uint8)
                at = np.arange(len(many))
                h = roller.spans(roller.prefix(data), at, at + length) | np.uint64(1)
                for k in np.flatnonzero(many | (not x["once"])).tolist():
                    if int(h[k]) in told:
                        h[k] = 0
                    else:
                        told.add(int(h[k]))
                if h.any():
                    out.append((x["_id"], x["_th"], x["first"], x["first"], h.astype("<u8").tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        cols = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          names=["_id", "_th", "first", "last", "digests"])

    def run(batches):
        roller, held, shard = Roller(77), [], None
        for batch in batches:
            for x in batch.to_pylist():
                if held and x["shard"] != shard:
                    yield flush(held, roller)
                    held = []
                shard = x["shard"]
                held.append(x)
        if held:
            yield flush(held, roller)
    return parts.mapInArrow(run, FOUND)


def _match_digests(left: DataFrame, buckets: int) -> DataFrame:
    """Windows of ``left`` whose digest comes twice: packed by bucket, compared as arrays."""
    item = np.dtype([("h", "<u8"), ("_id", "<i8"), ("_th", "<i4"), ("w", "<i4")])

    def deal(batches):
        for batch in batches:
            packed: dict[int, list[bytes]] = {}
            for i, t, f, d in zip(*(batch.column(c).to_pylist() for c in ("_id", "_th", "first", "digests"))):
                h = np.frombuffer(d, "<u8")
                at = np.flatnonzero(h)
                rec = np.empty(len(at), item)
                rec["h"], rec["_id"], rec["_th"], rec["w"] = h[at], i, t, f + at
                to = (rec["h"] >> np.uint64(1)) % np.uint64(buckets)
                for k in np.unique(to).tolist():
                    packed.setdefault(k, []).append(rec[to == k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int64()),
                                              pa.array([b"".join(v) for v in packed.values()], pa.binary())],
                                             names=["bucket", "items"])

    def match(rows):
        rec = np.frombuffer(b"".join(rows), item)
        rec = np.sort(rec, order=["_id", "_th", "w"])
        _, where, count = np.unique(rec["h"], return_inverse=True, return_counts=True)
        return rec[count[where] > 1]

    def join(batches):
        held, bucket = [], None
        for batch in batches:
            for k, data in zip(batch.column("bucket").to_pylist(), batch.column("items").to_pylist()):
                if held and k != bucket:
                    yield _as_runs(match(held))
                    held = []
                bucket = k
                held.append(data)
        if held:
            yield _as_runs(match(held))

    def _as_runs(rec):
        new = np.ones(len(rec), bool)
        new[1:] = ((rec["_id"][1:] != rec["_id"][:-1]) | (rec["_th"][1:] != rec["_th"][:-1])
                   | (rec["w"][1:] != rec["w"][:-1] + 1))
        b = np.flatnonzero(new)
        e = np.concatenate((b[1:], [len(rec)])) - 1 if len(b) else b
        return pa.RecordBatch.from_arrays(
            [pa.array(rec["_id"][b]), pa.array(rec["_th"][b]), pa.array(rec["w"][b]), pa.array(rec["w"][e])],
            names=["_id", "_th", "first", "last"])
    return (left.mapInArrow(deal, "bucket long, items binary").repartition(min(buckets, 10_000), "bucket")
                .sortWithinPartitions("bucket")
                .mapInArrow(join, "_id long, _th int, first int, last int"))


def repeated_windows(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
                     shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(_id, _th, first, last)``: runs of window starts that also start elsewhere."""
    if gram > length:
        gram = length
    keyed = _keyed(docs, key)
    found = written(_met(zones(keyed, length, gram), length), "zones")
    settled = found.filter("met > 1").select(*KEY, "first", (F.col("first") + F.col("n") - 1).alias("last"))

    several = found.filter("lead")
    size = F.col("n") + length
    total = several.agg(F.sum(size), F.sum(F.when(F.col("bytes") > shard_bytes, size))).first()
    if not total[0]:
        return settled
    shards, hot_bytes = max(1, -(-total[0] // shard_bytes)), total[1] or 0
    blocks = F.ceil(F.col("bytes") / shard_bytes)
    of_shard = F.when(blocks > 1, F.pmod(F.xxhash64("anchor", F.pmod("zone", blocks)), F.lit(shards))) \
                .otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    need_text = (several.select(*KEY, F.struct("first", "n", (F.col("met") == 1).alias("once"), of_shard.alias("shard"),
                                               (blocks > 1).alias("hot")).alias("z"))
                        .groupBy(*KEY).agg(F.collect_list("z").alias("zs")))
    texts = keyed.filter(F.octet_length("text") >= length).select(*KEY, "text")
    rows = texts.join(need_text, KEY)
    parts = _cut(rows, length)
    parts = parts.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", *KEY, "first")
    result = written(_sort_shards(parts, length), "repeated-windows")
    out = settled.unionByName(result.filter("digests is null").select(*KEY, "first", "last"))
    if hot_bytes:
        left = result.filter("digests is not null").select(*KEY, "first", "digests")
        out = out.unionByName(_match_digests(left, max(1, -(-hot_bytes // (shard_bytes // 24)))))
    return out


def marked(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
           shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(_row, _runs)``: each row with its sorted runs of repeated window starts (null: none)."""
    runs = (repeated_windows(docs, key, length, gram, shard_bytes)
            .groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("_runs")))
    return _keyed(docs, key).join(runs, KEY, "left").select("_row", "_runs")


def spans(runs, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the windows of sorted runs."""
    out: list[list[int]] = []
    for r in (() if runs is None else runs):
        a, b = r["first"], r["last"] + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, **how) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    def run(batches):
        for batch in batches:
            out = []
            for i, text, runs in zip(*(batch.column(c).to_pylist() for c in (key, "text", "_runs"))):
                raw, gone, kept, at = (text or "").encode(), spans(runs, length), hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append({key: i, "n_bytes": len(raw), "n_removed": sum(b - a for a, b in gone),
                            "n_spans": len(gone), "kept_sha256": kept.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [(key, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("kept_sha256", pa.string())]))
    rows = marked(need(docs, key, "text"), key, length, **how).select(f"_row.`{key}`", "_row.text", "_runs")
    return rows.mapInArrow(run, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, **how) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``.  A character that is cut by
    a span's border stays whole; a row whose text is used up goes."""
    @F.pandas_udf("string")
    def rest(text, runs):
        import pandas as pd
        out = []
        for t, r in zip(text, runs):
            if r is None or len(r) == 0:
                out.append(t)
                continue
            raw, at, keep = t.encode(), 0, []
            for a, b in spans(r, length):
                while a < len(raw) and (raw[a] & 0xC0) == 0x80:
                    a += 1
                while b < len(raw) and (raw[b] & 0xC0) == 0x80:
                    b -= 1
                keep.append(raw[at:a])
                at = max(at, b)
            keep.append(raw[at:])
            out.append(b"".join(keep).decode())
        return pd.Series(out, dtype=object)
    # a deterministic function would run again, in workers of its own, in the filter below
    rest = rest.asNondeterministic()
    rows = marked(docs, key, length, **how).withColumn("_left", rest(F.col("_row.text"), F.col("_runs")))
    used_up = F.col("_runs").isNotNull() & (F.trim(F.coalesce("_left", F.lit(""))) == "")
    return rows.filter(~used_up).select(
        *[F.col("_left" if c == "text" else f"_row.`{c}`").alias(c) for c in docs.columns])
