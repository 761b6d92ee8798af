"""Benchmark decontamination by q-gram lemma filtering.

Texts are folded (lower case, every run of ASCII punctuation and white space one
space).  Benchmark items are cut into overlapping probes.  A region within ``e``
edits of a probe of ``m`` bytes shares at least ``m - q + 1 - e*q`` of its q-grams, and
all of them lie within ``e`` diagonals of one another.  So the hits of a document are
counted per probe in diagonal bands that overlap by half; bands that reach the bound
are aligned to the probe with a banded edit-distance table, and kept if the distance
is within the budget.  Nothing within the budget is lost.

The probe index travels to the tasks in blocks of at most ``INDEX_BYTES`` of benchmark
text; a larger benchmark takes several passes over the documents.  A task works on ``WORK_BYTES``
of text and about ``HITS`` hits at a time; ``clean`` sends it the texts alone.

Edge cases: null or empty texts and items match nothing; an item shorter than a q-gram
must occur exactly, between spaces; repeated rows come back once a (doc_id, item_id), and
rows without an id as those of one id, null; ``clean`` judges each row by itself;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, chunks, need

Q = 10
PROBE = 100
"""Bytes of a probe; longer items have probes at every half of it."""
EDIT_RATE = 0.07
INDEX_BYTES = 8 << 20
WORK_BYTES = 1 << 18
"""Text bytes a task holds in its work arrays at a time (one longer text is taken alone)."""
HITS = 1 << 18
"""Hits counted at a time; those that may share a band with the last of them come on top."""
MASK = (1 << 22) - 1


def _fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for i in range(128):
        if not chr(i).isalnum():
            t[i] = 32
    return t


FOLD = _fold_table()


def fold(data: np.ndarray, offs: np.ndarray):
    """Folded bytes of a chunk, the new row borders, and the place of each byte before."""
    out = FOLD[data]
    if len(data):
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[upper] += 32
    space = out == 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    full = np.flatnonzero(np.diff(offs) > 0)
    keep[offs[full]] = True
    count = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], count[offs], np.flatnonzero(keep)


def fold_text(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return fold(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def probes_of(text: bytes, size: int = PROBE) -> list[tuple[int, bytes]]:
    """``(place, probe)``: the text itself, or windows of ``size`` bytes at every half of it."""
    if len(text) <= size:
        return [(0, text)] if text else []
    starts = [*range(0, len(text) - size, size // 2), len(text) - size]
    return [(a, text[a:a + size]) for a in starts]


def budget(m: int, rate: float, q: int) -> int:
    """Edits allowed in a probe: its share, as far as the lemma still asks for a q-gram."""
    return max(0, min(int(rate * m), (m - q) // q))


def align(probe: bytes, region: bytes, e: int) -> tuple[int, int]:
    """Least edits that turn ``probe`` into a substring of ``region``, and where that ends;
    rows of the table are computed in the band of ``region`` only, left to right at once."""
    text = np.frombuffer(region, np.uint8)
    n, ramp = len(text), np.arange(len(text) + 1)
    row = np.zeros(n + 1, np.int64)
    for i, c in enumerate(probe, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp  # insertions run along the row
        if row.min() > e:
            break
    at = int(row.argmin())
    return int(row[at]), at


class Index:
    """Probes of a block of items and the sorted hashes of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, size: int):
        self.q, self.items, self.places, self.probes, self.edits = q, [], [], [], []
        self.short: dict[int, list[int]] = {}
        roller, hashes, owner, place = Roller(10), [], [], []
        for item, text in items:
            for a, p in probes_of(fold_text(text), size):
                k = len(self.probes)
                self.items.append(item)
                self.places.append(a)
                self.probes.append(p)
                self.edits.append(budget(len(p), rate, q))
                if len(p) < q:
                    self.short.setdefault(len(p), []).append(k)
                    continue
                pre = roller.prefix(np.frombuffer(p, np.uint8))
                at = np.arange(len(p) - q + 1)
                hashes.append(roller.spans(pre, at, at + q))
                owner.append(np.full(len(at), k))
                place.append(at)
        cat = lambda v, t: np.concatenate(v).astype(t) if v else np.zeros(0, t)
        h, owner, place = cat(hashes, np.uint64), cat(owner, np.int64), cat(place, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.owner, self.place = h[order], owner[order], place[order]
        self.seen = np.zeros(MASK + 1, bool)
        self.seen[h & np.uint64(MASK)] = True
        size_ = np.array([len(p) for p in self.probes], np.int64)
        self.edits = np.array(self.edits, np.int64)
        self.bound = np.maximum(1, size_ - q + 1 - self.edits * q)
        self.width = 2 * (2 * self.edits + 1)
        self.reach = int((size_ + self.width).max(initial=0))


def _slices(at: np.ndarray, times: np.ndarray, reach: int):
    """Slices of the sorted places ``at`` with about ``HITS`` hits each.  A slice goes on for
    ``reach`` bytes into the next, so the band of a hit that begins in it is whole there."""
    total, begin = np.cumsum(times), 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - times[begin] + HITS, "right")))
        yield slice(begin, int(np.searchsorted(at, at[end - 1] + reach, "right")))
        begin = end


def _bands(index: Index, at, lo, hi, row, n: int) -> set[tuple[int, int, int, int]]:
    """``(row, probe, diagonal, width)`` of the diagonal bands that reach the bound."""
    times = hi - lo
    post = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
    probe, row = index.owner[post], np.repeat(row, times)
    diagonal = np.repeat(at, times) - index.place[post] + n  # never negative
    width, hits = index.width[probe], set()
    for shift in (0, 1):
        band = (diagonal + shift * (width // 2)) // width
        key = np.stack((row, probe, band))
        order = np.lexsort(key[::-1])
        key = key[:, order]
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate((begin, [key.shape[1]])))
        enough = count >= index.bound[key[1, begin]]
        for r, p, b in key[:, begin[enough]].T.tolist():
            w = int(index.width[p])
            hits.add((r, p, b * w - shift * (w // 2) - n, w))
    return hits


def _matches(index: Index, data, offs, roller):
    """``(row, probe, edits, end)`` of a chunk of folded texts."""
    q, found = index.q, []
    n = len(data) - q + 1
    if n > 0 and len(index.h):
        pre = roller.prefix(data)
        at = np.arange(n)
        h = roller.spans(pre, at, at + q)
        at = np.flatnonzero(index.seen[h & np.uint64(MASK)])
        h = h[at]
        lo, hi = np.searchsorted(index.h, h, "left"), np.searchsorted(index.h, h, "right")
        row = np.searchsorted(offs, at, "right") - 1
        ok = (hi > lo) & (at + q <= offs[row + 1])
        at, lo, hi, row = at[ok], lo[ok], hi[ok], row[ok]
        hits = set()
        for part in _slices(at, hi - lo, index.reach):
            hits |= _bands(index, at[part], lo[part], hi[part], row[part], len(data))
        tried = set()
        for r, p, d, w in sorted(hits):
            e, m = int(index.edits[p]), len(index.probes[p])
            a, z = max(int(offs[r]), d - e), min(int(offs[r + 1]), d + w + m + e)
            region = data[a:z].tobytes()
            exact = region.find(index.probes[p])
            if exact >= 0:
                got, stop = 0, exact + m
            else:
                got, stop = align(index.probes[p], region, e)
            if got <= e and (r, p, a + stop) not in tried:
                tried.add((r, p, a + stop))
                found.append((r, p, got, a + stop))
    if index.short:
        for r in range(len(offs) - 1):
            line = b" " + data[offs[r]:offs[r + 1]].tobytes().strip() + b" "
            for ks in index.short.values():
                found.extend((r, k, 0, int(offs[r])) for k in ks if b" " + index.probes[k] + b" " in line)
    return found


def _indexes(benchmark: DataFrame, q: int, probe: int, rate: float, index_bytes: int):
    """Broadcast probe indexes, each of at most about ``index_bytes`` of benchmark text."""
    items = need(benchmark, "item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // index_bytes))
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(
            Index(sorted({(r["item_id"], r["text"]) for r in mine}, key=repr), q, rate, probe))


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, probe: int = PROBE, rate: float = EDIT_RATE,
          index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``(doc_id, item_id, n_probes, n_regions, min_edits)``: documents with a region
    within the edit budget of a probe of an item."""
    out = None
    for shared in _indexes(benchmark, q, probe, rate, index_bytes):
        def run(batches, shared=shared):
            index, roller = shared.value, Roller(10)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = []
                for first, last, data, offs in chunks(batch, size=WORK_BYTES):
                    data, offs, _ = fold(data, offs)
                    rows += [(ids[first + r], index.items[p], p, e) for r, p, e, _ in _matches(index, data, offs, roller)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 names=["doc_id", "item_id", "probe", "edits"])
        part = need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, item_id long, probe int, edits int")
        out = part if out is None else out.unionByName(part)
    return (out.groupBy("doc_id", "item_id")
               .agg(F.count_distinct("probe").alias("n_probes"), F.count(F.lit(1)).alias("n_regions"),
                    F.min("edits").alias("min_edits")))


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, probe: int = PROBE, rate: float = EDIT_RATE,
          index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage.  Each row is judged by its
    own text where it lies, whatever its id."""
    for shared in _indexes(benchmark, q, probe, rate, index_bytes):
        docs = docs.filter(_free(shared)(F.col("`text`")))
    return docs


def _free(shared):
    """Whether a text matches no probe of a broadcast index.  Only texts go to Python, and
    only the answer comes back."""
    @F.arrow_udf("boolean")
    def free(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, roller = shared.value, Roller(10)
        for text in texts:
            keep = np.ones(len(text), bool)
            for first, _, data, offs in chunks(pa.RecordBatch.from_arrays([text], names=["text"]), size=WORK_BYTES):
                data, offs, _ = fold(data, offs)
                keep[[first + r for r, _, _, _ in _matches(index, data, offs, roller)]] = False
            yield pa.array(keep)
    return free
