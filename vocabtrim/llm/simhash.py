"""SimHash near-duplicates by segment-popcount embedding.

1. Fingerprint: majority bits of the XXH64 values of a text's word shingles.
2. Embedding: the 64 bits are cut into 32 segments of two bits; a fingerprint maps
   to its bit counts per segment.  One changed bit moves one count by one, so the
   Manhattan distance of two count vectors never exceeds the Hamming distance.  The
   counts are kept in unary code, where Manhattan distance is a popcount of an XOR.
3. Grid range join: the segments form ``max_distance + agree`` coordinate groups.
   Vectors within the distance agree on at least ``agree`` whole groups, so for each
   choice of groups the join key is those counts together with a grid cell of the
   remaining total count (cells are wider than the distance; a vector close to the
   upper border also enters the next cell).  No linked pair can be missed.
4. A cell of more than ``hot`` members is not compared: its members go to cells of the
   next level, where the segments that its key leaves out form groups in the same way.
   So a fingerprint enters a number of cells that depends on the masks alone, and the
   rows grow with the input.  At the last level at most ``max_distance`` segments are
   left out and a cell is compared whatever its size.
5. In each cell the lower bound is applied first, then the exact bit distance.
   A cell hands on a spanning star of its linked fingerprints, never its pairs.

Only distinct fingerprints are joined, so a group of copies counts once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, need, parts, written
from .components import components

LOW = 0x5555555555555555
CELL = 8
SEGMENTS = 32
AGREE = 4
HOT = 2000
"""Members of a cell above which it is cut finer."""


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit fingerprint as a signed long.

    Fewer words than ``shingle``: the whole sequence is one shingle; none (or null):
    zero.  A bit is set if more than half of the shingles, repeats included, set it."""
    def run(batches):
        from xxhash import xxh64_intdigest as digest
        for batch in batches:
            ids, out = batch.column("doc_id"), np.zeros(batch.num_rows, np.uint64)
            for first, last, data, offs in chunks(batch):
                raw, values, counts = LOWER[data].tobytes(), [], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    words = raw[a:b].split()
                    if len(words) <= shingle:
                        counts.append(1 if words else 0)
                        if words:
                            values.append(digest(b" ".join(words), 42))
                        continue
                    line = b" ".join(words)
                    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    start = np.concatenate(([0], end[:-shingle] + 1)).tolist()
                    counts.append(len(start))
                    values.extend([digest(line[x:y], 42) for x, y in zip(start, end[shingle - 1:].tolist())])
                counts = np.array(counts)
                some = np.flatnonzero(counts)
                if len(some):
                    h = np.array(values, dtype="<u8")
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    begin = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
                    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
                    set_ = 2 * ones > counts[some][:, None]
                    out[first + some] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([ids, pa.array(out.view(np.int64))], names=["doc_id", "fp"])
    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def unary_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in unary code (0 -> 00, 1 -> 01, 2 -> 11)."""
    low = F.lit(LOW).cast("long")
    half = F.shiftrightunsigned(fp, 1)
    return (fp.bitwiseOR(half)).bitwiseAND(low).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def _choices(segments: list[int], max_distance: int, agree: int) -> list[list[int]]:
    """Every choice of ``agree`` of ``max_distance + agree`` groups of the segments, as the
    segments chosen; fewer groups if there are not enough segments."""
    agree = min(agree, len(segments) - max_distance)
    if agree <= 0:
        return []
    cuts = np.linspace(0, len(segments), max_distance + agree + 1).round().astype(int).tolist()
    groups = [segments[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return [sum(c, []) for c in combinations(groups, agree)]


def _mask(segments: list[int]) -> int:
    """Bit mask of segments, as a signed long."""
    m = sum(3 << (2 * i) for i in segments)
    return m - 2 ** 64 if m >= 2 ** 63 else m


def _levels(max_distance: int, agree: int) -> list[list[tuple[int, int, int]]]:
    """For each level its choices ``(from, number, mask)``, ``from`` a choice of the level before."""
    used, levels = {0: []}, []
    while True:
        level, now = [], {}
        for k, segments in used.items():
            rest = [i for i in range(SEGMENTS) if i not in segments]
            for chosen in _choices(rest, max_distance, agree):
                now[len(now)] = segments + chosen
                level.append((k, len(now) - 1, _mask(chosen)))
        if not level:
            return levels
        used = now
        levels.append(level)


def linked(fps: DataFrame, max_distance: int = 3, agree: int = AGREE, hot: int = HOT) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints linked by chains of at
    most ``max_distance`` differing bits.  ``fps``: ``(fp, rep)``, one row per
    distinct fingerprint with its representative id."""
    if not 0 <= max_distance < CELL:
        raise ValueError(f"max_distance must lie in 0..{CELL - 1}")
    spark = fps.sparkSession
    levels = _levels(max_distance, agree)
    u = unary_counts(F.col("fp"))
    keys = []
    for _, p, m in levels[0]:
        mask = F.lit(m).cast("long")
        rest = F.bit_count(u.bitwiseAND(F.bitwise_not(mask)))
        cell = F.floor(rest / CELL).cast("int")
        near = F.when(rest % CELL >= CELL - max_distance, F.array(cell, cell + 1)).otherwise(F.array(cell))
        key = lambda c: F.struct(F.lit(p).alias("p"), F.xxhash64(F.lit(p), u.bitwiseAND(mask), c).alias("key"))  # noqa: E731, B023
        keys.append(F.transform(near, key))
    rows = fps.select("fp", "rep", F.explode(F.flatten(F.array(*keys))).alias("k")).select("k.p", "k.key", "fp", "rep")
    edges = None
    for depth in range(len(levels)):
        most = hot if depth + 1 < len(levels) else 2 ** 63 - 1
        ordered = rows.repartition(parts(spark), "p", "key").sortWithinPartitions("p", "key")
        found = written(ordered.mapInArrow(lambda batches, most=most: _cells(batches, max_distance, most),
                                           "p int, key long, a long, b long, edge boolean"), "cells")
        mine = found.filter("edge").select("a", "b")
        edges = mine if edges is None else edges.unionByName(mine)
        left = found.filter("not edge")
        if depth + 1 == len(levels) or left.isEmpty():
            break
        # masks alone, whatever the data: at most C(7, 4) * C(7, 4) * C(6, 3) rows by default
        finer = F.broadcast(spark.createDataFrame(levels[depth + 1], "p int, q int, mask long"))
        rows = (left.select("p", "key", F.col("a").alias("fp"), F.col("b").alias("rep")).join(finer, "p")
                    .select(F.col("q").alias("p"), F.xxhash64("key", "q", u.bitwiseAND(F.col("mask"))).alias("key"), "fp", "rep"))
    return edges.distinct()


def _cells(batches, k: int, most: int):
    """Of sorted rows ``(p, key, fp, rep)``: the edges of each cell, and the rows of cells of
    more than ``most`` members as ``(p, key, fp, rep)``, unchanged."""
    def out(p, key, a, b, edge):
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
             pa.array(np.full(len(a), edge))], names=["p", "key", "a", "b", "edge"])

    def edges(some):
        stars = [_stars(fp, rep, k) for _, _, fp, rep in some]
        a, b = (np.concatenate([s[i] for s in stars]) if stars else np.zeros(0, np.int64) for i in (0, 1))
        zero = np.zeros(len(a), np.int64)
        return out(zero, zero, a, b, True)
    held, full = None, False  # the cell that may go on in the next batch; whether it is too large already
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("p", "key", "fp", "rep")]
        if len(cols[0]) == 0:
            continue
        done = []
        if held is not None:
            if held[0][-1] == cols[0][0] and held[1][-1] == cols[1][0]:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            else:
                if full:
                    yield out(*held, False)
                elif len(held[0]) > 1:
                    done.append(held)
                full = False
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        cut = np.concatenate(([0], new, [len(cols[0])]))
        for i in np.flatnonzero(np.diff(cut)[:-1] > 1).tolist():
            cell = [c[cut[i]:cut[i + 1]] for c in cols]
            if len(cell[0]) > most or (i == 0 and full):
                yield out(*cell, False)
            else:
                done.append(cell)
        if full and len(cut) > 2:
            if cut[1] == 1:
                yield out(*[c[:1] for c in cols], False)
            full = False
        held = [c[cut[-2]:] for c in cols]
        if full or len(held[0]) > most:
            # handed on at once but for one row, which tells where the cell ends
            yield out(*[c[1:] for c in held], False)
            held, full = [c[:1] for c in held], True
        yield edges(done)
    if held is not None:
        if full:
            yield out(*held, False)
        elif len(held[0]) > 1:
            yield edges([held])


def _stars(fp: np.ndarray, r: np.ndarray, k: int):
    """Of a cell, the edges (member, smallest id of its linked set)."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    f = fp.view(np.uint64)
    half = f >> np.uint64(1)
    low = np.uint64(LOW)
    u = ((f | half) & low) | ((f & half & low) << np.uint64(1))
    left = np.arange(len(f))
    while len(left) > 1:
        front, left, seen = left[:1], left[1:], [left[:1]]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for z in range(0, len(front), 256):
                part = front[z:z + 256, None]
                close = np.bitwise_count(u[part] ^ u[left]) <= k
                p, q = np.nonzero(close)
                q = q[np.bitwise_count(f[part[p, 0]] ^ f[left[q]]) <= k]
                hit[q] = True
            front, left = left[hit], left[~hit]
            seen.append(front)
        group = np.concatenate(seen)
        if len(group) > 1:
            root = r[group].min()
            other = r[group][r[group] != root]
            a.append(other)
            b.append(np.full(len(other), root))
    return np.concatenate(a), np.concatenate(b)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3, agree: int = AGREE,
                    hot: int = HOT) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest ``doc_id`` reachable over links, null if no row reached
    has one.  Null, empty and wordless texts share fingerprint zero and so one component;
    repeated rows come back repeated; an empty table gives an empty one; further columns
    are ignored."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    # fingerprints stand for themselves, so rows without an id are linked like any other
    comp = components(linked(reps.select("fp", F.col("fp").alias("rep")), max_distance, agree, hot))
    named = reps.join(comp.withColumnRenamed("id", "fp"), "fp", "left") \
                .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return (prints.join(named, "fp")
                  .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
