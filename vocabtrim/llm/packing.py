"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents become token pieces; a full piece is a sequence by itself.  The other
pieces are dealt by a hash into problems of bounded size.  Each problem is evolved
on several islands at once (one Spark row an island): a solution is a list of bins,
crossover injects well-filled bins of one parent whole into the other, bins that
share a piece with them go, and the displaced pieces are put back best-fit.  Between
rounds the best solution of each island moves to the next one (a join).  Pieces of
the bins left poorly filled are pooled over all problems and packed once more.

Edge cases: a null or empty text is one piece of one token (the end id); repeated
rows are packed as often as they come; equal lengths are ordered by the piece's row
number; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CachedBpe, chunks, need, written
from .separator_scan import tokenizer_path

LENGTH = 2048
PROBLEM = 2048
"""Pieces of a problem, on average (a hash deals them)."""
ISLANDS, ROUNDS, POPULATION, GENERATIONS = 2, 2, 8, 24
LOOSE = 0.97
"""Bins filled below this share are pooled and packed again."""

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


CHUNK = 4 << 20
"""Text bytes that are cut into words at a time."""


def pieces(docs: DataFrame, length: int = LENGTH, end: int = 0, path: str | None = None) -> DataFrame:
    """Token pieces of every document: its ids, then the id ``end``.  A document longer
    than ``length`` is cut so that only its first piece is shorter.  ``uid`` numbers the
    rows (partition and place), so the table must be written before it is read twice."""
    where = path or tokenizer_path()

    def run(batches):
        encode, tail = CachedBpe(where), np.array([end], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            out, docs = [[] for _ in range(6)], batch.column("doc_id").to_pylist()
            # each distinct word of a chunk is looked up once
            texts = ((docs[first + k], found[a:b]) for first, _, data, offs in chunks(batch, size=CHUNK)
                     for found, at in [encode.many(data, offs)] for k, (a, b) in enumerate(zip(at[:-1], at[1:])))
            for doc, found in texts:
                ids = found.tobytes() + tail
                n = len(ids) // 4
                cuts = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    for col, v in zip(out, (uid, doc, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))):
                        col.append(v)
                    uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
    return need(docs, "doc_id", "text").mapInArrow(run, PIECES)


# ------------------------------------------------------------- one island

def best_fit(bins: list[list[int]], items, size, cap: int) -> list[list[int]]:
    """Put items, longest first, into the fullest bin that takes them, else a new one."""
    free = sorted((cap - sum(map(size.__getitem__, b)), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-size[i], i)):
        at = bisect_left(free, (size[i], -1))
        if at == len(free):
            bins.append([i])
            insort(free, (cap - size[i], len(bins) - 1))
        else:
            room, k = free.pop(at)
            bins[k].append(i)
            insort(free, (room - size[i], k))
    return bins


def fitness(bins, size, cap: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (sum of squared fills)."""
    return -len(bins), sum((sum(map(size.__getitem__, b)) / cap) ** 2 for b in bins)


def crossover(one, two, size, cap: int, rng) -> list[list[int]]:
    """Inject well-filled bins of ``two`` whole into ``one``."""
    fills = np.array([sum(map(size.__getitem__, b)) for b in two])
    good = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    some = rng.choice(good, max(1, len(good) // 3), replace=False)
    child = [list(two[k]) for k in some.tolist()]
    placed = {i for b in child for i in b}
    lost = []
    for b in one:
        if placed.isdisjoint(b):
            child.append(list(b))
        else:
            lost.extend(i for i in b if i not in placed)
    return best_fit(child, lost, size, cap)


def mutate(bins, size, cap: int, rng) -> list[list[int]]:
    """Empty the worst-filled bins and a few others, and put their pieces back."""
    fills = np.array([sum(map(size.__getitem__, b)) for b in bins]) + rng.random(len(bins)) * cap * 0.2
    gone = set(np.argsort(fills, kind="stable")[:max(1, len(bins) // 20)].tolist())
    return best_fit([list(b) for k, b in enumerate(bins) if k not in gone],
                    [i for k in gone for i in bins[k]], size, cap)


def evolve(size: list[int], guests, cap: int, seed, population: int, generations: int) -> list[list[int]]:
    """Best solution of one island after some generations; ``guests`` join the start."""
    rng = np.random.default_rng(seed)
    floor = -(-sum(size) // cap)
    rated = lambda b: (fitness(b, size, cap), b)
    best = lambda pool: sorted(pool, key=lambda x: x[0], reverse=True)[:population]
    pool = [rated(g) for g in guests if g] or [rated(best_fit([], range(len(size)), size, cap))]
    while len(pool) < population:
        pool.append(rated(mutate(pool[0][1], size, cap, rng)))
    pool = best(pool)
    for _ in range(generations):
        if len(pool[0][1]) <= floor:
            break  # no packing has fewer bins
        a, b = rng.choice(len(pool), 2, replace=False).tolist()
        child = crossover(pool[min(a, b)][1], pool[max(a, b)][1], size, cap, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, cap, rng)
        pool = best([*pool, rated(child)])
    return pool[0][1]


def _bins(label) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(label):
        out.setdefault(k, []).append(i)
    return list(out.values())


# ------------------------------------------------------------- islands on Spark

def solve(items: DataFrame, cap: int = LENGTH, problem: int = PROBLEM, islands: int = ISLANDS, rounds: int = ROUNDS,
          population: int = POPULATION, generations: int = GENERATIONS, seed: int = 0) -> DataFrame:
    """``(uid, length)`` -> ``(uid, length, problem, bin, fill)`` with the best island of each problem."""
    n = items.count()
    problems = max(1, -(-n // problem))
    dealt = (items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(problems)).alias("problem"))
                  .groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("x")))
    dealt = written(dealt.select("problem", F.transform("x", lambda v: v["uid"]).alias("uids"),
                                 F.transform("x", lambda v: v["length"]).alias("sizes")), "problems")
    state = dealt.select("problem", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                         F.array().cast("array<array<int>>").alias("guests"))

    def run(batches, r):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for x in rows:
                bins = evolve(x["sizes"], [_bins(g) for g in x["guests"]], cap,
                              [seed, x["problem"], x["island"], r], population, generations)
                label = [0] * len(x["sizes"])
                for k, b in enumerate(bins):
                    for i in b:
                        label[i] = k
                out.append({"problem": x["problem"], "island": x["island"], "n_bins": len(bins),
                            "fit": fitness(bins, x["sizes"], cap)[1], "label": label})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("problem", pa.int64()), ("island", pa.int32()), ("n_bins", pa.int32()), ("fit", pa.float64()),
                 ("label", pa.list_(pa.int32()))]))
    best = None
    for r in range(rounds):
        # one row is one island's work: spread the rows over the tasks
        found = (state.select("problem", "island", "sizes", "guests")
                      .repartition(min(problems * islands, 100_000), "problem", "island")
                      .mapInArrow(lambda b, r=r: run(b, r),
                                  "problem long, island int, n_bins int, fit double, label array<int>"))
        found = best = written(found, "islands")
        if r + 1 < rounds:
            moved = found.withColumn("island", (F.col("island") + 1) % islands)
            guests = found.unionByName(moved).groupBy("problem", "island").agg(F.collect_list("label").alias("guests"))
            state = dealt.select("problem", "sizes").join(guests, "problem")
    top = best.groupBy("problem").agg(F.min_by("label", F.struct("n_bins", -F.col("fit"), "island")).alias("label"))
    rows = (dealt.join(top, "problem")
                 .select("problem", F.explode(F.arrays_zip("uids", "sizes", "label")).alias("x"))
                 .select("problem", F.col("x.uids").alias("uid"), F.col("x.sizes").alias("length"), F.col("x.label").alias("bin")))
    fills = rows.groupBy("problem", "bin").agg(F.sum("length").alias("fill"))
    return rows.join(fills, ["problem", "bin"])


def pack(docs: DataFrame, length: int = LENGTH, end: int = 0, path: str | None = None, problem: int = PROBLEM,
         islands: int = ISLANDS, rounds: int = ROUNDS, population: int = POPULATION,
         generations: int = GENERATIONS) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = written(pieces(docs, length, end, path), "pieces")
    how = dict(cap=length, problem=problem, islands=islands, rounds=rounds, population=population, generations=generations)
    first = written(solve(cut.filter(F.col("length") < length).select("uid", "length"), **how), "packed")
    tight = F.col("fill") >= F.lit(LOOSE * length)
    second = solve(first.filter(~tight).select("uid", "length"), seed=1, **how)
    bins = (first.filter(tight).withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))
                 .groupBy("level", "problem", "bin")
                 .agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("x")))
    # a bin holds at most ``length`` pieces
    offsets = F.transform("x", lambda v, i: F.struct(v["uid"].alias("uid"), F.aggregate(
        F.slice("x", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["length"]).alias("offset")))
    placed = (bins.select((F.shiftleft(F.col("level").cast("long"), 60) + F.shiftleft(F.col("problem"), 24)
                           + F.col("bin")).alias("sequence_id"), F.explode(offsets).alias("p"))
                  .select(F.col("p.uid").alias("uid"), "sequence_id", F.col("p.offset").alias("offset")))
    return (cut.join(placed, "uid", "left")
               .select("doc_id", "piece", "start", "length", "ids_crc32",
                       F.coalesce("sequence_id", "uid").alias("sequence_id"),
                       F.coalesce("offset", F.lit(0).cast("long")).alias("offset")))
