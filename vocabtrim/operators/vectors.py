"""Vectors in packed blocks, and exact searches over pairs of blocks.

A block is one row: the ids and the matrix of at most ``BLOCK_BYTES`` of vectors.  A
search deals the pairs of blocks to cells: a task holds a few blocks of the left and meets
those of the right one after another, and multiplies tiles, so only its answers (a best match a row, or spanning stars of the close points) leave it.  No
pair of points is ever a row, and no vector goes through the driver.

The work of a search is one product a pair of points, in matrix form.  Searches with a
bound multiply the first coordinates alone and take the others only where the norms of
what is left (Cauchy-Schwarz) let a pair still reach the bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
HELD = 8
"""Blocks of the left that a task may hold."""
LEAST_ROWS = 128
TILE = 512

BLOCK = "blk int, n int, ids binary, mat binary"
_BLOCK = pa.schema([("blk", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("mat", pa.binary())])


def block_count(rows: int, dim: int, tasks: int) -> int:
    """Blocks for ``rows`` vectors: small enough for a task, and enough of them that their
    pairs keep ``tasks`` tasks busy."""
    fit = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    return max(-(-rows // fit), min(math.isqrt(2 * tasks) + 1, -(-rows // LEAST_ROWS)), 1)


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def matrix(batch: pa.RecordBatch, col: str) -> np.ndarray:
    """The rows of a list column; missing values are 0."""
    v = batch.column(col)
    flat = v.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def packed(blk: int, ids: np.ndarray, mat: np.ndarray) -> dict:
    return {"blk": blk, "n": len(ids), "ids": ids.astype("<i8").tobytes(), "mat": np.ascontiguousarray(mat, "<f8").tobytes()}


def unpacked(ids: bytes, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(mat, "<f8").reshape(len(i), -1)


def pack(vecs: DataFrame, blocks: int, by=None, key: str = "token_id", col: str = "vec") -> DataFrame:
    """``(blk, n, ids, mat)`` of ``(key, col)``; block ``by`` (an expression), or the hash of
    the key.  Ids are in order within a block."""
    by = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int") if by is None else by
    rows = vecs.select(by.alias("blk"), F.col(key).cast("long").alias("id"), F.col(col).alias("v"))

    def run(batches):
        held: list = []

        def done():
            ids, mats = zip(*held)
            held.clear()
            return packed(now, np.concatenate(ids), np.concatenate(mats))
        now = None
        for batch in batches:
            out = []
            blk, ids, mat = batch.column("blk").to_numpy(), batch.column("id").to_numpy(), matrix(batch, "v")
            cut = np.concatenate(([0], np.flatnonzero(np.diff(blk)) + 1, [len(blk)])) if len(blk) else [0]
            for a, b in zip(cut[:-1], cut[1:]):
                if held and blk[a] != now:
                    out.append(done())
                now = int(blk[a])
                held.append((ids[a:b], mat[a:b]))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
        if held:
            yield pa.RecordBatch.from_pylist([done()], schema=_BLOCK)
    n = min(blocks, tasks_of(vecs)) if blocks > 1 else 1
    return rows.repartition(n, "blk").sortWithinPartitions("blk", "id").mapInArrow(run, BLOCK)


def strips(left: int, right: int, tasks: int, half: bool = False) -> tuple[int, int]:
    """Strips that the blocks of the left and of the right are cut into.  A cell is a pair of
    strips; each block goes once to every strip of the other side, so strips are as few as
    ``HELD`` blocks of the left and work for ``tasks`` tasks allow."""
    least = -(-left // HELD)
    if half:
        n = max(least, min(left, math.isqrt(2 * tasks)))
        return n, n
    n = max(least, min(left, math.isqrt(tasks) + 1))
    return n, min(right, -(-tasks // n))


def pairs(left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int, half: bool = False) -> DataFrame:
    """Every block of ``left`` beside every block of ``right`` (``half``: beside those of no
    smaller number, for a search of one set against itself), as rows of cells for :func:`each_pair`."""
    tasks = min(tasks_of(left), 2 * left.sparkSession.sparkContext.defaultParallelism)
    n, m = strips(left_blocks, right_blocks, tasks, half)
    row = F.floor(F.col("blk") * n / F.lit(left_blocks))
    col = F.floor(F.col("blk") * m / F.lit(right_blocks))
    cells = lambda df, side, cell: df.select(F.explode(cell).alias("cell"), F.lit(side).alias("side"), "blk", "ids", "mat")
    a = cells(left, 0, F.transform(F.sequence(row if half else F.lit(0).cast("long"), F.lit(m - 1).cast("long")), lambda c: row * m + c))
    b = cells(right, 1, F.transform(F.sequence(F.lit(0).cast("long"), col if half else F.lit(n - 1).cast("long")), lambda r: r * m + col))
    return a.unionByName(b).repartition(max(tasks_of(left), n * m), "cell").sortWithinPartitions("cell", "side", "blk")


def each_pair(batches, half: bool = False):
    """``(cell, l_blk, r_blk, left, right)`` of the rows of cells; a cell's right blocks come in order."""
    now, held = None, []
    for batch in batches:
        cell, side, blk = (batch.column(c).to_pylist() for c in ("cell", "side", "blk"))
        for i in range(batch.num_rows):
            if cell[i] != now:
                now, held = cell[i], []
            ids, mat = unpacked(batch.column("ids")[i].as_buffer(), batch.column("mat")[i].as_buffer())
            if side[i] == 0:
                held.append((blk[i], (ids.copy(), mat.copy())))
                continue
            for l_blk, block in held:
                if not half or l_blk <= blk[i]:
                    yield now, l_blk, blk[i], block, (ids, mat)


# ---------------------------------------------------------------- nearest centre

def nearest_rows(x: np.ndarray, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of the nearest row of ``mat`` for each row of ``x``.  Rows
    within rounding error of the best are compared by exact differences; ties go to the first."""
    place, dist = np.empty(len(x), np.int64), np.empty(len(x))
    cc = np.einsum("ij,ij->i", mat, mat)
    slack = 1e-9 * (1.0 + cc.max(initial=0.0))
    for s in range(0, len(x), 64):
        part = x[s:s + 64]
        d = np.einsum("ij,ij->i", part, part)[:, None] - 2.0 * (part @ mat.T) + cc[None, :]
        row, col = np.nonzero(d <= d.min(axis=1)[:, None] + slack)
        exact = np.square(part[row] - mat[col]).sum(axis=1)
        order = np.lexsort((col, exact, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        place[s:s + 64], dist[s:s + 64] = col[first], exact[first]
    return place, dist


# ---------------------------------------------------------------- nearest neighbour by cosine

def best_products(a_ids, a, b_ids, b):
    """Of each row of ``a`` the row of ``b`` with the greatest product, other than itself;
    ties go to the lowest id.  Returns ids (-1: none) and products."""
    best, value = np.full(len(a), -1, np.int64), np.full(len(a), -np.inf)
    for s in range(0, len(a), TILE):
        part = a[s:s + TILE]
        for z in range(0, len(b), 8 * TILE):
            p = part @ b[z:z + 8 * TILE].T
            p[a_ids[s:s + TILE, None] == b_ids[None, z:z + 8 * TILE]] = -np.inf
            # rows are in order of their ids, so the first of the greatest has the lowest
            k = p.argmax(axis=1)
            v = p[np.arange(len(part)), k]
            more = v > value[s:s + TILE]
            value[s:s + TILE] = np.where(more, v, value[s:s + TILE])
            best[s:s + TILE] = np.where(more, b_ids[z + k], best[s:s + TILE])
    best[np.isinf(value)] = -1
    return best, value


def neighbours(left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int) -> DataFrame:
    """``(id, other, product)``: for each vector of ``left`` the one of ``right``, other than
    itself, of the greatest inner product (ties: lowest id)."""
    def rows(best):
        for ids, other, product in best.values():
            some = other >= 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(other[some]), pa.array(product[some])],
                                             names=["id", "other", "product"])

    def run(batches):
        now, best = None, {}
        for cell, blk, _, (a_ids, a), (b_ids, b) in each_pair(batches):
            if cell != now:
                yield from rows(best)
                now, best = cell, {}
            other, value = best_products(a_ids, a, b_ids, b)
            if blk in best:
                _, o, v = best[blk]
                more = (other >= 0) & ((value > v) | ((value == v) & (other < o)))
                other, value = np.where(more, other, o), np.where(more, value, v)
            best[blk] = (a_ids, other, value)
        yield from rows(best)
    found = pairs(left, right, left_blocks, right_blocks).mapInArrow(run, "id long, other long, product double")
    return (found.groupBy("id").agg(F.max_by(F.struct("other", "product"), F.struct("product", -F.col("other"))).alias("b"))
                 .select("id", "b.other", "b.product"))


# ---------------------------------------------------------------- close points

def close_pairs(a: np.ndarray, b: np.ndarray, least: float, seen: list | None = None):
    """Rows ``(i, j)`` of unit vectors with product ``>= least``: the first coordinates, then
    the others where the norms of the rest allow it.  ``seen`` collects [pairs, pairs taken whole]."""
    dim = a.shape[1]
    head = max(1, (3 * dim) // 4)
    rest_a, rest_b = (np.sqrt(np.einsum("ij,ij->i", x[:, head:], x[:, head:])) for x in (a, b))
    out_i, out_j = [], []
    for s in range(0, len(a), TILE):
        part = a[s:s + TILE, :head] @ b[:, :head].T
        i, j = np.nonzero(part + rest_a[s:s + TILE, None] * rest_b[None, :] >= least - 1e-9)
        if seen is not None:
            seen[0] += part.size
            seen[1] += len(i)
        for z in range(0, len(i), 1 << 18):
            x, y = i[z:z + (1 << 18)] + s, j[z:z + (1 << 18)]
            ok = np.einsum("ij,ij->i", a[x], b[y]) >= least
            out_i.append(x[ok])
            out_j.append(y[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def stars(a: np.ndarray, b: np.ndarray):
    """Each point of the pairs with the least id it is connected to."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(ids))
    return ids[root[far]], ids[far]


def close_stars(blocks: DataFrame, n_blocks: int, least: float, forest: bool = True) -> DataFrame:
    """Pairs ``(a, b)``, a < b, that connect exactly the unit vectors connected by products of
    at least ``least``: of each pair of blocks spanning stars, at most one row a point.
    Without ``forest`` all such pairs."""
    def run(batches):
        for _, la, lb, (a_ids, a), (b_ids, b) in each_pair(batches, half=True):
            i, j = close_pairs(a, b, least)
            if la == lb:
                i, j = i[i < j], j[i < j]
            x, y = a_ids[i], b_ids[j]
            x, y = stars(x, y) if forest else (np.minimum(x, y), np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
    return pairs(blocks, blocks, n_blocks, n_blocks, half=True).mapInArrow(run, "a long, b long").distinct()
