"""Prefix trie of conversations, screened by a count-min sketch.

A node is a distinct sequence of first turns; its members are the conversations that
begin with it.

1. One streaming pass over the sorted turns chains a 128-bit digest a prefix; a
   conversation becomes one row of digests, its texts are not kept.
2. The digests are counted in a count-min sketch of saturating counters.  Its size
   follows the number of prefixes up to ``MAX_CELLS``; beyond that it proves fewer
   prefixes single, with the same results.  It never counts too low, so an estimate of
   one proves that a prefix, and so every longer one, belongs to one conversation.
3. Such a tail is emitted where it lies.  Only prefixes that may be shared are shuffled
   and grouped exactly, after partial aggregation.
4. Subtree sums need no rounds over depths.  The smallest member owns a node, and the
   nodes that a conversation owns are the last of its path; each owner adds the sums of
   what it owns to all nodes of its path.  A conversation hangs from its parent by one
   look-up; parents with many members (at most ``HOT`` of them can have a share of
   1 / HOT of all prefixes) are broadcast, the others joined.
5. The ids that end at a node are sorted by range, packed into text, and hashed in order.

Edge cases: rows without ``conv_id`` belong to no conversation and are left out; equal
turn numbers go by role, then text; null roles and texts are empty; a conversation
without turns is a member of the root alone; an empty table has no nodes, not even the
root; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, need, parts, written

ROWS = 3
"""Rows of the sketch."""
MAX_CELLS = 1 << 24
"""Most counters a row, two bits each: the broadcast sketch holds at most 12 MB."""
STRIPE = 1 << 16
HOT = 10_000
PACK = 4096
SIZE = 16
ROOT = bytes(SIZE)

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
NOBODY = hashlib.sha256(b"").hexdigest()
PATHS = "conv_id long, n int, digests binary, tokens array<int>"


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """``(conv_id, part, turn, role, text)`` of conversations rebuilt on a common start: the
    first h turns of conversation c - c % group, then c's own turns after its first h,
    with h = crc32(decimal c) % heads.  Every conversation has a row of part -1."""
    own = (need(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
           .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text")))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    own = own.withColumn("nth", nth)
    # F.crc32 is unsigned
    h = lambda c: F.crc32(c.cast("string")) % heads
    rest = own.filter(F.col("nth") > h(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "nth", "role", "text")
    ids = own.select("conv_id").distinct()
    wants = ids.withColumn("h", h(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    start = own.filter((F.col("conv_id") % group == 0) & (F.col("nth") < heads)).withColumnRenamed("conv_id", "base")
    # at most `group` conversations ask for one start of fewer than `heads` turns
    first = (wants.filter("h > 0").join(start, "base").filter("nth <= h")
                  .select("conv_id", F.lit(0).alias("part"), "nth", "role", "text"))
    none = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("nth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return none.unionByName(first).unionByName(rest).withColumnRenamed("nth", "turn")


def paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, n, digests, tokens)``: digests of all n + 1 prefixes, the root's first,
    and the words of the last text of each."""
    def run(batches):
        def done():
            return {"conv_id": conv, "n": len(tokens) - 1, "digests": b"".join(digests), "tokens": tokens}
        schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int32()), ("digests", pa.binary()),
                            ("tokens", pa.list_(pa.int32()))])
        conv, digests, tokens = None, [], []
        for batch in batches:
            out = []
            for c, part, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "role", "text"))):
                if c != conv:
                    if conv is not None:
                        out.append(done())
                    conv, digests, tokens = c, [ROOT], [0]
                if part >= 0:
                    r, t = role.encode(), text.encode()
                    d = hashlib.blake2b(digests[-1], digest_size=SIZE)
                    d.update(len(r).to_bytes(8, "little"))
                    d.update(r)
                    d.update(t)
                    digests.append(d.digest())
                    tokens.append(len(WORD(text)))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if conv is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)
    n = parts(turns.sparkSession)
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "turn")
    return ordered.select("conv_id", "part", "role", "text").mapInArrow(run, PATHS)


# ---------------------------------------------------------------- sketch

def _cells(digests: bytes, width: int) -> np.ndarray:
    """Cells of each prefix, one column a row of the sketch (``width`` cells a row)."""
    half = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return np.stack([mix(half[:, 0] + np.uint64(r) * half[:, 1]) % np.uint64(width) + np.uint64(r * width)
                     for r in range(ROWS)], axis=1).astype(np.int64)


def _pack(counts: np.ndarray) -> np.ndarray:
    """Four two-bit counters a byte."""
    c = counts.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8)


def sketch(table: DataFrame, width: int) -> np.ndarray:
    """Count-min counters, saturating at two and packed, of all prefixes but the root.

    Tasks count by stripe of ``STRIPE`` cells, stripes are added up in parallel, and the
    driver receives ``ROWS * width / 4`` bytes at most, whatever the input."""
    def count(batches):
        for batch in batches:
            at = [_cells(d[SIZE:], width).ravel() for d in batch.column("digests").to_pylist() if len(d) > SIZE]
            cell, c = np.unique(np.concatenate(at), return_counts=True) if at else (np.zeros(0, np.int64),) * 2
            stripe = cell // STRIPE
            cut = np.concatenate(([0], np.flatnonzero(np.diff(stripe)) + 1, [len(cell)])) if len(cell) else [0]
            yield pa.RecordBatch.from_pylist(
                [{"stripe": int(stripe[a]), "cells": (cell[a:b] % STRIPE).astype("<u2").tobytes(),
                  "counts": np.minimum(c[a:b], 2).astype(np.uint8).tobytes()} for a, b in zip(cut[:-1], cut[1:])],
                schema=pa.schema([("stripe", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())]))

    def add(batches):
        schema = pa.schema([("stripe", pa.int64()), ("packed", pa.binary())])
        row = lambda: {"stripe": stripe, "packed": _pack(counts).tobytes()}
        stripe = counts = None
        for batch in batches:
            out = []
            for s, cells, c in zip(*(batch.column(x).to_pylist() for x in ("stripe", "cells", "counts"))):
                if s != stripe:
                    if stripe is not None:
                        out.append(row())
                    stripe, counts = s, np.zeros(STRIPE, np.uint8)
                i = np.frombuffer(cells, "<u2")
                counts[i] = np.minimum(counts[i] + np.frombuffer(c, np.uint8), 2)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if stripe is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)
    stripes = ROWS * width // STRIPE
    found = (table.select("digests").mapInArrow(count, "stripe long, cells binary, counts binary")
                  .repartition(min(stripes, parts(table.sparkSession)), "stripe").sortWithinPartitions("stripe")
                  .mapInArrow(add, "stripe long, packed binary"))
    out = np.zeros(ROWS * width // 4, np.uint8)
    for r in found.collect():
        out[r["stripe"] * STRIPE // 4:(r["stripe"] + 1) * STRIPE // 4] = np.frombuffer(r["packed"], np.uint8)
    return out


def screened(table: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """``table`` with ``single``: the smallest depth whose prefix is proved to belong to
    this conversation alone (n + 1 if none is)."""
    total = table.agg(F.sum("n")).first()[0] or 0
    width = STRIPE
    while width < min(8 * total, max_cells):
        width *= 2
    shared = table.sparkSession.sparkContext.broadcast(sketch(table, width))

    def run(batches):
        packed = shared.value
        for batch in batches:
            single = []
            for n, d in zip(batch.column("n").to_pylist(), batch.column("digests").to_pylist()):
                cells = _cells(d[SIZE:], width)
                least = ((packed[cells >> 2] >> ((cells & 3) << 1).astype(np.uint8)) & 3).min(axis=1, initial=3)
                one = np.flatnonzero(least == 1)
                single.append(int(one[0]) + 1 if len(one) else n + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single, pa.int32())],
                                             names=[*batch.schema.names, "single"])
    return table.select("conv_id", "n", "digests", "tokens").mapInArrow(run, PATHS + ", single int")


# ---------------------------------------------------------------- nodes

def _digest(depth: Column) -> Column:
    return F.substring(F.col("digests"), depth * SIZE + 1, F.lit(SIZE))


def _ends(shared: DataFrame) -> DataFrame:
    """``(digest, ends_sha256)`` of the ids ending at each node, in ascending order.

    Ids are sorted by range, so those of a hot node lie in many partitions; each packs
    them into text, and only the texts pass, in order, through one hash."""
    def pack(batches):
        schema = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            out, held, node = [], [], None
            for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (d != node or len(held) == PACK):
                    out.append({"digest": node, "first": held[0], "ids": ",".join(map(str, held)).encode()})
                    held = []
                node = d
                held.append(c)
            if held:
                out.append({"digest": node, "first": held[0], "ids": ",".join(map(str, held)).encode()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def digest(batches):
        schema = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
        node = state = None
        for batch in batches:
            out = []
            for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if d != node:
                    if node is not None:
                        out.append({"digest": node, "ends_sha256": state.hexdigest()})
                    node, state = d, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"digest": node, "ends_sha256": state.hexdigest()}], schema=schema)
    n = parts(shared.sparkSession)
    ends = shared.filter("ends").select("digest", "conv_id")
    packed = (ends.repartitionByRange(n, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
                  .mapInArrow(pack, "digest binary, first long, ids binary"))
    return (packed.repartition(n, "digest").sortWithinPartitions("digest", "first").select("digest", "ids")
                  .mapInArrow(digest, "digest binary, ends_sha256 string"))


def _owned(owners: DataFrame) -> DataFrame:
    """What each owner adds to every shared node of its path: ``(digest, saved, leaf)``."""
    def run(batches):
        schema = pa.schema([("digest", pa.binary()), ("saved", pa.int64()), ("leaf", pa.int64())])
        for batch in batches:
            digests, saved, leaves = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("last", "digests", "top", "weights", "leaf")]
            for last, path, top, weights, leaf in zip(*cols):
                own = np.zeros(last + 2, np.int64)
                for w in weights or ():
                    own[w["depth"]] = w["weight"]
                below = np.cumsum(own[::-1])[::-1]
                below[:min(top, last + 1)] = below[min(top, last + 1)]
                digests += [path[SIZE * d:SIZE * (d + 1)] for d in range(last + 1)]
                saved += below[:last + 1].tolist()
                leaves += [int(leaf)] * (last + 1)
            yield pa.RecordBatch.from_pydict({"digest": digests, "saved": saved, "leaf": leaves}, schema=schema)
    return (owners.select("last", "digests", "top", "weights", "leaf")
                  .mapInArrow(run, "digest binary, saved long, leaf long"))


def trie(turns: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row a node of the trie of ``turns`` ``(conv_id, part, turn, role, text)``, ordered
    by part and turn, with a row of part -1 for each conversation.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    table = written(paths(turns), "trie-paths")
    table = written(screened(table, max_cells), "trie-screened")
    # the depths that may be shared: 0 .. last
    table = table.withColumn("last", F.least("n", F.col("single") - 1))
    tail = F.col("single") <= F.col("n")

    d = F.col("depth")
    shared = (table.select("conv_id", "n", "last", "digests", "tokens", tail.alias("tail"),
                           F.explode(F.sequence(F.lit(0), "last")).alias("depth"))
                   .select("conv_id", "depth", _digest(d).alias("digest"),
                           F.when(d > 0, _digest(d - 1)).alias("parent"), F.col("tokens")[d].alias("tokens"),
                           (F.col("tail") & (d == F.col("last"))).alias("tail"), (d == F.col("n")).alias("ends")))
    groups = written(shared.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.min("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("tail").cast("long")).alias("tails"), F.max("ends").alias("ends")), "trie-groups")
    children = groups.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("c"))
    nodes = written(groups.join(children, "digest", "left")
                          .withColumn("n_children", F.col("tails") + F.coalesce("c", F.lit(0)))
                          .withColumn("weight", (F.col("n_convs") - 1) * F.col("tokens"))
                          .drop("c", "tails", "tokens"), "trie-nodes")

    mine = nodes.groupBy("conv_id").agg(F.min("depth").alias("own"), F.max(F.col("n_children") == 0).alias("childless"),
                                        F.collect_list(F.struct("depth", "weight")).alias("weights"))
    owners = written(
        table.join(mine, "conv_id", "left").filter(F.col("own").isNotNull() | tail)
             .select("conv_id", "n", "single", "last", "digests", "weights",
                     F.coalesce("own", "single").alias("top"),
                     (tail | F.coalesce("childless", F.lit(False))).alias("leaf")), "trie-owners")
    sums = _owned(owners).groupBy("digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    # where each owner hangs: its first own node under somebody else's
    hangs = owners.filter("top > 0").select("conv_id", "top", _digest(F.col("top") - 1).alias("digest"))
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    least = max(1, -(-total // HOT))
    name = nodes.select("digest", F.col("conv_id").alias("parent_conv_id"), "n_convs")
    hot = F.broadcast(name.filter(F.col("n_convs") >= least).select("digest", F.col("parent_conv_id").alias("hot")))
    found = hangs.join(hot, "digest", "left")
    cold = (found.filter("hot is null").drop("hot")
                 .join(name.filter(F.col("n_convs") < least).drop("n_convs"), "digest"))
    parent = written(found.filter("hot is not null").select("conv_id", "top", F.col("hot").alias("parent_conv_id"))
                     .unionByName(cold.select("conv_id", "top", "parent_conv_id")), "trie-parents")

    top = parent.withColumnRenamed("top", "depth")
    exact = (nodes.join(sums, "digest").join(_ends(shared), "digest", "left")
                  .join(top, ["conv_id", "depth"], "left")
                  .select("conv_id", "depth", F.when(d == 0, None).otherwise(F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
                          "n_convs", "n_children", "n_leaves", "saved_tokens",
                          F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256")))
    # a tail's first node hangs as its conversation does, or from a shared node of its own
    heads = (table.filter(tail).select("conv_id", F.col("single").alias("depth"), "n")
                  .join(top, ["conv_id", "depth"], "left")
                  .select("conv_id", "depth", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), "n"))
    rest = (table.filter(F.col("single") < F.col("n"))
                 .select("conv_id", F.explode(F.sequence(F.col("single") + 1, "n")).alias("depth"),
                         F.col("conv_id").alias("parent_conv_id"), "n"))
    at_end = d == F.col("n")
    alone = heads.unionByName(rest).select(
        "conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"),
        F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(at_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOBODY).alias("ends_sha256"))
    return exact.unionByName(alone).withColumn("depth", d.cast("long"))
