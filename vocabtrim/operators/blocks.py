"""Lookups of whole arrays by blocks of rows.

A block holds the arrays of some rows as codes, each the place of an element among the
distinct elements of the block, and the other columns of the rows as lists.

1. Each task cuts its rows into blocks of about ``ELEMENTS`` elements and writes a row of codes,
   in a bucketed table, and a row of distinct elements for each hash bucket of the lookup table.
2. The distinct elements meet the lookup table by hash bucket: explode, equi-join.
3. What they found goes back to the block, which lies in its bucket already, and the arrays
   are rebuilt by place.

So an element that a block has a thousand times is asked once, and neither the elements nor
the columns beside them are rows of a shuffle.  Rows of the same keys are put together at the
end; only these rows are shuffled.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .ordering import stored

ELEMENTS = 1 << 21
"""Array elements of a block (a longer array is a block alone)."""
RUN = 1 << 18
"""Elements of the pieces that blocks are made from and taken apart in."""
BUCKET_ROWS = 1 << 18
"""Rows of the lookup table in a hash bucket, about: what a task holds of it."""

BATCH_BYTES = 16 << 20
"""Bytes of rows that a task is handed at a time to make blocks of."""

_ASKED = "_blk long, _bucket int, _n int, _data binary"


@contextmanager
def _small_batches(spark):
    """Arrow batches by bytes, for the job run inside: by rows alone, ten thousand long texts would be one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(min(BATCH_BYTES, int(old)) if old and old.isdigit() else BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, old) if old is not None else spark.conf.unset(name)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress better than words."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _values(raw: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T.copy().view(kind).ravel()


def _squeeze(raw: bytes) -> bytes:
    """Compressed bytes behind their size."""
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True) if raw else b"")


def _expand(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def _plain(keys: pa.Array) -> pa.Array:
    """Keys as binary or as 64-bit numbers."""
    return keys.cast(pa.int64()) if pa.types.is_integer(keys.type) else keys.cast(pa.binary())


def _pack_keys(keys: pa.Array) -> bytes:
    if pa.types.is_integer(keys.type):
        return _planes(keys.to_numpy(zero_copy_only=False).astype("<i8"))
    ends = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, 4 * keys.offset)
    raw = (keys.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[ends[0]:ends[-1]]
    return _planes(np.diff(ends).astype("<i4")) + raw


def _unpack_keys(raw: bytes, n: int, text: bool) -> pa.Array:
    if not text:
        return pa.array(_values(raw, "<i8", n))
    ends = np.concatenate(([0], np.cumsum(_values(raw, "<i4", n)))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[4 * n:])])


def _bucket_of(keys: pa.Array, buckets: int) -> np.ndarray:
    from pandas.util import hash_array
    values = keys.to_numpy(zero_copy_only=False)
    if not pa.types.is_integer(keys.type):
        # hashed as texts: bytes that are no text (a lone surrogate) keep them apart all the same
        values = np.array([v.decode("utf-8", "backslashreplace") for v in values], object)
    return (hash_array(values, categorize=False) % np.uint64(buckets)).astype(np.int32) if len(keys) else np.zeros(0, np.int32)


def _cuts(sorted_values: np.ndarray):
    """``(first, last)`` of the runs of equal values."""
    if len(sorted_values):
        cut = np.concatenate(([0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)])).tolist()
        yield from zip(cut[:-1], cut[1:])


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _coded(df: DataFrame, col: str, buckets: int, elements: int) -> DataFrame:
    """The blocks of ``df``: rows of codes (``_bucket`` -1) and rows of distinct elements."""
    others = [c for c in df.columns if c != col]
    schema = T._parse_datatype_string(_ASKED).add("_sizes", T.BinaryType())
    for c in others:
        schema = schema.add(c, T.ArrayType(df.schema[c].dataType))
    step = max(1, min(RUN, elements))

    def pieces(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(ends):
                begin = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, begin + step, "right")))
                piece = batch.slice(a, b - a)
                # distinct elements and places: the elements themselves are not held
                enc = _plain(piece.column(col).flatten()).dictionary_encode()
                yield (enc.dictionary, pc.fill_null(enc.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32),
                       np.diff(ends[a:b], prepend=begin).astype("<i4"), [piece.column(c) for c in others])
                a = b

    def block(held, blk):
        whole = pa.concat_arrays([d for d, *_ in held]).dictionary_encode()
        table, place = whole.dictionary, whole.indices.to_numpy(zero_copy_only=False)
        codes, at = [], 0
        for d, c, *_ in held:
            codes.append(np.append(place[at:at + len(d)], len(table)).astype(np.int32)[c])
            at += len(d)
        codes = np.concatenate(codes)
        # frequent elements get small numbers; a null has the last
        ranked = np.argsort(-np.bincount(codes, minlength=len(table) + 1)[:len(table)], kind="stable")
        number = np.empty(len(table) + 1, "<i4")
        number[ranked], number[-1] = np.arange(len(table)), len(table)
        bucket = _bucket_of(table, buckets)[ranked].astype("<i4")
        order = np.argsort(bucket, kind="stable")
        table, sorted_bucket = table.take(pa.array(ranked[order])), bucket[order]
        cut = list(_cuts(sorted_bucket))
        data = [_squeeze(_planes(bucket) + _planes(number[codes]))]
        data += [_squeeze(_pack_keys(table.slice(a, b - a))) for a, b in cut]
        m = len(data)
        cols = [pa.array(np.full(m, blk), pa.int64()), pa.array([-1, *(int(sorted_bucket[a]) for a, _ in cut)], pa.int32()),
                pa.array([len(table), *(b - a for a, b in cut)], pa.int32()), pa.array(data, pa.binary()),
                pa.array([_squeeze(_planes(np.concatenate([s for _, _, s, _ in held]))), *[None] * (m - 1)], pa.binary())]
        for k in range(len(others)):
            one = _one_list(pa.concat_arrays([o[k] for *_, o in held]))
            cols.append(pa.concat_arrays([one, pa.nulls(m - 1, one.type)]))
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches):
        blk, held, n = TaskContext.get().partitionId() << 32, [], 0
        for piece in pieces(batches):
            if held and n + len(piece[1]) > elements:
                yield block(held, blk)
                blk, held, n = blk + 1, [], 0
            held.append(piece)
            n += len(piece[1])
        if held:
            yield block(held, blk)
    return df.select(col, *others).mapInArrow(run, schema)


def _packed_table(lookup: DataFrame, buckets: int, unk: int) -> DataFrame:
    """Rows of the lookup table ``(_k, _v)`` by hash bucket (``_blk`` -1)."""
    def rows(held):
        keys = pa.concat_arrays([k for k, _ in held])
        values = np.concatenate([v for _, v in held])
        bucket = _bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, values, bucket = keys.take(pa.array(order)), values[order], bucket[order]
        cut = list(_cuts(bucket))
        m = len(cut)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, -1), pa.int64()), pa.array([int(bucket[a]) for a, _ in cut], pa.int32()),
             pa.array([b - a for a, b in cut], pa.int32()),
             pa.array([_squeeze(_planes(values[a:b]) + _pack_keys(keys.slice(a, b - a))) for a, b in cut], pa.binary())],
            names=["_blk", "_bucket", "_n", "_data"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((_plain(batch.column("_k")), pc.fill_null(batch.column("_v"), unk).to_numpy(zero_copy_only=False).astype("<i4")))
            n += batch.num_rows
            if n >= BUCKET_ROWS:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)
    given = lookup.filter(F.col("_k").isNotNull()).select("_k", F.col("_v").cast("int").alias("_v"))
    return given.mapInArrow(run, _ASKED)


def _answers(rows: DataFrame, text: bool, unk: int) -> DataFrame:
    """Rows of distinct elements, which come behind those of the table of their bucket, with what they found: a
    number of values for each and the values, in order; an element that the table does not have gets ``unk``."""
    def answered(asked, keys, first, many, values):
        at = pc.fill_null(pc.index_in(pa.concat_arrays([k for *_, k in asked]), value_set=keys), len(keys)).to_numpy(zero_copy_only=False)
        size, begin = many[at], first[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = values[np.repeat(begin - ends[:-1], size) + np.arange(int(ends[-1]))]
        a, out = 0, []
        for _, _, n, _ in asked:
            out.append(_squeeze(_planes(size[a:a + n]) + _planes(flat[ends[a]:ends[a + n]])))
            a += n
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in asked], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))] + [pa.array(out, pa.binary())],
            names=["_blk", "_bucket", "_n", "_data"])

    def table(given):
        """Distinct keys, the first value and the number of values of each; the last place is that of ``unk``."""
        enc = (pa.concat_arrays([k for k, _ in given]) if given else pa.array([], pa.binary() if text else pa.int64())).dictionary_encode()
        at = enc.indices.to_numpy(zero_copy_only=False)
        values = np.concatenate([np.zeros(0, "<i4"), *(v for _, v in given)])
        values = values[np.lexsort((values, at))]
        many = np.append(np.bincount(at, minlength=len(enc.dictionary)), 1).astype("<i4")
        return enc.dictionary, np.cumsum(many) - many, many, np.append(values, unk).astype("<i4")

    def run(batches):
        now, given, held, asked, n = None, [], None, [], 0
        for batch in batches:
            for blk, bucket, size, data in zip(*(batch.column(c).to_pylist() for c in ("_blk", "_bucket", "_n", "_data"))):
                if bucket != now:
                    if asked:
                        yield answered(asked, *held)
                    now, given, held, asked, n = bucket, [], None, [], 0
                raw = _expand(data)
                if blk < 0:
                    given.append((_unpack_keys(raw[4 * size:], size, text), _values(raw, "<i4", size)))
                    continue
                if held is None:
                    held, given = table(given), []
                asked.append((blk, bucket, size, _unpack_keys(raw, size, text)))
                n += size
                # many blocks ask at once: the table is gone through once for as many elements as it has
                if n >= max(BUCKET_ROWS, len(held[0])):
                    yield answered(asked, *held)
                    asked, n = [], 0
        if asked:
            yield answered(asked, *held)
    return rows.mapInArrow(run, _ASKED)


def _rebuilt(blocks: DataFrame, schema: T.StructType, col: str, unk: int, again: bool) -> DataFrame:
    """Rows of the blocks with their arrays rewritten: those that stand alone, or those that come ``again``, with
    the places of the elements in ``_pos``."""
    others = [c for c in schema.names if c != col]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: E731, B023
                n = get("_n").as_py()
                sizes, values = [np.zeros(0, "<i4")], [np.zeros(0, "<i4")]
                for part in sorted(get("_found").as_py() or (), key=lambda p: p["_bucket"]):
                    raw = _expand(part["_data"])
                    sizes.append(_values(raw, "<i4", part["_n"]))
                    values.append(_values(raw, "<i4", len(raw) // 4 - part["_n"], 4 * part["_n"]))
                sizes, values = np.concatenate(sizes), np.append(np.concatenate(values), unk).astype(np.int32)
                raw = _expand(get("_data").as_py())
                order = np.argsort(_values(raw, "<i4", n), kind="stable")
                codes = _values(raw, "<i4", len(raw) // 4 - n, 4 * n)
                # the last place is that of a null
                many, begin = np.ones(n + 1, np.int64), np.full(n + 1, len(values) - 1)
                many[order], begin[order] = sizes, np.cumsum(sizes) - sizes
                raw = _expand(get("_sizes").as_py())
                cut = np.concatenate(([0], np.cumsum(_values(raw, "<i4", len(raw) // 4), dtype=np.int64)))
                wanted = np.full(len(cut) - 1, not again)
                if get("_rows").is_valid:
                    wanted[get("_rows").values.to_numpy(zero_copy_only=False)] = again
                lists = [get(c).values for c in others]
                first = 0
                while first < len(wanted):
                    last = max(first + 1, int(np.searchsorted(cut, cut[first] + RUN, "right")) - 1)
                    mine = codes[cut[first]:cut[last]]
                    size = many[mine]
                    ends = np.concatenate(([0], np.cumsum(size)))
                    if len(mine) == ends[-1]:
                        flat = values[begin[mine]]
                    else:
                        flat = values[np.repeat(begin[mine] - ends[:-1], size) + np.arange(int(ends[-1]))]
                    arrays = pa.ListArray.from_arrays(pa.array(ends[cut[first:last + 1] - cut[first]].astype(np.int32)), pa.array(flat))
                    out = pa.RecordBatch.from_arrays([*(x.slice(first, last - first) for x in lists), arrays], names=[*others, col])
                    if again:
                        length = np.diff(cut[first:last + 1])
                        pos = np.arange(len(mine)) - np.repeat(cut[first:last] - cut[first], length)
                        out = out.append_column("_pos", pa.ListArray.from_arrays(arrays.offsets, pa.array(np.repeat(pos, size).astype(np.int32))))
                    some = wanted[first:last]
                    yield out if some.all() else out.filter(pa.array(some))
                    first = last
    places = [T.StructField("_pos", T.ArrayType(T.IntegerType()))] if again else []
    return blocks.mapInArrow(run, T.StructType([*schema.fields, *places]))


def looked_up(df: DataFrame, col: str, lookup: DataFrame, table_rows: int, keys, unk: int = 0,
              elements: int = ELEMENTS) -> DataFrame:
    """``df`` with every element of the array ``col`` replaced by its value in ``lookup (_k, _v)``, which
    has about ``table_rows`` rows.  An element without an entry becomes ``unk``, one with several
    all their values, in order; a null array an empty one.  Rows of the same ``keys`` become one row, whose
    elements are in order of their places; its other columns are those of the first of them."""
    spark, others = df.sparkSession, [c for c in df.columns if c != col]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-table_rows // BUCKET_ROWS))
    # bucketed by block: the join of the answers then moves the answers alone
    name = f"lookup_blocks_{uuid.uuid4().hex}"
    with _small_batches(spark):
        (_coded(df, col, buckets, elements).write.option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
            .option("compression", "uncompressed").bucketBy(tasks, "_blk").saveAsTable(name))
    packed = spark.table(name)
    asked = packed.filter("_bucket >= 0").select("_blk", "_bucket", "_n", "_data")
    together = (asked.unionByName(_packed_table(lookup, buckets, unk)).repartition(min(buckets, 100_000), "_bucket")
                .sortWithinPartitions("_bucket", "_blk"))
    text = isinstance(df.schema[col].dataType.elementType, T.StringType)
    found = (_answers(together, text, unk).repartition(tasks, "_blk").groupBy("_blk")
             .agg(F.collect_list(F.struct("_bucket", "_n", "_data")).alias("_found")))
    codes = packed.filter("_bucket = -1")
    names = codes.select("_blk", F.posexplode(F.arrays_zip(*[F.col(f"`{k}`") for k in keys])).alias("_row", "_key")) \
                 .select("_blk", "_row", *[F.col("_key").getField(k).alias(k) for k in keys])
    several = stored(names.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").drop("_many"), "repeated-keys")
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in others] + [T.StructField(col, T.ArrayType(T.IntegerType()))])
    blocks = codes.select("_blk", "_n", "_data", "_sizes", *others).join(found.hint("merge"), "_blk", "left")
    if several.isEmpty():
        alone = blocks.withColumn("_rows", F.lit(None).cast("array<int>"))
        return _rebuilt(alone, schema, col, unk, False).select(*df.columns)
    same = F.lit(True)
    for k in keys:
        same = same & names[k].eqNullSafe(several[k])
    rows = names.join(several, same, "left_semi").groupBy("_blk").agg(F.collect_list("_row").alias("_rows"))
    alone = _rebuilt(blocks.join(rows.hint("merge"), "_blk", "left"), schema, col, unk, False)
    again = _rebuilt(blocks.join(rows.hint("merge"), "_blk"), schema, col, unk, True)
    cells = F.collect_list(F.arrays_zip(F.col("_pos"), F.col(f"`{col}`").alias("_v")))
    again = again.groupBy(*keys).agg(F.array_sort(F.flatten(cells)).alias("_a"), *[F.first(c).alias(c) for c in others if c not in keys])
    again = again.withColumn(col, F.transform("_a", lambda s: s["_v"]))
    return alone.select(*df.columns).unionByName(again.select(*df.columns))
