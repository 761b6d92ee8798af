"""SentencePiece ids through a table of distinct chunks.

No piece of the model crosses from a letter to a white-space marker, so a text is a
sequence of chunks, each some markers with what follows them up to the next marker, and
its ids are the ids of its chunks in order (:func:`check_model` proves this of a model
before it is used).

1. Each task cuts its texts into blocks of bounded bytes.  A block keeps its distinct
   chunks once, and its documents as positions in that list; it is written as one row
   of positions, in a bucketed table, and one row of chunks a segment bucket.
2. The chunk rows are shuffled by segment bucket: all blocks' copies of one chunk meet,
   and it is segmented once, by the library.
3. The ids go back to their block, which lies in its bucket already, and are joined to
   the documents by position.  Texts and positions are never shuffled.

A frequent chunk comes once a block, not once an occurrence, so no key of a shuffle
holds more rows than there are blocks.

Edge cases: null and empty texts have no ids; ids and texts of repeated rows come back
repeated; null keys are kept; other columns are not read, so their names cannot clash;
one text longer than a block is a block alone; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, chunks, need, parts

BLOCK_BYTES = 16 << 20
SEGMENT_BYTES = 64 << 20
"""Text bytes a segment bucket, which sets the number of buckets: its distinct chunks are
what a task holds in its table."""
RUN = 1 << 18
"""Chunks whose ids are put together, or ids that are decoded, at a time, or those of one longer text."""

MARK = "▁"
PACKED = ("block long, bucket int, keys array<long>, counts array<int>, n int, data binary")
_PACKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.list_(pa.int64())),
                     ("counts", pa.list_(pa.int32())), ("n", pa.int32()), ("data", pa.binary())])


def processor(model_path: str):
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=model_path)


def check_model(model_path: str) -> None:
    """Raise unless chunks can be segmented apart: markers only begin pieces, a text gets
    one marker in front, and neither it nor its white space is normalised."""
    sp = processor(model_path)
    inner = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    samples = ["a", " a", "a ", "  a  b", "Åﬁ 　Ω", "\t\n"]
    if inner or any(sp.decode(sp.encode(s)) != s for s in samples):
        raise ValueError(f"pieces of {model_path} may cross white-space markers")


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as byte planes, which compress better than words."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _squeeze(raw: bytes) -> bytes:
    """Compressed bytes behind their size."""
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True) if raw else b"")


def _expand(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts with a marker (a space) in front, other markers as spaces; empty ones stay empty."""
    text = batch.column("text").cast(pa.large_string()).fill_null("")
    text = pc.replace_substring(text, MARK, " ")
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    text = pc.if_else(pc.equal(text, none), none, pc.binary_join_element_wise(space, text, none))
    return pa.RecordBatch.from_arrays([batch.column("key"), text], names=["key", "text"])


def _buckets(table: pa.Array, roller: Roller, buckets: int) -> np.ndarray:
    """Segment bucket of each chunk, by its hash."""
    out = np.zeros(len(table), np.int32)
    if len(table) == 0:
        return out
    ends = np.frombuffer(table.buffers()[1], np.int32, len(table) + 1).astype(np.int64)
    raw = np.frombuffer(table.buffers()[2], np.uint8)
    for a in range(0, len(table), 1 << 16):
        e = ends[a:a + (1 << 16) + 1]
        prefix = roller.prefix(raw[e[0]:e[-1]])
        out[a:a + len(e) - 1] = roller.spans(prefix, e[:-1] - e[0], e[1:] - e[0]) % np.uint64(buckets)
    return out


def _blocks(docs: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    """Packed blocks of ``(key, text)``: a row of positions (bucket -1) and rows of chunks."""
    def run(batches):
        roller, task, k = Roller(11), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for first, last, _, _ in chunks(batch, size=block_bytes):
                # copies are made of one block at a time
                keys = batch.column("key").slice(first, last - first).to_pylist()
                (_, _, data, offs), = chunks(marked(batch.slice(first, last - first)), size=1 << 62)
                start = data == 32
                start[1:] &= data[:-1] != 32
                start[offs[:-1][np.diff(offs) > 0]] = True
                borders = np.append(np.flatnonzero(start).astype(np.int32), np.int32(len(data)))
                del start
                counts = np.diff(np.searchsorted(borders[:-1], offs)).astype(np.int32)
                coded = pa.BinaryArray.from_buffers(pa.binary(), len(borders) - 1, [
                    None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
                del data, borders
                table, indices = coded.dictionary, np.asarray(coded.indices)
                del coded
                # frequent chunks get small numbers; the places of a bucket keep their order
                ranked = np.argsort(-np.bincount(indices, minlength=len(table)), kind="stable").astype(np.int32)
                number = np.empty(len(ranked), np.int32)
                number[ranked] = np.arange(len(ranked))
                bucket = _buckets(table, roller, buckets)[ranked]
                order = np.argsort(bucket, kind="stable")
                out = [{"block": task + k, "bucket": -1, "keys": keys, "counts": counts, "n": len(table),
                        "data": _squeeze(_planes(bucket) + _planes(number[indices]))}]
                table, bucket = table.take(pa.array(ranked[order])), bucket[order]
                ends = np.frombuffer(table.buffers()[1], np.int32, len(table) + 1) if len(table) else np.zeros(1, np.int32)
                raw = (table.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
                cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else [0]
                for a, b in zip(cut[:-1], cut[1:]):
                    out.append({"block": task + k, "bucket": int(bucket[a]), "keys": None, "counts": None, "n": int(b - a),
                                "data": _squeeze(_planes(np.diff(ends[a:b + 1])) + raw[ends[a]:ends[b]])})
                yield pa.RecordBatch.from_pylist(out, schema=_PACKED)
                k += 1
    return docs.mapInArrow(run, PACKED)


def _segment(rows: DataFrame, model_path: str) -> DataFrame:
    """``(block, bucket, n, ids)``: ids of the chunks of packed rows that come sorted by
    bucket, each distinct chunk of a bucket segmented once."""
    def run(batches):
        sp, table, bucket = processor(model_path), {}, None
        alone = np.array([sp.piece_to_id(MARK)], "<u4").tobytes()
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            out = []
            for block, b, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "n", "data"))):
                if b != bucket:
                    # a marker alone is the one chunk that the library cannot be given
                    bucket, table = b, {b" ": alone}
                raw = _expand(data)
                ends = (4 * n + np.concatenate(([0], np.cumsum(_values(raw, n))))).tolist()
                words = [raw[x:y] for x, y in zip(ends[:-1], ends[1:])]
                new = [w for w in words if w not in table]
                # the library puts the first marker in front by itself
                for w, ids in zip(new, sp.encode([w[1:].decode() for w in new], num_threads=1)):
                    table[w] = np.array(ids, "<u4").tobytes()
                found = [table[w] for w in words]
                sizes = np.fromiter((len(f) // 4 for f in found), np.int64, n)
                ids = np.frombuffer(b"".join(found), "<u4")
                out.append({"block": block, "bucket": b, "n": n, "ids": _squeeze(_planes(sizes) + _planes(ids))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return rows.mapInArrow(run, "block long, bucket int, n int, ids binary")


def _join_by_position(blocks: DataFrame, model_path: str | None) -> DataFrame:
    """Documents of blocks that carry the ids of their chunks: ``(key, ids)``, and with a model
    their decoded ``text``.  Positions are taken apart a run of documents at a time."""
    def run(batches):
        sp = processor(model_path) if model_path else None
        for batch in batches:
            for row in range(batch.num_rows):
                keys, counts, n, data, found = (batch.column(c)[row].as_py() for c in ("keys", "counts", "n", "data", "found"))
                sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for part in sorted(found or (), key=lambda p: p["bucket"]):
                    raw = _expand(part["ids"])
                    sizes.append(_values(raw, part["n"]))
                    ids.append(_values(raw, len(raw) // 4 - part["n"], 4 * part["n"]).astype(np.int32))
                del found
                sizes, ids = np.concatenate(sizes), np.concatenate(ids)
                raw = _expand(data)
                order = np.argsort(_values(raw, n), kind="stable")
                many, begin = np.empty(n, np.int64), np.empty(n, np.int64)
                many[order], begin[order] = sizes, np.cumsum(sizes) - sizes
                m = len(raw) // 4 - n
                planes = [np.frombuffer(raw, np.uint8, m, 4 * n + k * m) for k in range(4)]
                cut = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
                first = 0
                while first < len(keys):
                    last = max(first + 1, int(np.searchsorted(cut, cut[first] + RUN, "right")) - 1)
                    x, y = int(cut[first]), int(cut[last])
                    mine = sum(p[x:y].astype(np.int32) << (8 * k) for k, p in enumerate(planes))
                    size = many[mine]
                    ends = np.concatenate(([0], np.cumsum(size)))
                    flat = ids[np.repeat(begin[mine] - ends[:-1], size) + np.arange(int(ends[-1]))]
                    offs = ends[cut[first:last + 1] - x].astype(np.int32)
                    cols = [pa.array(keys[first:last], pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))]
                    if sp:
                        cols.append(pa.array(sp.decode(cols[1].to_pylist()), pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "ids", "text"][:len(cols)])
                    first = last
    return blocks.mapInArrow(run, "key long, ids array<int>" + (", text string" if model_path else ""))


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", with_text: bool = False,
           block_bytes: int = BLOCK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``(key, ids)`` of every row's whole text: what the library gives without begin and
    end ids and without sampling.  ``with_text`` adds ``text``, what its decode gives for the
    ids, as :func:`decode` would."""
    from ..session import ensure_checkpoint_dir
    check_model(model_path)
    spark = docs.sparkSession
    keyed = need(docs, key, "text").select(F.col(f"`{key}`").cast("long").alias("key"), "text")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts(spark), -(-total // segment_bytes))
    # bucketed by block: the ids' join then moves the ids alone
    name = f"chunk_blocks_{uuid.uuid4().hex}"
    (_blocks(keyed, buckets, block_bytes).write.option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
        .option("compression", "uncompressed").bucketBy(parts(spark), "block").saveAsTable(name))
    packed = spark.table(name)
    words = (packed.filter("bucket >= 0").select("block", "bucket", "n", "data")
                   .repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket"))
    found = (_segment(words, model_path).repartition(parts(spark), "block")
             .groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "ids")).alias("found")))
    blocks = packed.filter("bucket = -1").join(found.hint("merge"), "block", "left")
    out = _join_by_position(blocks.select("keys", "counts", blocks["n"], "data", "found"), model_path if with_text else None)
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with the column ``text``: what the library's decode gives for ``ids``
    (null ids: none)."""
    key = [c for c in encoded.columns if c != "ids"]
    if "text" in key:
        raise ValueError("encoded has a column text already")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema if f.name != "ids")

    def run(batches):
        sp = processor(model_path)
        for batch in batches:
            ends = np.cumsum(batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                # ids become Python numbers: a bounded run of rows at a time, or one row
                done = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + RUN, "right")))
                some, first = batch.slice(first, last - first), last
                text = sp.decode([x or [] for x in some.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in key), some.column("ids"), pa.array(text, pa.string())],
                                                 names=[*key, "ids", "text"])
    return encoded.select(*[f"`{c}`" for c in key], "ids").mapInArrow(run, f"{kept}ids array<int>, text string")
