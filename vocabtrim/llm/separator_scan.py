"""Token counts of the documents in flat, unindexed token files.

A file is nothing but token ids; a document ends at the end-of-document id.  Files
are cut into blocks of a fixed number of tokens, each block is searched with one
vectorised comparison, and only the separators' places leave it.  A prefix scan over
the blocks of a file (tokens, separators and last separator before each block)
stitches documents that cross block borders.

Edge cases: an empty file has no documents; two neighbouring separators enclose an
empty document; tokens after the last separator are one document with ``terminated``
false; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CachedBpe, need, written

END = 50256
BLOCK_TOKENS = 1 << 17
BLOCKS = "stream string, block int, tokens binary"


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    from public_tokenizers import path
    return path(name)


def token_files(docs: DataFrame, path: str | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """Encode ``text`` (null: empty) and write the flat uint16 stream of each partition
    to the shared folder, cut into rows of ``block`` tokens that know nothing of documents."""
    where = path or tokenizer_path()

    def run(batches):
        encode, name = CachedBpe(where), f"stream-{TaskContext.get().partitionId():06d}"
        end, left, at = np.array([END], "<u2").tobytes(), bytearray(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                left += np.frombuffer(encode(text or ""), "<u4").astype("<u2").tobytes() + end
                while len(left) >= 2 * block:
                    yield _row(name, at, bytes(left[:2 * block]))
                    del left[:2 * block]
                    at += 1
        if left:
            yield _row(name, at, bytes(left))
    return written(need(docs, "text").mapInArrow(run, BLOCKS), "token-files")


def _row(stream: str, block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([block], pa.int32()), pa.array([data], pa.binary())],
                                      names=["stream", "block", "tokens"])


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw little-endian token files (``width`` bytes a token, one file a stream).
    Spark's binary reader bounds a file at 2 GB; write larger streams as several files."""
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                view = data.as_buffer()
                for i in range(0, len(view), width * block):
                    yield _row(name, i // (width * block), view[i:i + width * block].to_pybytes())
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def separators(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """``(stream, block, n_tokens, seps)``: the places of the separators in each block."""
    def run(batches):
        for batch in batches:
            sizes, places = [], []
            for data in batch.column("tokens"):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                sizes.append(len(ids))
                places.append(np.flatnonzero(ids == end).astype(np.int32))
            border = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32)
            flat = np.concatenate(places) if places else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("stream"), batch.column("block"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(border), pa.array(flat))],
                names=["stream", "block", "n_tokens", "seps"])
    return need(blocks, "stream", "block", "tokens").mapInArrow(
        run, "stream string, block int, n_tokens long, seps array<int>")


def documents(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """``(stream, doc_no, start, n_tokens, terminated)`` of every document: its number in
    the stream from 0, the place of its first token, its tokens without the separator."""
    found = written(separators(blocks, end, width), "separators")
    order = Window.partitionBy("stream").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    scan = found.withColumn("base", base)
    last = F.when(F.size("seps") > 0, F.col("base") + F.element_at("seps", -1))
    scan = (scan.withColumn("number", F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)))
                .withColumn("carry", F.coalesce(F.max(last).over(before), F.lit(-1)))
                .withColumn("final", F.lead("block").over(order).isNull()))
    inside = scan.select("stream", "base", "number", "carry", "seps", F.posexplode("seps").alias("i", "sep"))
    previous = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.col("base") + F.get("seps", F.col("i") - 1))
    inside = inside.select("stream", (F.col("number") + F.col("i")).alias("doc_no"), (previous + 1).alias("start"),
                           (F.col("base") + F.col("sep") - previous - 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    rest = scan.filter("final").select(
        "stream", (F.col("number") + F.size("seps")).alias("doc_no"),
        (F.coalesce(last, F.col("carry")) + 1).alias("start"), (F.col("base") + F.col("n_tokens")).alias("stop"))
    rest = (rest.filter("stop > start")
                .select("stream", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"),
                        F.lit(False).alias("terminated")))
    return inside.unionByName(rest)
