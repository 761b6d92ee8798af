"""Streaming use of the batch operators.

The reference has no streams; two operators are stateless or simply stateful
enough to run unchanged on Structured Streaming, so a pruned vocabulary can be
applied to data as it arrives:

* :func:`remap_stream` — J1 as a stream-static join: every micro-batch of
  encoded rows is rewritten through a (size-checked) token map folded into one
  dense lookup row; no state, append mode.
* :func:`stream_token_counts` — A2 as a streaming aggregation (running counts
  per token id, update / complete mode; state = one row per token).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import word_array
from ..operators.remap import MAP_LITERAL_LIMIT, _lookup_row, remap
from ..operators.ordering import scalar


def remap_stream(stream: DataFrame, token_map: DataFrame, col: str = "input_ids", unk: int = 0) -> DataFrame:
    """J1 on a stream: ``col`` rewritten through ``token_map`` (static, checked size)."""
    top = scalar(token_map, F.max("token_id"))
    size = 0 if top is None else int(top) + 1
    if size > MAP_LITERAL_LIMIT:
        raise ValueError("token map too large for a broadcast lookup; use remap_batches")
    lut = F.broadcast(_lookup_row(token_map.sparkSession, token_map, "token_id", "new_id", size, unk))
    j = stream.withColumn("_one", F.lit(1)).join(lut, "_one")
    return j.withColumn(col, F.transform(col, lambda x: F.coalesce(F.try_element_at(F.col("_lut"), x + 1),
                                                                   F.lit(unk)))).drop("_one", "_lut")


def remap_batches(stream: DataFrame, token_map: DataFrame, write, col: str = "input_ids", unk: int = 0,
                  keys=("example_id",), strategy: str = "auto") -> DataStreamWriter:
    """J1 on a stream with a map of any size: every micro-batch goes through the batch remap,
    whose equi-join needs no bound on the map.  ``write(rows, batch_id)`` stores a batch;
    ``keys`` must tell the rows of a batch apart.  Returns the writer, not yet started."""
    def step(batch: DataFrame, batch_id: int) -> None:
        write(remap(batch, token_map, col, unk, keys, strategy), batch_id)
    return stream.writeStream.foreachBatch(step)


def stream_token_counts(text_stream: DataFrame, vocab: DataFrame, text: str = "text", unk: int = 0) -> DataFrame:
    """A2 on a stream of texts: running occurrence counts per token id."""
    words = text_stream.select(F.explode(word_array(F.col(text))).alias("word"))
    ids = words.join(vocab, "word", "left").select(
        F.coalesce(F.col("token_id"), F.lit(unk)).alias("token_id"))
    return ids.groupBy("token_id").agg(F.count(F.lit(1)).alias("cnt"))
