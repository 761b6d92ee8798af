"""Streaming variants of J1 and A2 (memory sink, available-now trigger)."""

import os
import tempfile

from vocabtrim.streaming.remap_stream import remap_batches, remap_stream, stream_token_counts


def test_remap_stream(spark):
    d = tempfile.mkdtemp(prefix="vocabtrim-stream-")
    src = os.path.join(d, "in")
    spark.createDataFrame([(1, [2, 7, 9, 3]), (2, [2, 12, 3])], "example_id long, input_ids array<int>") \
        .write.parquet(src)
    tm = spark.createDataFrame([(i, i) for i in range(5)] + [(7, 5), (9, 6)], "token_id int, new_id int")
    stream = spark.readStream.schema("example_id long, input_ids array<int>").parquet(src)
    q = (remap_stream(stream, tm).writeStream.format("memory").queryName("remapped")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.example_id: list(r.input_ids) for r in spark.sql("SELECT * FROM remapped").collect()}
    assert got == {1: [2, 5, 6, 3], 2: [2, 0, 3]}


def test_remap_batches_joins_a_map_of_any_size(spark):
    d = tempfile.mkdtemp(prefix="vocabtrim-stream-")
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    spark.createDataFrame([(1, [2, 7, 9, 3]), (2, [2, 12, 3]), (3, [])], "example_id long, input_ids array<int>") \
        .write.parquet(src)
    far = 2_000_000_000  # an id no lookup row could hold
    tm = spark.createDataFrame([(i, i) for i in range(5)] + [(7, 5), (9, 6), (far, 7)], "token_id int, new_id int")
    stream = spark.readStream.schema("example_id long, input_ids array<int>").parquet(src)
    q = (remap_batches(stream, tm, lambda rows, i: rows.write.mode("append").parquet(out))
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.example_id: list(r.input_ids) for r in spark.read.parquet(out).collect()}
    assert got == {1: [2, 5, 6, 3], 2: [2, 0, 3], 3: []}


def test_stream_counts(spark):
    d = tempfile.mkdtemp(prefix="vocabtrim-stream-")
    src = os.path.join(d, "in")
    spark.createDataFrame([("The cat the dog",), ("a cat",)], "text string").write.parquet(src)
    vocab = spark.createDataFrame([("the", 5), ("cat", 6)], "word string, token_id int")
    stream = spark.readStream.schema("text string").parquet(src)
    q = (stream_token_counts(stream, vocab).writeStream.format("memory").queryName("counts").outputMode("complete")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.token_id: r.cnt for r in spark.sql("SELECT * FROM counts").collect()}
    assert got == {5: 2, 6: 2, 0: 1}
