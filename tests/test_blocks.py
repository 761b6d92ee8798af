"""Lookups of arrays by blocks of rows, against the plain explode, join and rebuild."""

import pytest
from pyspark.sql import functions as F

from vocabtrim.operators.blocks import looked_up
from vocabtrim.operators.remap import _explode_join_rebuild, remap
from vocabtrim.operators.tokens import encode, encode_texts, sequences, words


def _sorted(df, *cols):
    return sorted(((*[r[c] for c in cols], list(r["input_ids"])) for r in df.collect()), key=repr)


def _rows(spark):
    rows = [(i, "a", [(i * 7 + j * j) % 23 for j in range(i % 9)], f"t{i}") for i in range(40)]
    rows += [(3, "a", [5, 900, 5], "again"), (None, "a", [1, 2], "none"), (None, "a", [4], "none"), (50, "b", None, "null"),
             (51, "b", [2, None, 3], "hole"), (52, None, [], "empty")]
    return spark.createDataFrame(rows, "example_id long, side string, input_ids array<int>, n string").repartition(3)


@pytest.mark.parametrize("elements", [1, 20, 1 << 21])
def test_blocks_give_what_explode_and_join_give(spark, elements):
    rows = _rows(spark)
    # an id with two values, one with none, ids without an entry
    table = spark.createDataFrame([(i, 100 + i) for i in range(0, 20, 2)] + [(4, 7), (3, None), (None, 1)], "_k int, _v int")
    want = _explode_join_rebuild(rows.drop("n"), "input_ids", table, F.coalesce("_v", F.lit(0)), ("example_id", "side"))
    got = looked_up(rows, "input_ids", table, 12, ("example_id", "side"), elements=elements)
    assert got.columns == rows.columns and got.count() == 45 - 1
    assert _sorted(got, "example_id", "side") == _sorted(want, "example_id", "side")


def test_texts_encoded_by_blocks(spark):
    texts = spark.createDataFrame(
        [(1, "a", "train", "Red fish, blue fish"), (2, "a", "test", "Fish Ünï 红色的 red"), (2, "a", "test", "two fish"),
         (3, "a", "train", "."), (None, "a", "train", "red"), (4, "b", "train", "unseen words here")],
        "example_id long, side string, split string, text string")
    vocab = spark.createDataFrame([("[UNK]", 0), ("[CLS]", 2), ("[SEP]", 3), ("fish", 5), ("red", 6), ("blue", 7), ("ünï", 8), ("红色的", 9)],
                                  "word string, token_id int")
    for specials in (True, False):
        want = sequences(encode(words(texts, add_special_tokens=specials), vocab))
        got = encode_texts(texts, vocab, 8, add_special_tokens=specials)
        assert _sorted(got, "example_id", "side", "split") == _sorted(want, "example_id", "side", "split")


def test_large_map_shuffles_no_occurrence(spark):
    """A map beyond the broadcast limit: the old join shuffled a row for each element."""
    top = 3_000_000
    rows = spark.range(400).select(F.col("id").alias("example_id"), F.lit("a").alias("side"),
                                   F.transform(F.sequence(F.lit(0), F.lit(499)), lambda j: (j % 10 + top - 10).cast("int")).alias("input_ids"))
    table = spark.createDataFrame([(top - 1 - i, i) for i in range(9)], "token_id int, new_id int")
    out = remap(rows, table, strategy="join", together=False)
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.filter("example_id = 7").first()["input_ids"]
    assert list(got) == [0 if j % 10 == 0 else 9 - j % 10 for j in range(500)] and out.count() == 400
    assert remap(rows, table, strategy="map", together=False).filter("example_id = 7").first()["input_ids"] == got


def test_empty_table_and_empty_rows(spark):
    rows = _rows(spark).drop("n")
    none = spark.createDataFrame([], "_k int, _v int")
    got = looked_up(rows.filter("example_id = 5"), "input_ids", none, 0, ("example_id", "side"), unk=4)
    assert list(got.first()["input_ids"]) == [4] * 5
    assert looked_up(rows.filter("example_id < 0"), "input_ids", none, 0, ("example_id", "side")).count() == 0


def test_j1_by_join_shuffles_no_token(spark, tmp_path):
    """neither the words of the texts nor their ids are rows of the plan."""
    from vocabtrim.plans.q_prune import j1_remap_join
    docs = spark.createDataFrame([(i, f"some words and number{i % 7} again") for i in range(40)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = j1_remap_join(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan
