"""Inputs on which an operator must not lose rows or answer differently by size."""

import os
import tempfile

from pyspark.sql import functions as F


def test_long_chain_is_one_component(spark):
    from vocabtrim.operators.cluster import connected_components
    n = 300
    nodes = spark.range(0, n + 2).select(F.col("id").cast("int").alias("token_id"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a int, b int")
    got = {r.token_id: r.component for r in connected_components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(n)} | {n: n, n + 1: n + 1}


def test_long_word_is_segmented(spark):
    from vocabtrim.operators.tokens import encode_subwords
    pieces = spark.createDataFrame([(p,) for p in ("a", "##a", "##bb", "##b")], "piece string")
    word = "a" + "bbb" * 400
    rows = encode_subwords(spark.createDataFrame([(word,), ("c",), ("ac",)], "word string"), pieces).collect()
    got = {r.word: list(r.pieces) for r in rows}
    assert got[word] == ["a"] + ["##bb"] * 600 and got["c"] == ["[UNK]"] and got["ac"] == ["[UNK]"]


def test_texts_without_words_stay(spark):
    from vocabtrim.operators.encoding import encode_pair, pair_arrays
    from vocabtrim.operators.tokens import encode, texts, words
    corpus = spark.createDataFrame(
        [(1, "aa bb", None), (2, "", None), (3, "aa", "!"), (4, "?", "bb")],
        "example_id long, text_a string, text_b string")
    vocab = spark.createDataFrame([("aa", 5), ("bb", 6)], "word string, token_id int")
    e = encode_pair(pair_arrays(encode(words(texts(corpus), keep_empty=True), vocab)), 8, pad=False)
    got = {r.example_id: list(r.input_ids) for r in e.collect()}
    assert got == {1: [2, 5, 6, 3], 2: [2, 3], 3: [2, 5, 3, 3], 4: [2, 3, 6, 3]}


def test_read_many_csv_by_uri(spark):
    from vocabtrim.operators.report import read_many_csv
    d = tempfile.mkdtemp(prefix="vocabtrim-test-")
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("a,b\n1,2\n")
    uri = "file://" + d
    assert read_many_csv(spark, [uri + "/x.csv", uri + "/missing.csv"]).count() == 1
    assert read_many_csv(spark, [uri + "/x.csv"], "a int, b int").first()["b"] == 2
    assert read_many_csv(spark, [uri + "/missing.csv"]) is None


def test_best_fold_falls_back_to_the_last(spark):
    from vocabtrim.operators.metrics import best_fold
    fm = spark.createDataFrame([(0, "pearsonr", 0.9), (1, "pearsonr", 0.1), (2, "pearsonr", 0.5)],
                               "fold int, metric string, value double")
    assert tuple(best_fold(fm).first()) == (None, 2, None)
    more = fm.unionByName(spark.createDataFrame([(0, "f1_score", 0.5), (1, "f1_score", 0.5)], fm.schema))
    assert tuple(best_fold(more).first()) == ("f1_score", 0, 0.5)


def test_plain_embedding_names_count(spark):
    from vocabtrim.operators.remap import parameter_counts
    p = spark.createDataFrame([("embeddings.word_embeddings.weight", 10), ("m.embeddings.norm.weight", 3),
                               ("encoder.w", 5)], "param_name string, numel long")
    r = parameter_counts(p).first()
    assert (r["total"], r["embedding"], r["model_only"]) == (18, 10, 8)


def test_a_bad_number_in_a_log_is_null(spark):
    from vocabtrim.operators.report import parse_logs
    logs = spark.createDataFrame([("x", "eval_loss: 0.5.\neval_acc: 0.25\n"), ("y", "eval_acc: 1.0\n")],
                                 "path string, text string")
    got = {(r.path, r.metric): r.value for r in parse_logs(logs).collect()}
    assert got.get(("x", "val_loss")) is None and got[("x", "val_acc")] == 0.25 and got[("y", "val_acc")] == 1.0


def test_forced_lookup_row_is_still_bounded(spark):
    from vocabtrim.operators.remap import MAP_LITERAL_LIMIT, _choose, remap
    big = spark.createDataFrame([(MAP_LITERAL_LIMIT + 5, 1), (7, 2)], "token_id int, new_id int")
    assert _choose(big, "map")[0] == "join"
    df = spark.createDataFrame([(1, "a", [7, MAP_LITERAL_LIMIT + 5, 8])], "example_id long, side string, input_ids array<int>")
    assert list(remap(df, big, strategy="map").first()["input_ids"]) == [2, 1, 0]


def test_number_of_dropped_ids(spark):
    from vocabtrim.operators.remap import dropped_ids
    ids = spark.createDataFrame([(1,), (2,), (9,)], "token_id int")
    assert dropped_ids(ids, spark.createDataFrame([(1,), (2,)], "token_id int")).first()[0] == 1



def test_no_join_before_the_tokenizer(spark):
    from vocabtrim.plans.common import Inputs
    plan = Inputs(spark, "/root/testdata/sf0.001").words()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_eps_forest_connects_what_the_edges_connect(spark):
    import random

    from vocabtrim.operators.cluster import connected_components, eps_edges, normalise
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) + 3 * (i % 4 == k) for k in range(4)]) for i in range(120)]
    unit = normalise(spark.createDataFrame(rows, "token_id int, vec array<double>"))
    nodes = unit.select("token_id")
    for block in (7, 500):
        whole, forest = (eps_edges(unit, 0.1, block=block, forest=f) for f in (False, True))
        want = {r.token_id: r.component for r in connected_components(nodes, whole).collect()}
        assert want == {r.token_id: r.component for r in connected_components(nodes, forest).collect()}
        assert block < 500 or forest.count() <= 2 * len(rows) < whole.count()


def test_zero_vectors_are_their_own_clusters(spark):
    from vocabtrim.operators.cluster import eps_clusters
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0])]
    vecs = spark.createDataFrame(rows, "token_id int, vec array<double>")
    got = {r.token_id: r.cluster for r in eps_clusters(vecs).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    only = eps_clusters(vecs.filter("token_id in (1, 4)"))
    assert {r.token_id: r.cluster for r in only.collect()} == {1: 0, 4: 1}


def test_grouped_remap_uses_the_map_of_the_row(spark):
    from vocabtrim.operators.remap import remap
    rows = spark.createDataFrame([(1, 0, [5, 6, 5]), (2, 1, [5, 6]), (3, 2, [6]), (4, 0, [])],
                                 "example_id long, fold int, input_ids array<int>")
    maps = spark.createDataFrame([(0, 5, 10), (1, 5, 20), (1, 6, 21)], "fold int, token_id int, new_id int")
    got = {r.example_id: list(r.input_ids) for r in remap(rows, maps, keys=("example_id",), by=("fold",)).collect()}
    assert got == {1: [10, 0, 10], 2: [20, 21], 3: [0], 4: []}


def test_counts_of_the_other_folds(spark):
    from vocabtrim.plans.pipelines import other_folds
    own = spark.createDataFrame([(0, 7, 3), (1, 7, 2), (1, 8, 4)], "fold int, token_id int, cnt long")
    got = {(r.fold, r.token_id): r.cnt for r in other_folds(own, 3).collect()}
    assert got == {(0, 7): 2, (1, 7): 3, (2, 7): 5, (0, 8): 4, (2, 8): 4}


def test_label_distribution_of_many_classes_and_nulls(spark):
    from vocabtrim.operators.split import label_distribution
    rows = [("a", float(i)) for i in range(12_000)] + [("b", None), ("b", 1.0)]
    got = label_distribution(spark.createDataFrame(rows, "part string, label double"))
    assert got.count() == 2 * 12_001
    assert got.filter("part = 'b' and n > 0").count() == 2
    assert got.filter("part = 'b' and label is null").first()["pct"] == 50.0


def test_replaced_files_are_read_anew(spark):
    from vocabtrim.plans.common import Inputs
    d = tempfile.mkdtemp(prefix="vocabtrim-test-")
    for text, words in (("aa bb", 2), ("aa bb cc dd", 4)):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(d + "/documents.parquet")
        assert Inputs(spark, d).vocab_rows() == 5 + words
