"""Remapping (J1-J4, C6) and splits."""

from pyspark.sql import functions as F

from vocabtrim.operators.remap import hybrid_lookup, remap, remap_keep_padding, truncation_map
from vocabtrim.operators.split import allocate, kfold, label_distribution, split3, split_train_test


def _seqs(spark):
    return spark.createDataFrame([(1, "a", [2, 7, 9, 11, 3]), (2, "a", [2, 12, 3]), (3, "a", [])],
                                 "example_id long, side string, input_ids array<int>")


def _map(spark, pairs):
    return spark.createDataFrame(pairs, "token_id int, new_id int")


def test_remap_strategies_agree(spark):
    tm = _map(spark, [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 5), (9, 6)])
    for how in ("join", "map", "auto"):
        got = {r.example_id: list(r.input_ids) for r in remap(_seqs(spark), tm, strategy=how).collect()}
        assert got == {1: [2, 5, 6, 0, 3], 2: [2, 0, 3], 3: []}, how


def test_hybrid_modes(spark):
    keep = _map(spark, [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 5), (9, 6), (11, 7)])
    oov = spark.createDataFrame([(11, 11), (12, 11)], "token_id int, rep_id int")
    intended = {r.token_id: r.new_id for r in hybrid_lookup(keep, oov, "intended").collect()}
    assert intended[12] == 7 and intended[11] == 7 and intended[7] == 5
    shipped = {r.token_id: r.new_id for r in hybrid_lookup(keep, oov, "as_shipped").collect()}
    assert shipped[12] == 7 and shipped[11] == 7  # original id 11 clamped to size-1 = 7
    assert shipped[9] == 6


def test_keep_padding_and_truncation(spark):
    tm = _map(spark, [(2, 0), (3, 1), (7, 2)])
    got = {r.example_id: list(r.input_ids) for r in remap_keep_padding(_seqs(spark), tm, pad=0).collect()}
    assert got[1] == [0, 2, 0, 0, 1]
    v = spark.createDataFrame([(i,) for i in range(10)], "token_id int")
    assert {r.token_id: r.new_id for r in truncation_map(v, 4).collect()}[7] == 0


def test_allocate_largest_remainder():
    assert allocate({0.0: 3, 1.0: 97}, 90) == {0.0: 3, 1.0: 87}
    assert sum(allocate({0.0: 1, 1.0: 2, 2.0: 3}, 4).values()) == 4


def _pool(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, float(label)))
            i += 1
    return spark.createDataFrame(rows, "example_id long, label double")


def test_split_disjoint_complete_balanced(spark):
    pool = _pool(spark, {0: 1, 1: 2, 2: 3, 3: 97})
    s = split_train_test(pool, 0.9, 42).collect()
    assert len(s) == 103 and len({r.example_id for r in s}) == 103
    train = [r for r in s if r.part == "train"]
    assert len(train) == 92  # floor(0.9 * 103)
    three = split3(pool, (0.8, 0.1, 0.1), 42).groupBy("part").count().collect()
    assert sum(r["count"] for r in three) == 103
    again = split3(pool, (0.8, 0.1, 0.1), 42).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, split3(pool, (0.8, 0.1, 0.1), 42).collect()))


def test_split_ratio_check(spark):
    import pytest
    with pytest.raises(ValueError):
        split3(_pool(spark, {0: 5}), (0.8, 0.1, 0.2))


def test_kfold_balanced(spark):
    pool = _pool(spark, {0: 40, 1: 60})
    f = kfold(pool, 5, 0.1, 42)
    rows = f.collect()
    assert sum(1 for r in rows if r.part == "test") == 10
    by_fold = f.filter(F.col("part") == "train").groupBy("fold", "label").count().collect()
    sizes = {}
    for r in by_fold:
        sizes.setdefault(r.fold, 0)
        sizes[r.fold] += r["count"]
    assert sorted(sizes.values()) == [18, 18, 18, 18, 18]
    plain = kfold(pool, 5, 0.1, 42, label=None).filter(F.col("part") == "train").groupBy("fold").count()
    assert sorted(r["count"] for r in plain.collect()) == [18, 18, 18, 18, 18]


def test_label_distribution_missing_class(spark):
    df = spark.createDataFrame([(1, 0.0, "train"), (2, 1.0, "train"), (3, 1.0, "test")],
                               "example_id long, label double, part string")
    d = {(r.part, r.label): (r.n, r.pct) for r in label_distribution(df).collect()}
    assert d[("test", 0.0)] == (0, 0.0) and d[("train", 1.0)] == (1, 50.0)


def test_split_and_folds_keep_rows_without_a_label(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "example_id long, label double")
    parts = split_train_test(df, 0.9).collect()
    assert sorted(r.example_id for r in parts) == list(range(60))
    assert sum(r.part == "train" and r.label is None for r in parts) == 18
    folds = kfold(df, 3, 0.1).collect()
    assert sorted(r.example_id for r in folds) == list(range(60))
    assert {r.fold for r in folds if r.part == "train" and r.label is None} == {0, 1, 2}
