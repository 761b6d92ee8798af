"""Distributed row numbers, budgets, keep lists."""

from pyspark.sql import functions as F

from vocabtrim.operators.ordering import with_row_number
from vocabtrim.operators.rank import (keep_by_parameters, keep_by_percent, keep_random, parameter_keep_count,
                                      percent_keep_count, removed, sorted_map, union_keep)


def test_row_number_matches_window(spark):
    df = spark.range(0, 997).select((F.col("id") % 7).alias("g"), ((F.col("id") * 37) % 101).alias("v"), "id")
    got = with_row_number(df, [F.col("v").desc(), F.col("id").asc()], groups=["g"], num_partitions=5)
    got = {(r.id, r.rn) for r in got.collect()}
    rows = sorted(df.collect(), key=lambda r: (r.g, -r.v, r.id))
    exp, last, k = set(), None, 0
    for r in rows:
        k = k + 1 if r.g == last else 1
        last = r.g
        exp.add((r.id, k))
    assert got == exp


def test_global_row_number_dense(spark):
    df = spark.range(0, 1000).withColumn("v", F.col("id") % 13)
    got = with_row_number(df, [F.col("v").asc(), F.col("id").asc()], num_partitions=7)
    rns = sorted(r.rn for r in got.collect())
    assert rns == list(range(1, 1001))


def test_golden_keep_counts():
    # keep = 5 + int((n - 5) * 0.8) reproduces the published reductions (V = 50368)
    golden = {"cola": (6364, 5092), "mrpc": (14268, 11415), "mnli": (37290, 29833), "wnli": (1650, 1321),
              "qqp": (41104, 32884), "rte": (17184, 13748), "sst2": (13708, 10967), "stsb": (13874, 11100),
              "qnli": (37925, 30341)}
    for n, keep in golden.values():
        assert 5 + percent_keep_count(n, 20) == keep
    assert round((1 - 11415 / 50368) * 100, 2) == 77.34
    assert round((1 - 11465 / 50368) * 100, 2) == 77.24


def test_parameter_budget_keep_all():
    # the corpus vocabulary already meets the budget: keep everything
    assert parameter_keep_count(100, 95, 20, vocab_rows=50368, dim=768, total_params=149_600_000) is None
    k = parameter_keep_count(40000, 39995, 20, vocab_rows=50368, dim=768, total_params=149_600_000)
    assert k is not None and 11_400 <= k + 5 <= 11_420


def _counts(spark, pairs):
    return spark.createDataFrame(pairs, "token_id int, cnt long")


def test_keep_by_percent_specials_and_ties(spark):
    c = _counts(spark, [(2, 10), (3, 10), (7, 5), (8, 5), (9, 5), (10, 1), (11, 1), (12, 9), (13, 2), (14, 2)])
    tm = {r.token_id: r.new_id for r in keep_by_percent(c, 20).collect()}
    # n = 10 -> k = max(5, int(5 * 0.8)) = 5 non-special, specials 0-4 always kept
    assert [tm[i] for i in range(5)] == [0, 1, 2, 3, 4]
    assert tm[12] == 5 and tm[7] == 6 and tm[8] == 7 and tm[9] == 8 and tm[13] == 9
    assert 14 not in tm
    rem = {r.token_id for r in removed(c, keep_by_percent(c, 20)).collect()}
    assert rem == {10, 11, 14}


def test_keep_p0_and_p100(spark):
    c = _counts(spark, [(i, 100 - i) for i in range(5, 40)])
    assert keep_by_percent(c, 0).count() == 5 + 30  # n - 5 non-special (Q3)
    assert keep_by_percent(c, 100).count() == 5 + 5  # min_tokens


def test_keep_random_repeatable(spark):
    c = _counts(spark, [(i, 1) for i in range(5, 105)])
    a = {(r.token_id, r.new_id) for r in keep_random(c, 20, seed=1).collect()}
    b = {(r.token_id, r.new_id) for r in keep_random(c, 20, seed=1).collect()}
    assert a == b and len(a) == 5 + 80
    assert sorted(n for _, n in a) == list(range(85))


def test_sorted_map_and_union(spark):
    c = _counts(spark, [(9, 1), (3, 1), (5, 1)])
    tm = sorted_map(c)
    assert sorted((r.token_id, r.new_id) for r in tm.collect()) == [(3, 0), (5, 1), (9, 2)]
    extra = spark.createDataFrame([(11, 0), (5, 1), (12, 2)], "token_id int, ord int")
    u = union_keep(tm, extra, "ord")
    assert sorted((r.token_id, r.new_id) for r in u.collect()) == [(3, 0), (5, 1), (9, 2), (11, 3), (12, 4)]


def test_parameter_budget_map(spark):
    c = _counts(spark, [(i, 1000 - i) for i in range(2, 400)])
    tm = keep_by_parameters(c, 20, vocab_rows=500, dim=10, total_params=500 * 10 * 4)
    ids = sorted(r.new_id for r in tm.collect())
    assert ids == list(range(len(ids)))


def test_null_groups_keep_their_rows(spark):
    rows = [(None if i % 3 == 0 else i % 3, (i * 7) % 11, i) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = with_row_number(df, [F.col("v").desc(), F.col("id").asc()], groups=["g"], num_partitions=4).collect()
    assert len(got) == 30
    exp = set()
    for g in (None, 1, 2):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        exp |= {(r[2], k) for k, r in enumerate(mine, 1)}
    assert {(r.id, r.rn) for r in got} == exp


def test_numbering_does_not_depend_on_partitions(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7) % 50).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id").asc()]
    a = {(r.id, r.rn) for r in with_row_number(df, order, groups=["g"], num_partitions=1).collect()}
    b = {(r.id, r.rn) for r in with_row_number(df, order, groups=["g"], num_partitions=9).collect()}
    assert a == b


def test_random_under_parameter_budget(spark):
    from vocabtrim.operators.rank import keep_random_by_parameters
    c = _counts(spark, [(i, 1) for i in range(2, 400)])
    args = dict(vocab_rows=500, dim=10, total_params=500 * 10 * 4)
    n, ns = 398, 395
    k = parameter_keep_count(n, ns, 20, **args)
    tm = keep_random_by_parameters(c, 20, **args)
    assert tm.count() == k + 5 and sorted(r.new_id for r in tm.collect()) == list(range(k + 5))
    assert keep_random_by_parameters(c, 0.1, **args).count() == n  # already met: all corpus tokens
