"""Average linkage, merging, block searches and k-means of any size against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocabtrim.operators import vectors as V
from vocabtrim.operators.cluster import cluster_to, eps_clusters, eps_edges, kmeans, mean_vectors, normalise, prune_by_cluster
from vocabtrim.operators.linkage import average_linkage, merge_clusters


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "token_id int, vec array<double>")


def unit(n, d=6, seed=1, groups=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    if groups:
        x = rng.standard_normal((groups, d))[rng.integers(0, groups, n)] * 4 + x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def one_at_a_time(x, ids, n):
    """The nearest pair joined until n clusters are left, as a set of sets of ids."""
    own = [[i] for i in range(len(x))]
    while len(own) > max(1, n):
        best = min((1 - float(np.mean(x[a] @ x[b].T)), min(ids[i] for i in a), min(ids[i] for i in b), k, m)
                   for k, a in enumerate(own) for m, b in enumerate(own) if min(ids[i] for i in a) < min(ids[i] for i in b))
        k, m = best[3:]
        own[k] = own[k] + own[m]
        own.pop(m)
    return {frozenset(ids[i] for i in c) for c in own}


def parts(rows):
    by = {}
    for r in rows:
        by.setdefault(r.cluster, set()).add(r.token_id)
    first = [min(by[c]) for c in sorted(by)]
    assert sorted(by) == list(range(len(by))) and first == sorted(first)
    return {frozenset(c) for c in by.values()}


@pytest.mark.parametrize("n,blocks,groups", [(12, None, 0), (30, 3, 5), (1, 2, 4), (40, None, 0)])
def test_average_linkage(spark, n, blocks, groups):
    x = unit(40, groups=groups)
    ids = [7 * k + 3 for k in range(40)]
    got = average_linkage(frame(spark, x, ids), n, blocks=blocks).collect()
    assert parts(got) == one_at_a_time(x, ids, n)


def test_average_linkage_of_copies_and_zero(spark):
    x = np.concatenate([np.repeat(unit(4, seed=3), 5, axis=0), unit(6, seed=4)])
    df = frame(spark, x).unionByName(spark.createDataFrame([(90, [None] * 6)], "token_id int, vec array<double>"))
    got = parts(average_linkage(df, 11).collect())
    assert {frozenset(range(5 * k, 5 * k + 5)) for k in range(4)} <= got and frozenset([90]) in got and len(got) == 11
    assert average_linkage(frame(spark, []), 3).count() == 0


def test_merge_clusters(spark):
    x = unit(80, groups=9, seed=5)
    df = frame(spark, x)
    labels = df.select("token_id", (F.col("token_id") % 20).alias("cluster"))
    m = np.array([x[k::20].mean(axis=0) for k in range(20)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {frozenset(t for t in range(80) if t % 20 in c) for c in one_at_a_time(m, list(range(20)), 7)}
    assert parts(merge_clusters(labels, df, 7).collect()) == want


def test_blocks_of_any_number_give_the_same(spark, monkeypatch):
    x = unit(300, groups=12, seed=6)
    df = frame(spark, x)
    whole = {(r.a, r.b) for r in eps_edges(df, 0.1).collect()}
    p = x @ x.T
    assert whole == {(i, j) for i in range(300) for j in range(i + 1, 300) if 1 - p[i, j] <= 0.1}
    lab, cent = kmeans(df, 40, rounds=3)
    one = sorted((r.token_id, r.cluster, round(r.dist, 9)) for r in lab.collect())
    cents = {r.cluster: np.round(r.centre, 9).tolist() for r in cent.collect()}
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 6 * 9)
    assert {(r.a, r.b) for r in eps_edges(df, 0.1).collect()} == whole
    lab, cent = kmeans(df, 40, rounds=3)
    assert sorted((r.token_id, r.cluster, round(r.dist, 9)) for r in lab.collect()) == one
    assert {r.cluster: np.round(r.centre, 9).tolist() for r in cent.collect()} == cents


def test_partial_norms_leave_most_pairs(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1500:1600] = x[:100] + 0.02 * rng.standard_normal((100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen = [0, 0]
    i, j = V.close_pairs(x, x, 0.7, seen)
    a, b = np.nonzero(x @ x.T >= 0.7)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(a.tolist(), b.tolist()))
    assert seen[1] < 0.1 * seen[0]


def test_kmeans_to_rest(spark):
    x = unit(200, groups=8, seed=9)
    df = frame(spark, x)
    lab, cent = kmeans(df, 25, rounds=None)
    rows = {r.token_id: r.cluster for r in lab.collect()}
    c = {r.cluster: np.array(r.centre) for r in cent.collect()}
    assert len(rows) == 200 and len(c) == 25
    for t, k in rows.items():
        assert np.square(x[t] - c[k]).sum() <= min(np.square(x[t] - v).sum() for v in c.values()) + 1e-12
    for k, v in c.items():
        mine = [t for t in rows if rows[t] == k]
        assert not mine or np.allclose(v, x[mine].mean(axis=0))
    assert kmeans(frame(spark, []), 5)[0].count() == 0
    assert kmeans(df, 500, rounds=1)[1].count() == 200


def test_mean_vectors_by_any_key(spark):
    x = unit(50, seed=10)
    df = frame(spark, x).withColumn("g", F.when(F.col("token_id") < 40, F.lit("a")).otherwise(F.lit("b")))
    got = {r.g: r.centre for r in mean_vectors(df, key="g").collect()}
    assert np.allclose(got["a"], x[:40].mean(axis=0)) and np.allclose(got["b"], x[40:].mean(axis=0))


@pytest.mark.parametrize("method", ["kmeans", "agglomerative", "dbscan"])
def test_prune_by_each_method(spark, method):
    x = unit(60, groups=6, seed=11) * np.linspace(1, 3, 60)[:, None]
    ids = [2 * k for k in range(60)]
    df = frame(spark, x, ids)
    rows = prune_by_cluster(df.select("token_id"), df, 20, method=method).collect()
    keep = {r.new_id: r.token_id for r in rows}
    assert [keep[i] for i in range(5)] == ids[:5] and sorted(keep) == list(range(len(rows)))
    labels = {r.token_id: r.cluster for r in cluster_to(df.filter("token_id > 8"), 43, method).collect()}
    assert len(rows) == 5 + len(set(labels.values()))
    if method != "kmeans":
        assert len(rows) == 48
    at = {t: x[k] for k, t in enumerate(ids)}
    for i, c in enumerate(sorted(set(labels.values()))):
        mine = [t for t in labels if labels[t] == c]
        mean = np.mean([at[t] for t in mine], axis=0)
        far = {t: float(np.square(at[t] - mean).sum()) for t in mine}
        assert keep[5 + i] in mine and far[keep[5 + i]] <= min(far.values()) + 1e-12


def test_eps_clusters_with_and_without_edges(spark):
    x = unit(40, groups=5, seed=12)
    got = {r.token_id: r.cluster for r in eps_clusters(frame(spark, x), 0.05).collect()}
    p = 1 - x @ x.T
    name = list(range(40))
    for _ in range(40):
        name = [min(name[j] for j in range(40) if p[i, j] <= 0.05 or i == j) for i in range(40)]
    dense = {c: k for k, c in enumerate(sorted(set(name)))}
    assert got == {i: dense[name[i]] for i in range(40)}
    assert {r.token_id: r.cluster for r in eps_clusters(frame(spark, x), 1e-9).collect()} == {i: i for i in range(40)}
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "token_id int, vec array<double>")
    assert {r.token_id: r.cluster for r in eps_clusters(zero, 0.3).collect()} == {1: 0, 2: 1, 3: 2}
    assert normalise(zero).count() == 3


def test_components_below_the_bound_are_finished_at_once(spark, monkeypatch):
    """A chain of ever wider gaps joins one pair a round: once wider pairs have given the bound, no
    round of Spark is left for it; as a component too large for a task it gives the same in rounds."""
    from vocabtrim.operators import linkage as L
    turns = np.concatenate([np.cumsum(0.002 * 1.5 ** np.arange(9)), [1 + 0.5 * (k // 2) + 0.2 * (k % 2) for k in range(16)]])
    x = np.stack([np.cos(turns), np.sin(turns)], axis=1)
    vecs, searches, neighbours = frame(spark, x), [], L.V.neighbours
    monkeypatch.setattr(L.V, "neighbours", lambda *a: (searches.append(1), neighbours(*a))[1])
    for members in (2048, 4):
        monkeypatch.setattr(L, "MEMBERS", members)
        assert parts(L.average_linkage(vecs, 17, blocks=1).collect()) == one_at_a_time(x, range(25), 17)
        if members == 2048:
            assert len(searches) == 1


def test_cells_hold_few_blocks_and_meet_each_pair_once(spark):
    """40 blocks: no cell has more than HELD of the left, no block goes to each of the others,
    and each pair of blocks is met once."""
    from collections import Counter
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)], "token_id int, vec array<double>")
    blocks = V.pack(vecs, 40, by=F.floor(F.col("token_id") / 10).cast("int"))
    right = blocks.filter("blk < 13")

    def met(half):
        def run(batches):
            import pyarrow as pa
            for cell, a, b, (x, _), (y, _) in V.each_pair(batches, half):
                assert x[0] // 10 == a and y[-1] // 10 == b and len(x) == len(y) == 10
                yield pa.RecordBatch.from_pydict({"cell": [cell], "a": [a], "b": [b]})
        return run
    for half, other, n in ((False, right, 13), (True, blocks, 40)):
        cells = V.pairs(blocks, other, 40, n, half)
        got = Counter((r.a, r.b) for r in cells.mapInArrow(met(half), "cell long, a long, b long").collect())
        assert got == Counter((a, b) for a in range(40) for b in range(n) if not half or a <= b)
        rows = Counter((r.cell, r.side) for r in cells.select("cell", "side").collect())
        assert max(v for (_, side), v in rows.items() if side == 0) <= V.HELD
        assert sum(rows.values()) < 40 * n / 2


def test_kmeans_searches_only_for_points_that_need_it(spark, monkeypatch):
    """Many centres: the same labels as searches for every point, with far fewer points searched for."""
    import random

    from vocabtrim.operators import cluster
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    # equal vectors, a repeated id, a zero and its negative, one with a null
    rows += [(300, rows[4][1]), (301, rows[4][1]), (5, [0.5] * 6), (302, [0.0] * 6), (303, [-0.0] * 6), (304, [None] * 6)]
    df = spark.createDataFrame(rows, "token_id int, vec array<double>")
    asked, nearest = [], cluster._nearest
    monkeypatch.setattr(cluster, "_nearest", lambda rows, n, *a: asked.append(n) or nearest(rows, n, *a))
    want = kmeans(df, 240, rounds=3)
    assert not asked
    got = kmeans(df, 240, rounds=3, least=0)
    assert 0 < sum(asked) < 3 * len(rows)
    plain = lambda x: sorted((r.token_id, r.cluster, round(r.dist, 9)) for r in x.collect())
    assert plain(got[0]) == plain(want[0])
    centres = lambda x: {r.cluster: [round(v, 9) + 0.0 for v in r.centre] for r in x.collect()}
    assert centres(got[1]) == centres(want[1])
