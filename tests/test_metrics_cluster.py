"""Metrics (A12-A18) and clustering."""

import math

from pyspark.sql import functions as F

from vocabtrim.operators.cluster import (cluster_removed, connected_components, eps_clusters, kmeans,
                                         normalise, prune_by_cluster, representatives)
from vocabtrim.operators.metrics import (best_fold, binary_metrics, cv_summary, matthews, pearson, spearman)


def _preds(spark, rows):
    return spark.createDataFrame([(i, float(l), float(p), float(s)) for i, (l, p, s) in enumerate(rows)],
                                 "example_id long, label double, pred double, score double")


def test_binary_and_mcc(spark):
    rows = [(1, 1, .9), (1, 0, .2), (0, 0, .1), (0, 1, .7), (1, 1, .8), (-1, 1, .5)]
    b = binary_metrics(_preds(spark, rows)).first()
    assert b.n == 5 and b.accuracy_score == 0.6
    assert abs(b.precision_score - 2 / 3) < 1e-12 and abs(b.recall_score - 2 / 3) < 1e-12
    m = matthews(_preds(spark, rows)).first().matthews_corrcoef
    tp, tn, fp, fn = 2, 1, 1, 1
    exp = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    assert abs(m - exp) < 1e-12


def test_zero_denominators(spark):
    rows = [(0, 0, .1), (0, 0, .2)]
    b = binary_metrics(_preds(spark, rows)).first()
    assert b.f1_score == 0.0 and b.precision_score == 0.0 and b.recall_score == 0.0
    assert matthews(_preds(spark, rows)).first().matthews_corrcoef == 0.0


def test_spearman_ties(spark):
    rows = [(1, 0, 1.0), (2, 0, 2.0), (2, 0, 2.0), (3, 0, 4.0), (5, 0, 3.0)]
    got = spearman(_preds(spark, rows), x="label", y="score").first().spearmanr
    # average ranks: x = [1, 2.5, 2.5, 4, 5], y = [1, 2.5, 2.5, 5, 4]
    import statistics
    xs, ys = [1, 2.5, 2.5, 4, 5], [1, 2.5, 2.5, 5, 4]
    mx, my = statistics.mean(xs), statistics.mean(ys)
    num = sum((a - mx) * (b - my) for a, b in zip(xs, ys))
    den = math.sqrt(sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert abs(got - num / den) < 1e-12
    assert abs(pearson(_preds(spark, rows)).first().pearsonr - 0.8) < 0.2


def test_cv_summary_best_fold(spark):
    fm = spark.createDataFrame([(0, "accuracy_score", 0.5), (1, "accuracy_score", 0.7), (2, "accuracy_score", 0.7),
                                (0, "f1_score", 0.9)], "fold int, metric string, value double")
    s = {r.metric: (r.mean, r.std) for r in cv_summary(fm).collect()}
    assert abs(s["accuracy_score"][0] - 0.6333333333) < 1e-9
    b = best_fold(fm).first()
    assert b.metric == "accuracy_score" and b.fold == 1


def _vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "token_id int, vec array<double>")


def _brute_kmeans(pts, k, rounds, seed=42):
    import hashlib
    order = sorted(pts, key=lambda t: (hashlib.md5(f"{seed}:{t}".encode()).hexdigest(), t))
    cent = {i: list(pts[t]) for i, t in enumerate(order[:k])}
    for _ in range(rounds + 1):
        lab = {}
        for t, v in pts.items():
            lab[t] = min(cent, key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, cent[c])), c))
        new = {}
        for c in cent:
            mem = [pts[t] for t in pts if lab[t] == c]
            if mem:
                new[c] = [sum(x) / len(mem) for x in zip(*mem)]
        cent.update(new)
    return lab


def test_kmeans_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    pts = {i: [rnd.random() for _ in range(4)] for i in range(60)}
    lab, _ = kmeans(_vecs(spark, pts.items()), 5, 42, 5)
    got = {r.token_id: r.cluster for r in lab.collect()}
    assert got == _brute_kmeans(pts, 5, 5)


def test_eps_components_chain_and_noise(spark):
    import math as m
    # a chain of unit vectors 0.2 rad apart (cos dist ~0.02) and two isolated points
    rows = [(i, [m.cos(0.2 * i), m.sin(0.2 * i), 0.0]) for i in range(6)]
    rows += [(10, [0.0, 0.0, 1.0]), (11, [0.0, 0.0, -1.0]), (12, [0.0, 0.0, 0.0001 + 1.0])]
    c = {r.token_id: r.cluster for r in eps_clusters(_vecs(spark, rows), 0.3).collect()}
    assert len({c[i] for i in range(6)}) == 1
    assert c[10] == c[12] and c[11] != c[10] and c[11] != c[0]
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "token_id int")
    comp = {r.token_id: r.component for r in connected_components(nodes, e).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_normalise_zero_vector(spark):
    n = normalise(_vecs(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0])])).collect()
    d = {r.token_id: r.vec for r in n}
    assert abs(d[1][0] - 0.6) < 1e-12 and d[2][0] is None


def test_cluster_removed_and_prune(spark):
    import random
    rnd = random.Random(5)
    vec = _vecs(spark, [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(40)])
    keep = spark.createDataFrame([(i, i) for i in range(10)], "token_id int, new_id int")
    rem = spark.createDataFrame([(i,) for i in range(10, 40)] + [(99,)], "token_id int")
    oov, keep2 = cluster_removed(rem, keep, vec, k=4)
    o = {r.token_id: r.rep_id for r in oov.collect()}
    assert set(o) == set(range(10, 40))  # 99 has no vector (P11)
    reps = set(o.values())
    assert len(reps) <= 4
    k2 = {r.token_id: r.new_id for r in keep2.collect()}
    assert reps <= set(k2) and sorted(k2.values()) == list(range(len(k2)))
    kept = prune_by_cluster(spark.createDataFrame([(i,) for i in range(40)], "token_id int"), vec, 50)
    assert kept.count() == 5 + (35 - 20)


def test_eps_edges_blocks_match_brute_force(spark):
    import random
    from vocabtrim.operators.cluster import eps_edges
    rnd = random.Random(11)
    rows = []
    for i in range(40):
        c = i % 4
        v = [1.0 if k == c else 0.0 for k in range(4)]
        v = [x + rnd.gauss(0, 0.35) for x in v]
        n = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / n for x in v]))
    want = {(a, b) for a, va in rows for b, vb in rows
            if a < b and 1 - sum(x * y for x, y in zip(va, vb)) <= 0.3}
    for block in (3, 1024):
        got = {(r.a, r.b) for r in eps_edges(_vecs(spark, rows), 0.3, block=block).collect()}
        assert got == want, block


def test_history_is_not_dealt_by_run(spark, monkeypatch):
    """Entries that come dealt by run: no task gets all of a run, and the series are the plain ones."""
    from collections import Counter
    from vocabtrim.operators import metrics
    parts = {}

    def seen(df, *args, **kw):
        parts.update(Counter(r[0] for r in df.select(F.spark_partition_id()).collect()))
        return numbered(df, *args, **kw)
    numbered = metrics.with_row_number
    monkeypatch.setattr(metrics, "with_row_number", seen)
    rows = [(run, s, k, None if k == "note" else float(s)) for run in ("a", None) for s in range(300)
            for k in (("eval_loss", "epoch") if s % 3 == 0 else ("loss", "epoch", "other", "note"))]
    df = spark.createDataFrame(rows, "run string, step long, key string, value double").repartition(2, "run")
    got = {}
    for r in metrics.metric_history(df).collect():
        got.setdefault((r.run, r.phase, r.metric), {})[r.idx] = r.value
    want = {}
    for run, s, k, v in rows:
        if s % 3 == 0 or k in metrics.TRAIN_KEYS:
            name = (run, "eval" if s % 3 == 0 else "train", k.removeprefix("eval_"))
            want.setdefault(name, {})[len(want.get(name, {}))] = v
    assert got == want
    assert max(parts.values()) < sum(parts.values()) / 2
