"""Reports and files (S5-S11, P13-P15, J10, J11, A20, W8), encoding (P4-P10, P6) and the registry."""

import os
import tempfile

from pyspark.sql import functions as F

from vocabtrim.functions.text import decode_prediction, locale_double, size_to_number, strip_marker
from vocabtrim.operators.encoding import encode_pair, label_or_default, pad_batches, standardise_label, with_batch
from vocabtrim.operators.remap import parameter_counts, parameter_table
from vocabtrim.operators.report import (format_report, order_by_baseline, parse_logs, performance_drop,
                                        read_many_csv, read_summary, run_summary, scan_logs, with_sizes,
                                        write_csv, write_predictions)
from vocabtrim.sources.corpus import resolve_task, task_metadata, validation_split

# Two data rows of a published two-header summary file (format fixture).
SUMMARY = """,,NO PRUNING,,TRAIN TOKENS ONLY,,RANDOM,,CLUSTERING,,FREQUENCY,,ATTENTION,,IMPORTANCE,,FREQUENCY_OOV,,IMPORTANCE_OOV
,paper,train,test,train,test,train,test,train,test,train,test,train,test,train,test,test,test
COLA,"0,65","0,5859","0,5859","0,3965","0,5092","0,461","0,4704","","0,0","0,4882","0,4673","0,5893","0,5893","0,4523","0,5196","0,5395","0,6148"
MNLI,"0,891","0,8834","0,8809","0,8855","0,8832","0,8352","0,8317","0,7096","0,712","0,8802","0,8802","0,8668","0,864","0,8802","0,8749","0,8813","0,8784"
"""


def _write(text, name):
    d = tempfile.mkdtemp(prefix="vocabtrim-test-")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_summary_and_drop(spark):
    res = read_summary(spark, _write(SUMMARY, "SUMMARY.csv"))
    v = {(r.dataset, r.method, r.split): r.value for r in res.collect()}
    assert v[("COLA", "CLUSTERING", "train")] == 0.0 and v[("MNLI", "IMPORTANCE_OOV", "test")] == 0.8784
    d = {(r.dataset, r.method): r.drop_pp for r in performance_drop(res).collect()}
    # golden values of the published drop table
    assert abs(d[("MNLI", "TRAIN TOKENS ONLY")] - (-0.23)) < 1e-9
    assert abs(d[("COLA", "CLUSTERING")] - 58.59) < 1e-9
    assert abs(d[("COLA", "IMPORTANCE_OOV")] - (-2.89)) < 1e-9
    s = {r.dataset: r.size for r in with_sizes(res, task_metadata(spark)).collect()}
    assert s["MNLI"] == "393k" and s["COLA"] == "8.5k"
    o = {r.dataset: r.order for r in order_by_baseline(res.filter(F.col("split") == "test")).collect()}
    assert o["MNLI"] == 1 and o["COLA"] == 2


def test_locale_and_size_parsing(spark):
    df = spark.createDataFrame([("0,65", "8.5k"), ("", "634"), ("abc", "N/A"), ("1.5", "67k"), (None, None)],
                               "v string, s string")
    got = [(r.a, r.b) for r in df.select(locale_double(F.col("v")).alias("a"), size_to_number(F.col("s")).alias("b"))
           .collect()]
    assert got == [(0.65, 8500.0), (0.0, 634.0), (0.0, 0.0), (1.5, 67000.0), (0.0, 0.0)]


LOG = """2024-01-01 - INFO - eval_loss: 0.5
2024-01-01 - INFO - eval_accuracy: 0.81
2024-01-01 - INFO - eval_accuracy: 0.84
2024-01-01 - INFO - eval_delta: -0.25
=== Test Set Evaluation Results ===
accuracy: 0.83
f1: 0.8
=== Parameter Reduction Statistics ===
Total parameter reduction: 20.02%
Embedding parameter reduction: 77.34%
Model_only parameter reduction: 0.00%
Vocabulary reduction: 77.34%
Vocabulary reduction: 12.00%
"""


def test_parse_logs_and_run_summary(spark):
    p = _write(LOG, "run_cola.log")
    logs = scan_logs(spark, p)
    m = {r.metric: r.value for r in parse_logs(logs).collect()}
    assert m["val_accuracy"] == 0.84 and m["val_delta"] == -0.25
    assert m["test_accuracy"] == 0.83 and m["test_f1"] == 0.8
    assert "test_Total" not in m and m["total_param_reduction"] == 20.02
    assert m["vocab_reduction"] == 77.34
    legacy = {r.metric: r.value for r in parse_logs(logs, strict_legacy=True).collect()}
    assert "val_delta" not in legacy  # the unsigned pattern loses negative values, as the original regexes do
    summ = run_summary(parse_logs(logs).withColumn("task", F.lit("cola"))).first()
    assert summ["embedding_param_reduction"] == 77.34


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp(prefix="vocabtrim-test-")
    df = spark.createDataFrame([(1, "cola", 0.5), (2, "rte", 0.25)], "example_id long, task string, pred double")
    write_csv(df, os.path.join(d, "csv"), by=["task"])
    back = read_many_csv(spark, [os.path.join(d, "csv"), os.path.join(d, "missing")])
    assert back.count() == 2
    write_predictions(df, os.path.join(d, "pred"), regression=True)
    lines = spark.read.text(os.path.join(d, "pred")).collect()
    assert sorted(r.value for r in lines) == ["0.250000", "0.500000"]
    from vocabtrim.operators.report import write_encoded
    enc = spark.createDataFrame([(1, [2, 5, 3], [1, 1, 1], 1.0)],
                                "example_id long, input_ids array<int>, attention_mask array<int>, labels double")
    write_encoded(enc, os.path.join(d, "enc"))
    assert spark.read.parquet(os.path.join(d, "enc")).first().input_ids == [2, 5, 3]
    f = format_report(spark.createDataFrame([(1234567, 12.3456)], "n long, p double"), ["n"], ["p"]).first()
    assert f.n == "1,234,567" and f.p == "12.35"


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "example_id long, ids_a array<int>, ids_b array<int>")


def _longest_first(a, b, max_length):
    a, b = list(a), list(b) if b is not None else None
    budget = max_length - (2 if b is None else 3)
    while len(a) + (len(b) if b is not None else 0) > budget:
        if b is None or len(a) > len(b):
            a.pop()
        else:
            b.pop()
    ids = [2] + a + [3] + ((b + [3]) if b is not None else [])
    return ids + [1] * (max_length - len(ids)), [1] * len(ids) + [0] * (max_length - len(ids))


def test_encode_pair_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        la, lb = rnd.randint(0, 20), rnd.randint(0, 20)
        b = None if i % 5 == 0 else [100 + j for j in range(lb)]
        rows.append((i, [10 + j for j in range(la)], b))
    got = {r.example_id: (list(r.input_ids), list(r.attention_mask)) for r in encode_pair(_pairs(spark, rows), 16).collect()}
    for i, a, b in rows:
        assert got[i] == _longest_first(a, b, 16), (i, len(a), b and len(b))


def test_batches_and_labels(spark):
    df = spark.createDataFrame([(i, [1] * (i % 4 + 1), -1.0 if i == 5 else 1.0) for i in range(10)],
                               "example_id long, input_ids array<int>, label double")
    df = label_or_default(standardise_label(df)).withColumn("attention_mask", F.lit(None).cast("array<int>"))
    b = pad_batches(with_batch(df, 4), pad_id=0).collect()
    by = {r.example_id: r for r in b}
    assert by[0].batch == 0 and by[4].batch == 1 and by[9].batch == 2
    assert len(by[0].input_ids) == 4 and by[0].attention_mask == [1, 0, 0, 0]
    assert by[5].labels == -1.0


def test_decode_and_marker(spark):
    df = spark.createDataFrame([([0.1, 0.9],), ([0.5, 0.5],), ([3.2],)], "logits array<double>")
    assert [r.p for r in df.select(decode_prediction(F.col("logits")).alias("p")).collect()] == [1.0, 0.0, 3.2]
    assert spark.range(1).select(strip_marker(F.lit("##ing")).alias("w")).first().w == "ing"


def test_task_registry(spark):
    t = task_metadata(spark)
    assert t.count() == 10
    r = spark.createDataFrame([("mnli",), ("MNLI-mismatched",), ("cola",)], "t string")
    got = [(x.a, x.b) for x in r.select(resolve_task(F.col("t")).alias("a"), validation_split(F.col("t")).alias("b"))
           .collect()]
    assert got == [("mnli-matched", "validation_matched"), ("mnli-mismatched", "validation_mismatched"),
                   ("cola", "validation")]


def test_parameter_counts(spark):
    c = parameter_counts(parameter_table(spark, 50368, 768, 110_000_000)).first()
    assert c.embedding == 50368 * 768 and c.total == 50368 * 768 + 110_000_000
    assert c.model_only == 110_000_000


def test_subword_greedy(spark):
    from vocabtrim.operators.tokens import encode_subwords
    pieces = spark.createDataFrame([(p,) for p in ["un", "##believ", "##able", "##a", "##b", "##l", "##e", "u", "n",
                                                   "##un", "b"]], "piece string")
    words = spark.createDataFrame([("unbelievable",), ("unable",), ("xyz",), ("bun",)], "word string")
    got = {r.word: list(r.pieces) for r in encode_subwords(words, pieces).collect()}
    assert got["unbelievable"] == ["un", "##believ", "##able"]
    assert got["unable"] == ["un", "##able"]
    assert got["xyz"] == ["[UNK]"]
    assert got["bun"] == ["b", "##un"]


def test_split_clusters(spark):
    import random
    from vocabtrim.operators.cluster import split_clusters
    rnd = random.Random(2)
    vec = spark.createDataFrame([(i, [rnd.random(), rnd.random()]) for i in range(30)], "token_id int, vec array<double>")
    lab = spark.createDataFrame([(i, 0 if i < 20 else 1) for i in range(30)], "token_id int, cluster int")
    out = split_clusters(lab, vec, 4)
    ids = sorted({r.cluster for r in out.collect()})
    assert ids == [0, 1, 2, 3] and out.count() == 30


def test_pipelines_prune_and_compare(spark):
    from vocabtrim.plans.common import Inputs
    from vocabtrim.plans.pipelines import compare_methods, prepare, prune, summarise_runs
    inp = Inputs(spark, "/root/testdata/sf0.001")
    train = inp.corpus().filter(F.col("split") == "train")
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").cast("int").alias("token_id"), "embedding")
    for method in ("frequency", "random", "train_only", "importance", "frequency_oov", "clustering"):
        r = prune(method, train, inp.vocab(), inp.vocab_rows(), emb, p=20, dim=64)
        ids = sorted(x.new_id for x in r.token_map.select("new_id").distinct().collect())
        assert ids == list(range(len(ids))), method
        assert r.report.first().kept_tokens == len(ids)
    out = prepare(inp.corpus(), inp.vocab(), prune("frequency", train, inp.vocab(), inp.vocab_rows()))
    assert out.count() == inp.corpus().count()
    cmp = compare_methods(spark, _write(SUMMARY, "SUMMARY.csv"))
    assert cmp.filter(F.col("size") == "393k").count() > 0
    logs = summarise_runs(spark, _write(LOG, "cola_x.log"))
    assert logs.first()["test_accuracy"] == 0.83


def test_one_log_a_task_by_pattern(spark):
    import pathlib
    from vocabtrim.operators.report import choose_logs, scan_chosen_logs
    root = tempfile.mkdtemp(prefix="vocabtrim-test-")
    files = {"a/a_importance_token_prune20.log": "first", "a/a_importance_prune20.0.log": "second", "b/b_importance_prune20.0.log": "b",
             "b/b_importance_prune20x0.log": "no dot", "c/c_importance_v1_prune5.log": "old", "c/c_importance_v2_prune5.log": "new",
             "d/e_importance_token_prune20.log": "another task", "x.log": "none"}
    for k, (name, text) in enumerate(files.items()):
        p = pathlib.Path(root, name)
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
        os.utime(p, (1_000_000 + k, 1_000_000 + k))
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "task string")
    patterns = ("{task}/{task}_importance_token_prune20.log", "{task}/{task}_importance_prune20.0.log",
                "{task}/{task}_importance*prune*.log")
    chosen = choose_logs(spark, root, tasks, patterns)
    assert {r.task for r in chosen.filter("path is null").collect()} == {"d"}
    got = {r.task: r.text for r in scan_chosen_logs(spark, chosen).collect()}
    assert got == {"a": "first", "b": "b", "c": "new"}
    assert scan_chosen_logs(spark, chosen.filter("task = 'd'")).count() == 0


def test_hooks(spark):
    from pyspark.sql import functions as F
    from vocabtrim.operators import metrics as M
    from vocabtrim.operators.tokens import encode_with, token_counts_of
    rows = spark.createDataFrame([(1, "aab"), (2, ""), (3, "b")], "example_id long, text string")
    hook = F.pandas_udf(lambda t: t.map(lambda x: [ord(c) for c in x] or None), "array<int>", F.PandasUDFType.SCALAR)
    enc = encode_with(rows, hook)
    assert {r.example_id: list(r.input_ids) for r in enc.collect()} == {1: [97, 97, 98], 2: [], 3: [98]}
    assert {tuple(r) for r in token_counts_of(enc).collect()} == {(97, 2, 1), (98, 2, 2)}
    preds = spark.createDataFrame([(1, 1.0, 1.0, .9), (2, 0.0, 1.0, .8), (3, -1.0, 0.0, .1)],
                                  "example_id long, label double, pred double, score double")
    before = list(M.FAMILIES)
    try:
        @M.register_metric("mean_score")
        def mean_score(p, by=()):
            return M.labelled(p).groupBy(*by).agg(F.avg("score").alias("mean_score"))
        got = {r.metric: r.value for r in M.all_metrics_long(preds, metrics=["mean_score", "accuracy_score"]).collect()}
        assert {k: round(v, 9) for k, v in got.items()} == {"mean_score": 0.85, "accuracy_score": 0.5}
        tasks = spark.createDataFrame([("t", ["mean_score"])], "task string, metrics array<string>")
        assert [(r.task, r.metric, round(r.value, 9)) for r in M.task_metrics(preds, tasks).collect()] == [("t", "mean_score", 0.85)]
    finally:
        M.FAMILIES[:] = before


def test_dropped_ids_are_observed(spark):
    from pyspark.sql import Observation
    from vocabtrim.operators.remap import valid_ids
    ids = spark.createDataFrame([(1, 5), (2, 6), (9, 7)], "token_id int, cnt int")
    seen = Observation("dropped")
    emb = spark.createDataFrame([(1,), (2,), (2,)], "token_id int")
    kept = valid_ids(ids, emb, seen)
    assert sorted(map(tuple, kept.collect())) == [(1, 5), (2, 6)] and seen.get["n_dropped"] == 1


def test_split_is_a_partition_filter(spark):
    from vocabtrim.plans.common import Inputs
    inp = Inputs(spark, "/root/testdata/sf0.001")
    plan = inp.text_corpus().filter("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    whole = inp.text_corpus().groupBy("split").count().collect()
    assert sum(r["count"] for r in whole) == inp.table("documents").count() and {r.split for r in whole} == {"train", "validation", "test"}


def test_subwords_of_the_whole_vocabulary(spark):
    import random
    from vocabtrim.operators.tokens import encode_subwords
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("abc", k=rnd.randint(1, 12))) for _ in range(300)})
    body = sorted({"".join(rnd.choices("abc", k=rnd.randint(1, 7))) for _ in range(120)}) + ["a", "b"]
    pieces = set(body[::2]) | {"##" + b for b in body[1::2]} | {"a", "##a", "##b", "##c"}

    def greedy(w):
        out, at = [], 0
        while at < len(w):
            l = next((l for l in range(len(w) - at, 0, -1) if ("##" if at else "") + w[at:at + l] in pieces), 0)
            if not l:
                return ["[UNK]"]
            out.append(("##" if at else "") + w[at:at + l])
            at += l
        return out
    got = encode_subwords(spark.createDataFrame([(w,) for w in words + ["d"]], "word string"),
                          spark.createDataFrame([(p,) for p in pieces], "piece string")).collect()
    assert {r.word: list(r.pieces) for r in got} == {w: greedy(w) for w in words + ["d"]}
