"""Rows without an id, ids with several texts, repeated rows, empty tables and clashing
columns through every stage of the pipeline and every operator on documents."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def prose(seed, words=90):
    rnd = random.Random(seed)
    pool = ["the", "and", "of", "is", "that"] + [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    return " ".join(rnd.choices(pool, k=words))


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("row", "doc", "fp", "_id", "_row", "_runs", "_left", "component_id", "id")})


def texts(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_near_duplicates_keep_unrelated_rows(spark):
    import corpus_pipeline as P
    rows = [(None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (8, prose(5)), (9, prose(5)), (9, prose(5)),
            (None, prose(6)), (3, prose(6)), (11, None), (12, ""), (None, None)]
    docs = documents(spark, rows)
    out = P.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    # the smallest id of each class stays, null last; wordless texts are one class
    assert texts(out) == collections.Counter([(None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (8, prose(5)),
                                              (3, prose(6)), (11, None)])


@pytest.mark.parametrize("null", [False, True])
def test_repeated_passages(spark, null):
    import corpus_pipeline as P
    shared = prose(50, 120)[:P.REPEAT_BYTES + 20]
    ids = [None, None, None] if null else [1, 2, 2]
    rows = [(ids[0], prose(1) + " ONE " + shared + " TWO " + prose(2)), (ids[1], prose(3) + " THREE " + shared + " FOUR " + prose(4)),
            (ids[2], prose(5)), (5, None), (6, "short")]
    docs = documents(spark, rows)
    out = P.repeated_passages(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == 5 and all(shared not in (r.text or "") for r in got)
    cut = [r.text for r in got if r.text and r.text.startswith((prose(1), prose(3)))]
    assert len(cut) == 2 and all(len(prose(1)) < len(t) < len(prose(1)) + len(prose(2)) + 14 for t in cut)
    assert (ids[2], prose(5)) in texts(out) and (6, "short") in texts(out)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_decontamination(spark):
    import corpus_pipeline as P
    item = max((r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    rows = [(None, prose(1) + "\n" + item + "\n" + prose(2)), (None, prose(3)), (4, prose(4) + " " + item), (4, prose(5)), (6, None)]
    docs = documents(spark, rows)
    out = P.decontamination(spark, docs, SF)
    assert out.columns == docs.columns
    assert texts(out) == collections.Counter([(None, prose(3)), (4, prose(5)), (6, None)])


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as P
    empty = documents(spark, [(1, "x")]).filter("doc_id > 1")
    for name, stage in P.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        assert name == "best-fit packing" or out.columns == empty.columns


def test_whole_run_with_rows_without_ids(spark, tmp_path):
    import corpus_pipeline as P
    rows = [(None, prose(1)), (None, prose(2)), (5, prose(3)), (5, prose(4)), (6, prose(3))]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    assert collections.Counter(r.doc_id for r in out.collect()) == {None: 2, 5: 2}


ROWS = [(None, prose(1)), (None, prose(1)), (3, prose(2) + " café"), (3, prose(3)), (None, None), (4, ""), (5, prose(1)), (None, prose(8))]


def test_operators_keep_rows_without_ids(spark, frame):
    from vocabtrim.llm import decontaminate, language_id, lm_scoring, packing, quality_rules, simhash, suffix_dedup
    docs = frame(ROWS)
    ids = collections.Counter(i for i, _ in ROWS)

    def kept(df):
        return collections.Counter(r.doc_id for r in df.select("doc_id").collect()) == ids
    scored = lm_scoring.score(docs, min_count=1)
    assert kept(scored) and all(r.held_out is not None for r in scored.collect())
    assert all(not r.held_out for r in scored.collect() if r.doc_id is None)
    assert kept(quality_rules.score(docs))
    pieces = packing.pack(docs).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == ids
    classes = simhash.near_duplicates(docs).collect()
    assert kept(simhash.near_duplicates(docs))
    # rows 0, 1 and 6 are copies, of which one has an id
    assert sorted((r.component_id for r in classes if r.doc_id is None), key=str) == [4, 5, 5, None]
    gone = suffix_dedup.removed(docs, length=100).collect()
    assert collections.Counter(r.doc_id for r in gone) == ids
    want = collections.Counter()
    for i, t in ROWS:
        raw, cover = (t or "").encode(), set()
        everything = [(u or "").encode() for _, u in ROWS]
        for a in range(len(raw) - 99):
            w = raw[a:a + 100]
            if sum(x.count(w) if w not in x[x.find(w) + 1:] else 2 for x in everything if w in x) > 1:
                cover.update(range(a, a + 100))
        want[i, len(cover), hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in cover)).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in gone) == want
    with_lang = docs.withColumn("lang", F.lit("en"))
    assert kept(language_id.label(with_lang, language_id.train(with_lang)))
    bench = spark.createDataFrame([(1, prose(8)), (None, prose(2))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(None, 1), (3, None)}
    assert texts(decontaminate.clean(docs, bench)) == collections.Counter(r for r in ROWS if r not in [ROWS[2], ROWS[7]])


def test_held_out_is_never_null(spark, tmp_path):
    from vocabtrim.llm.queries import QUERIES
    spark.createDataFrame([(i, t, "en") for i, t in ROWS], "doc_id long, text string, lang string") \
         .write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_katz_scoring", "op8_language_id"):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == len(ROWS) and all(r.held_out is not None for r in got)
