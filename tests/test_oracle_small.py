"""Spark result == DuckDB oracle for a spread of registered queries on the smallest tables."""

import math

import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents labels benchmark embeddings conversations events").split()
NAMES = ["a7_token_stats", "a2_token_counts", "m1_prune_frequency", "m5_prune_random", "a4_tfidf_type3",
         "j1_remap_map", "d4_kfold", "a16_task_metrics", "c1_kmeans", "p6_encode_pair", "a24_metric_history",
         "m15_compare_methods"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(None if (not isinstance(x, (list, str)) and pd.isna(x)) else _norm(x) for x in rec))
    return cols, sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    got = _rows(E.queries()[name](spark, SF).toPandas())
    exp = _rows(duck.sql(E.oracle_sql()[name]).df())
    assert got[0] == exp[0]
    assert got[1] == exp[1]
