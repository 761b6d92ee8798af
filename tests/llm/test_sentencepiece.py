"""The distinct-chunk table against the library itself."""

import hashlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from vocabtrim.llm import sentencepiece_chunks as op  # noqa: E402
from vocabtrim.llm.common import table  # noqa: E402
from vocabtrim.llm.queries import QUERIES  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", None, " ", "  ", "a", "▁", "▁▁a", " ▁ a ", "a\0b", "\n \n", "x" * 5000, " " * 3000, "日本語 テスト 　",
         "a " * 400, "é é ﻿", "🎉 🎉🎉", "a\tb  c\r\n d", "<s> <unk></s>", "the  the the", "ﬁ 　x"]


def expected(rows):
    sp = op.processor(MODEL)
    out = Counter()
    for i, t in rows:
        ids = sp.encode(t or "")
        out[(i, tuple(ids), sp.decode(ids))] += 1
    return out


@pytest.mark.parametrize("block,segment", [(60, 40), (1 << 20, 1 << 20)])
def test_edges(spark, frame, block, segment):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(EDGES)] * 2
    got = op.decode(op.encode(frame(rows), MODEL, block_bytes=block, segment_bytes=segment), MODEL).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got) == expected(rows)
    both = op.encode(frame(rows), MODEL, with_text=True, block_bytes=block, segment_bytes=segment).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in both) == expected(rows)


def test_empty_table(frame):
    out = op.decode(op.encode(frame([]), MODEL), MODEL)
    assert out.columns == ["doc_id", "ids", "text"] and out.count() == 0


def test_decode_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", [264, 259]), (2, None, []), (3, "c", None)], "k long, ids2 string, ids array<int>")
    got = {r.k: (r.ids2, r.text) for r in op.decode(df, MODEL).collect()}
    sp = op.processor(MODEL)
    assert got == {1: ("a", sp.decode([264, 259])), 2: (None, ""), 3: ("c", "")}


def test_model_is_checked():
    op.check_model(MODEL)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    sp = op.processor(MODEL)
    want = Counter()
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids = sp.encode(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    got = QUERIES["op11_sentencepiece"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == want
