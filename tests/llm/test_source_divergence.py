"""The divergence audit against plain integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vocabtrim.llm import source_divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_hand(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = Counter()
    for lang in sources:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources[lang]:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources[lang]}
        q = share(whole)
        for s in sources[lang]:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources[lang] if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (v, item) in enumerate(sorted(items)[:most]):
                    out[lang, s, part, item.decode(), -v, i + 1] += 1
    return out


def some_rows(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "thé", "theory", "theories", "a", "ab", "abc", "abcdefgh", "abcdefghijklmnopqrstuvwxyz", "Ünïcode", "ünïcode",
             "日本語", "日本", "x" * 300, "x" * 299 + "y", "don't", "it_is", "42nd"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = rng.choice(["hot", "hot", "hot", "a", "b", "", None, "é"])
        k = rng.choice([0, 1, 5, 30])
        rows.append((lang, source, rng.choice([None, ""]) if k == 0 else rng.choice(" \n,;1").join(rng.choices(words, k=k))))
    return rows + [("solo", "one", "the end")] + [("few", s, "rare words") for s in "abc"] + [("en", "silent", "1 2 3")]


def frame(spark, rows):
    df = spark.createDataFrame(list(rows), "lang string, source string, text string").repartition(4)
    return df.withColumns({c: F.lit("x") for c in ("key", "sid", "p", "count", "part", "rank", "value", "n", "doc_id")})


@pytest.mark.parametrize("min_docs,top,bits,block", [(10, 4, op.BITS, 1 << 20), (2, 50, 1 << 16, 300), (1, 3, 1 << 16, 1)])
def test_against_hand(spark, min_docs, top, bits, block):
    rows = some_rows()
    got = op.audit(frame(spark, rows), min_docs=min_docs, top=top, block_bytes=block, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert Counter(map(tuple, got.collect())) == by_hand(rows, min_docs, top)


def test_many_sources_and_term_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 3)
    monkeypatch.setattr(op, "TERMS", 4)
    rows = some_rows(5) + [("en", f"s{i}", f"the abc w{chr(97 + i)}") for i in range(8)]
    got = op.audit(frame(spark, rows), min_docs=3, top=5)
    assert Counter(map(tuple, got.collect())) == by_hand(rows, 3, 5)


def test_empty_table(spark):
    assert op.audit(frame(spark, [])).count() == 0


def test_refinement_drops_only_rare_prefixes(spark):
    rows = some_rows(9)
    packed = op.blocks(spark.createDataFrame([(a or "", b or "", c) for a, b, c in rows], "lang string, source string, text string"))
    docs = Counter()
    for lang, _, text in rows:
        docs.update({(lang or "", t.encode()) for t in TERM.findall((text or "").translate(LOWER))})
    got = {(r.lang, bytes(r.key)): r.n for r in op.kept_terms(packed, 6).collect()}
    assert got == {k: n for k, n in docs.items() if n >= 6}
