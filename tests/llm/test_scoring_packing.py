"""LM scoring, separator scan and packing against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

EDGE = [(9990, None), (9991, ""), (9992, "zzz qqq"), (9993, " \t\n"), (9994, "a b a b a b"), (9994, "a b a b a b")]


def _texts(n, seed=0):
    rnd = random.Random(seed)
    pool = "the of and a in to is das der le la el un ne pas que que the The AND é Ö 12 x-y".split()
    return [(i, " ".join(rnd.choices(pool, k=rnd.randint(1, 80)))) for i in range(n)]


def _katz(rows, Q, min_count=2):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tok = lambda t: re.findall("[^\x20\x09-\x0d]+", lower(t)) + ["</s>"]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            x = tok(t)
            uni.update(x)
            bi.update(zip(["<s>"] + x, x))
    for (h, _), c in bi.items():
        ctx[h] += c
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (Q.discounts(collections.Counter(z.values())) for z in (uni, bi))
    off = lambda c, d: (d[c] if c <= Q.K else 1.0) * c
    left, norm = n - sum(off(c, d1) for c in uni.values()), n
    if left <= 1e-9:
        left, norm = 1, n + 1
    p1 = lambda w: off(uni[w], d1) / norm if uni[w] else left / norm
    assert abs(sum(p1(w) for w in uni) + left / norm - 1) < 1e-9
    stored = collections.defaultdict(dict)
    for (h, w), c in bi.items():
        if c >= min_count:
            stored[h][w] = off(c, d2)
    back, size = {}, {}
    for h, x in stored.items():
        s, low = sum(x.values()), sum(p1(w) for w in x)
        size[h] = ctx[h] if s < ctx[h] else ctx[h] + 1
        back[h] = (1 - s / size[h]) / (1 - low)
        assert abs(s / size[h] + back[h] * (1 - low) - 1) < 1e-9  # exactly normalised
    out = []
    for i, t in rows:
        x = tok(t)
        score = sum(math.log10(stored[h][w] / size[h] if w in stored.get(h, {}) else back.get(h, 1.0) * p1(w))
                    for h, w in zip(["<s>"] + x, x))
        base = sum(math.log10((uni[w] + .5) / (n + .5 * (v + 1))) for w in x)
        out.append((i, held(i), len(x), sum(uni[w] > 0 for w in x), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("block", [3_000_000, 500])
def test_katz_matches_brute_force(frame, monkeypatch, block):
    from vocabtrim.llm import lm_scoring as Q
    monkeypatch.setattr(Q, "BLOCK_TOKENS", block)
    rows = _texts(120) + EDGE
    got = sorted(map(tuple, Q.score(frame(rows)).collect()))
    exp = _katz(rows, Q)
    assert len(got) == len(exp)
    for a, b in zip(got, exp):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


def test_katz_empty_and_untrained(frame):
    from vocabtrim.llm import lm_scoring as Q
    assert Q.score(frame([])).collect() == []
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = Q.score(frame([(held, "a b")])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 3 and math.isfinite(r["score"])


def _ids(rows, end):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [end] for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]


ODD = [(1, "it's we'll 12ab ½²Ⅷ ñandú ßẞ  \t\n x "), (2, "漢字かな <|endoftext|> é​"), (3, None), (4, ""),
       (5, "   "), (6, "àb́ ·×÷ ͿΩ"), (6, "àb́ ·×÷ ͿΩ"), (7, "\x0b\x0c\x85\xa0  z"), (8, "Ab" * 3000)]


def test_token_pieces_and_offsets(frame):
    from vocabtrim.llm import packing as Q
    rows = _texts(150, 3) + ODD + [(100 + i, "word " * n) for i, n in enumerate((31, 32, 33, 63, 64, 65, 700))]
    got = Q.pack(frame(rows), length=32, problem=40).collect()
    ids = sorted((i, x) for (i, _), x in zip(rows, _ids(rows, 0)))
    by_doc = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    exp = collections.Counter()
    for i, x in ids:
        first = len(x) % 32 or 32
        cuts = [0, *range(first, len(x) + 1, 32)] if len(x) > 32 else [0, len(x)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            exp[(i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += 1
    assert by_doc == exp
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 32
    total = sum(r.length for r in got)
    assert len(bins) <= 1.03 * total / 32 + 2
    assert Q.pack(frame([])).collect() == []


def test_genetic_steps_keep_every_piece():
    from vocabtrim.llm import packing as Q
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 300).tolist()
    one, two = Q.best_fit([], range(300), size, 100), Q.best_fit([], range(300), [s + 1 for s in size], 101)
    for bins in (Q.crossover(one, two, size, 100, rng), Q.mutate(one, size, 100, rng), Q.evolve(size, [one, two], 100, 3, 4, 6)):
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert max(sum(size[i] for i in b) for b in bins) <= 100
    assert len(Q.evolve(size, [one], 100, 3, 4, 6)) <= len(one)


@pytest.mark.parametrize("block", [7, 1 << 17])
def test_separator_scan(frame, block):
    from vocabtrim.llm import separator_scan as Q
    rows = _texts(40, 5) + ODD
    got = Q.documents(Q.token_files(frame(rows), block=block)).collect()
    assert all(r.terminated for r in got)
    assert collections.Counter(r.n_tokens for r in got) == collections.Counter(len(x) - 1 for x in _ids(rows, Q.END))
    by = collections.defaultdict(list)
    for r in got:
        by[r.stream].append((r.doc_no, r.start, r.n_tokens))
    for x in by.values():
        at = 0
        for k, (no, start, n) in enumerate(sorted(x)):
            assert (no, start) == (k, at)
            at += n + 1


def test_separator_scan_of_raw_files(spark, tmp_path):
    from vocabtrim.llm import separator_scan as Q
    for name, ids in (("a", [9, 1, 1, 9, 5, 6]), ("b", [9]), ("c", []), ("d", [1, 2, 3, 4, 5, 6, 7])):
        np.array(ids, "<u2").tofile(tmp_path / name)
    blocks = Q.read_token_files(spark, str(tmp_path), block=2)
    got = sorted((r.stream[-1], r.doc_no, r.start, r.n_tokens, r.terminated) for r in Q.documents(blocks, end=9).collect())
    assert got == [("a", 0, 0, 0, True), ("a", 1, 1, 2, True), ("a", 2, 4, 2, False), ("b", 0, 0, 0, True),
                   ("d", 0, 0, 7, False)]


def test_query_stores_bigrams_met_once(spark, tmp_path):
    from vocabtrim.llm import lm_scoring as Q
    from vocabtrim.llm.queries import QUERIES
    rows = _texts(60, seed=3) + EDGE + [(5000 + k, f"once{k} seen{k} words and") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op1_katz_scoring"](spark, str(tmp_path)).collect()))
    exp = _katz(rows, Q, min_count=1)
    assert len(got) == len(exp)
    for a, b in zip(got, exp):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


def test_packing_evolves_by_default():
    """The default population and generations are a search, and its result is no worse than best fit."""
    from vocabtrim.llm import packing as Q
    rng = np.random.default_rng(5)
    assert Q.POPULATION >= 8 and Q.GENERATIONS >= 24
    size = [int(v) for v in rng.integers(15, 60, 120)]
    first = Q.best_fit([], range(len(size)), size, 100)
    out = Q.evolve(size, [], 100, 3, Q.POPULATION, Q.GENERATIONS)
    assert sorted(i for b in out for i in b) == list(range(len(size))) and max(sum(size[i] for i in b) for b in out) <= 100
    assert Q.fitness(out, size, 100) >= Q.fitness(first, size, 100)


def test_ids_of_a_chunk_are_the_tokenizer_s(monkeypatch):
    """Words of a chunk looked up once each: the ids of every text as the tokenizer gives them,
    with far fewer look-ups than words."""
    import itertools
    import numpy as np
    import pyarrow as pa
    from vocabtrim.llm.common import CachedBpe, chunks
    from vocabtrim.llm.separator_scan import tokenizer_path
    bpe = CachedBpe(tokenizer_path())
    parts = ["'s", "'re", "'LL", "'", " ", "  ", "\n", "\t", "a", "é", "ll", "x9", "..", "12", "×", "\x0b", "ǀɏ", "日本", "\u00a0"]
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)]
    texts += ["", None, "they'll we've I'd it'st 'r 'v'l 's's x''s \n's", "end  ", " \r\n ", "ÿ÷", "é'", "'"]
    rnd = np.random.default_rng(5)
    texts += ["".join(rnd.choice(parts, 12)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for size in (300, 1 << 20):
        got = [ids[a:b].tolist() for _, _, data, offs in chunks(batch, size=size) for ids, at in [bpe.many(data, offs)]
               for a, b in zip(at[:-1], at[1:])]
        assert got == [bpe.enc.encode_ordinary(t or "") for t in texts]
    class Seen(dict):
        asked = 0

        def __getitem__(self, piece):
            Seen.asked += 1
            return bpe._ids(piece)
    monkeypatch.setattr(bpe, "cache", Seen())
    words = pa.RecordBatch.from_pydict({"text": ["one two three\n" * 50] * 20})
    (_, _, data, offs), = chunks(words)
    bpe.many(data, offs)
    assert Seen.asked < 10
