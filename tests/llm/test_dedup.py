"""SimHash, suffix arrays, suffix dedup and decontamination against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _fingerprint(t, k=3):
    from xxhash import xxh64_intdigest
    w = _lower(t).encode().split()
    s = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(frame):
    from vocabtrim.llm import simhash as Q
    rnd = random.Random(1)
    base = [rnd.choices([f"w{i}" for i in range(50)], k=60) for _ in range(20)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(60):
        w = list(rnd.choice(base))
        w[rnd.randrange(60)] = "edit"
        rows.append((100 + k, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (505, "a b"), rows[0], rows[0]]
    got = Q.near_duplicates(frame(rows)).collect()
    fp = {i: _fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    exp = _classes(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert len(got) == len(rows)
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == exp[r.doc_id] for r in got)
    assert len(set(exp.values())) < len(ids) - 6
    assert Q.near_duplicates(frame([])).collect() == []


@pytest.mark.parametrize("hot", [2000, 7, 1])
def test_links_of_dense_cells(spark, hot):
    from vocabtrim.llm import simhash as Q
    from vocabtrim.llm.components import components
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2 ** 63, 6, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(40):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), k) for k, f in enumerate(fps)], "fp long, rep long")
    got = {r.id: r.component for r in components(Q.linked(df, hot=hot)).collect()}
    n = len(fps)
    exp = _classes(range(n), [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {k: got.get(k, k) for k in range(n)} == exp


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_cells_over_batches(size):
    """Cells that go on over any number of batches: small ones are compared, large ones handed on whole."""
    import pyarrow as pa
    from vocabtrim.llm import simhash as Q
    rnd = random.Random(size)
    rows = sorted((rnd.randrange(3), rnd.choice([1, 1, 1, 2, 3, 4 + k]), rnd.randrange(2 ** 40), k) for k in range(400))
    names = ["p", "key", "fp", "rep"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + size]), kinds)], names=names)
               for i in range(0, 400, size)]
    cells = collections.defaultdict(list)
    for p, key, fp, rep in rows:
        cells[p, key].append((fp, rep))
    got, hot = set(), []
    for out in Q._cells(iter(batches), 3, 10):
        for r in out.to_pylist():
            if r["edge"]:
                got.add((r["a"], r["b"]))
            else:
                hot.append((r["p"], r["key"], r["a"], r["b"]))
    assert sorted(hot) == [r for r in rows if len(cells[r[:2]]) > 10]
    want = set()
    for c in cells.values():
        if 1 < len(c) <= 10:
            a, b = Q._stars(np.array([f for f, _ in c]), np.array([r for _, r in c]), 3)
            want |= set(zip(a.tolist(), b.tolist()))
    assert got == want


def test_components_of_a_chain(spark):
    from vocabtrim.llm.components import components
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_suffix_array_and_repeats():
    from vocabtrim.llm.suffix_arrays import repeated, shard_text, suffix_array
    rnd = random.Random(1)
    for k in range(150):
        parts = [bytes(rnd.choices(range(97, 97 + rnd.choice([1, 2, 3, 26])), k=rnd.randint(1, 60)))
                 for _ in range(rnd.randint(1, 6))]
        if k % 3 == 0:
            parts = [p * rnd.randint(1, 4) for p in parts] + [parts[0]]
        text = shard_text(parts)[0]
        t = text.tolist()
        assert suffix_array(text).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        n = rnd.randint(1, 12)
        win = [max(0, len(p) - n + 1) for p in parts]
        c = collections.Counter(p[i:i + n] for p, w in zip(parts, win) for i in range(w))
        assert [x.tolist() for x in repeated(parts, win, n)] == \
            [[c[p[i:i + n]] > 1 for i in range(w)] for p, w in zip(parts, win)]


def _repeat_cases():
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choices([f"word{i}" for i in range(400)], k=rnd.randint(1, 300)))) for k in range(60)]
    shared = rows[0][1] + " é" * 100 + rows[1][1]
    rows += [rows[3], rows[4], (5, rows[6][1]), (900, None), (901, ""), (902, "a" * 1500), (903, "ab" * 400 + "é" * 300)]
    return rows + [(1000 + k, " ".join(rnd.choices("abcdefgh", k=60)) + shared[rnd.randint(0, 200):900]
                    + " ".join(rnd.choices("xyzw", k=rnd.randint(0, 300)))) for k in range(40)]


def _repeat_masks(rows, n=400):
    c = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i:i + n] for i in range(len(b) - n + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if c[b[k:k + n]] > 1:
                m[k:k + n] = b"\x01" * n
        out.append((i, b, m))
    return out


@pytest.mark.parametrize("shard", [2 << 20, 4000])
def test_removed_bytes(frame, shard):
    from vocabtrim.llm import suffix_dedup as Q
    rows = _repeat_cases()
    exp = collections.Counter()
    for i, b, m in _repeat_masks(rows):
        kept = bytes(x for x, y in zip(b, m) if not y)
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        exp[(i, len(b), sum(m), runs, hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter(map(tuple, Q.removed(frame(rows), shard_bytes=shard).collect())) == exp
    assert sum(k[2] for k in exp) > 10_000


def test_texts_without_repeats(frame):
    from vocabtrim.llm import suffix_dedup as Q
    rows = _repeat_cases()
    got = Q.deduplicated(frame(rows))
    assert set(got.columns) == set(frame(rows).columns)
    exp = collections.Counter()
    for i, b, m in _repeat_masks(rows):
        at = 0
        while at < len(m):  # a cut character stays whole
            end = at + 1
            while end < len(b) and (b[end] & 0xC0) == 0x80:
                end += 1
            if not all(m[at:end]):
                m[at:end] = bytes(end - at)
            at = end
        text = bytes(x for x, y in zip(b, m) if not y).decode()
        if text.strip() or not any(m):
            exp[(i, text)] += 1
    assert collections.Counter((r.doc_id, r.text or "") for r in got.collect()) == exp
    assert Q.removed(frame([])).collect() == []


def test_zones_are_shuffled_once(frame, monkeypatch):
    from vocabtrim.llm import suffix_dedup as Q
    rnd = random.Random(8)
    rows = _repeat_cases() + [(2000 + k, " ".join(f"{rnd.random()}" for _ in range(200))) for k in range(20)]
    rows += [(3000 + k, rows[0][1] + "common passage " * 40 + str(k)) for k in range(40)]
    one_by_one = Q._keyed(frame(rows, 3 * len(rows)), "doc_id").collect()
    found, roller = [], Q.Roller(7)
    for x in one_by_one:
        raw = (x.text or "").encode()
        zones = Q.zones_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 400, 64, roller)
        if zones:
            found += [(x._id, x._th, int(w), int(n), int(a), int(z)) for _, w, n, a, z in zip(*zones)]
    met, kinds = collections.Counter(z[4:] for z in found), collections.defaultdict(dict)
    for z in found:
        kinds[z[4]][z[5]] = z[3]
    twice = collections.Counter(z[:4] for z in found if met[z[4:]] > 1)
    leads = {(a, z, of[z], met[a, z], sum(of.values()) + 400 * len(of)) for a, of in kinds.items() for z in of
             if len(of) > 1 and any(met[a, k] == 1 for k in of)}
    saved = []

    def written(df, name, write=Q.written):
        plan = df._jdf.queryExecution().executedPlan().toString()
        saved.append((name, plan.count("Exchange hashpartitioning"), out := write(df, name)))
        return out
    monkeypatch.setattr(Q, "written", written)
    Q.removed(frame(rows)).collect()
    (name, shuffles, out), = [x for x in saved if x[0].startswith("zone")]
    got = out.collect()
    assert shuffles == 1 and 0 < len(got) < len(found)
    assert collections.Counter((r._id, r._th, r.first, r.n) for r in got if r.met > 1) == twice
    signless = lambda v: v % 2 ** 64
    assert sorted((signless(r.anchor), signless(r.zone), r.n, r.met, r.bytes) for r in got if r.lead) == sorted(leads)
    # equal zones of a batch go on as one row of their anchor
    dealt = Q.zones(Q._keyed(frame(rows, 1), "doc_id"), 400, 64).collect()
    assert max(collections.Counter((r.more, r.anchor, r.zone) for r in dealt).values()) == 1 < max(met.values())


def _edit(rnd, t, n):
    t = list(t)
    for _ in range(n):
        k = rnd.randrange(len(t))
        kind = rnd.randrange(3)
        if kind == 0:
            t[k] = "q"
        elif kind == 1:
            t.insert(k, "z")
        else:
            del t[k]
    return "".join(t)


def _least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark, frame):
    from vocabtrim.llm import decontaminate as Q
    rnd = random.Random(5)
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor été".split()
    text = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(k, text(rnd.randint(8, 40)).capitalize() + ".") for k in range(12)] + [(50, None), (51, ""), (52, "tiny"), (53, "!")]
    rows = []
    for k in range(80):
        item = rnd.choice(items[:12])[1]
        rows.append((k, text(30) + " " + _edit(rnd, item.upper(), rnd.choice([0, 2, 4, 7, 20])) + "\n\n" + text(30)))
    rows += [(200, None), (201, ""), (202, "a tiny, thing"), (203, "tinyish"), (0, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.min_edits for r in Q.leaks(frame(rows), bench).collect()}
    again = {(r.doc_id, r.item_id): r.min_edits for r in Q.leaks(frame(rows), bench, index_bytes=300).collect()}
    exp = {}
    for i, t in rows:
        t = Q.fold_text(t)
        for k, x in items:
            for _, p in Q.probes_of(Q.fold_text(x)):
                e = Q.budget(len(p), Q.EDIT_RATE, Q.Q)
                d = _least_edits(p, t) if len(p) >= Q.Q else (0 if b" " + p + b" " in b" " + t + b" " else 99)
                if d <= e:
                    exp[(i, k)] = min(d, exp.get((i, k), 99))
    assert got == exp and again == exp
    assert {v for v in exp.values()} >= {0, 1, 2} and (202, 52) in exp and (203, 52) not in exp
    kept = {r.doc_id for r in Q.clean(frame(rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in exp}
    assert Q.leaks(frame([]), bench).collect() == []
    assert Q.leaks(frame(rows), bench.limit(0)).collect() == []


def test_frequent_grams_are_counted_in_bounded_parts(monkeypatch):
    import tracemalloc

    from vocabtrim.llm import decontaminate as Q
    from vocabtrim.llm.common import Roller
    rnd = random.Random(8)
    items = [(k, " ".join(rnd.choices(["0 1 0 1 0 1", "7"], [9, 1], k=12))) for k in range(10)]
    index = Q.Index(items, Q.Q, Q.EDIT_RATE, Q.PROBE)

    def made(n):
        texts = [" ".join(rnd.choices(["0 1 0 1", "7 7", "5"], [6, 1, 1], k=n)).encode() for _ in range(3)]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    data, offs = made(20)
    whole = sorted(Q._matches(index, data, offs, Roller(10)))
    monkeypatch.setattr(Q, "HITS", 500, raising=False)
    assert sorted(Q._matches(index, data, offs, Roller(10))) == whole != []
    monkeypatch.undo()

    index.bound += 10 ** 6  # no band reaches it: only the counting takes memory
    data, offs = made(3000)
    tracemalloc.start()
    Q._matches(index, data, offs, Roller(10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def _python_steps(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("ArrowEvalPython"), plan.count("MapInArrow")


def test_rows_go_through_python_once(spark, frame):
    from vocabtrim.llm import decontaminate, suffix_dedup
    rnd = random.Random(4)
    shared = "".join(rnd.choices("abcdef ", k=500))
    rows = [(k, "".join(rnd.choices("abcdef ", k=300)) + shared) for k in range(4)] + [(9, None), (10, shared)]
    bench = spark.createDataFrame([(1, shared[:90])], "item_id long, text string")
    # the texts of the rows are cut by one function, once; the other step makes the runs
    cut = suffix_dedup.deduplicated(frame(rows), length=400)
    assert _python_steps(cut)[0] == 1
    assert {r.doc_id for r in cut.collect()} == {0, 1, 2, 3, 9}
    # rows are judged by their texts alone
    kept = decontaminate.clean(frame(rows), bench)
    assert _python_steps(kept) == (1, 0)
    assert [r.doc_id for r in kept.collect()] == [9]
