"""The prefix trie against a plain one built by hand."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vocabtrim.llm import prefix_trie as op
from vocabtrim.llm.common import table
from vocabtrim.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        w = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += w
            leaves[p[:d]] += p not in children
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


ROWS = ([(c, i, "user" if i % 2 == 0 else None, f"hello  there {'x' * (c % 3)}" if i < 2 else f"turn {i} {c % 4}")
         for c in range(45) for i in range(c % 6 + 1)]
        + [(60 + 20 * k, i, "u", "same start") for k in range(30) for i in range(4)]      # one conversation, many times
        + [(1000, None, "u", "first"), (1000, 0, "u", None), (1000, 0, "a", "tie"), (1000, 0, "a", "tie")]
        + [(1007, 0, "u", "only")] + [(None, 1, "u", "nobody's")] + [(2001, 0, "u", "a b")]
        + [(3000, i, "u", f"long {i}") for i in range(300)] + [(3000 + k, i, "u", f"long {i}") for k in (1, 2) for i in range(250)])


def frame(spark, rows):
    df = spark.createDataFrame(list(rows), "conv_id long, turn long, role string, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("depth", "n", "part", "digest", "nth", "single", "last", "top")})


@pytest.mark.parametrize("cells", [op.MAX_CELLS, 1])
def test_against_hand(spark, cells):
    got = op.trie(op.rebuilt(frame(spark, ROWS)), max_cells=cells)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == by_hand(ROWS)


def test_full_sketch_and_rare_hot_nodes(spark, monkeypatch):
    """A sketch of few cells proves next to nothing single; parents are joined, not broadcast."""
    monkeypatch.setattr(op, "STRIPE", 8)
    monkeypatch.setattr(op, "HOT", 2)
    monkeypatch.setattr(op, "PACK", 3)
    got = op.trie(op.rebuilt(frame(spark, ROWS)), max_cells=8)
    assert Counter(map(tuple, got.collect())) == by_hand(ROWS)


def test_empty_and_turnless(spark):
    assert op.trie(op.rebuilt(frame(spark, []))).count() == 0
    # no conversation 0 to start from and fewer own turns than are left out: the root alone
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(c, 0, "u", "gone")]
    assert Counter(map(tuple, op.trie(op.rebuilt(frame(spark, rows))).collect())) == by_hand(rows)


def test_sketch_never_counts_too_low(spark):
    paths = op.paths(op.rebuilt(frame(spark, ROWS)))
    seen = Counter()
    for r in paths.collect():
        seen.update(r.digests[i:i + 16] for i in range(16, len(r.digests), 16))
    for r in op.screened(paths).collect():
        for d in range(r.single, r.n + 1):
            assert seen[bytes(r.digests[16 * d:16 * d + 16])] == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert Counter(map(tuple, QUERIES["op12_prefix_trie"](spark, sf).collect())) == by_hand(map(tuple, rows))
