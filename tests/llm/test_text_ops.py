"""Quality rules, text density, language identification, licence scan, pipeline."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

WORDS = "[^\x20\x09-\x0d]+"


def _measure(t):
    t = t or ""
    w = re.findall(WORDS, t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if re.search(WORDS, x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit), failed)


def test_quality_counts(frame):
    from vocabtrim.llm import quality_rules as Q
    rnd = random.Random(2)
    pool = ["the", "of", "Und", "é", "x|y", "###", "word", "\n", "\t", "...", "\x0b", "a", "漢字"]
    rows = [(k, " ".join(rnd.choices(pool, k=rnd.randint(0, 120)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "a a a"), (504, "a a a a"), (505, "x " * 5000), (1, rows[0][1])]
    got = Q.score(frame(rows)).collect()
    exp = collections.Counter((i, *_measure(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                                r.base_failed) for r in got) == exp
    assert all(not (r.base_failed and r.kept) and r.kept == (not r.base_failed and not r.failed_rules) for r in got)
    assert Q.score(frame([])).collect() == []
    kept = Q.kept_rows(frame(rows))
    assert kept.columns == frame(rows).columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if r.kept)


def test_quality_rules_are_one_projection(frame):
    from vocabtrim.llm import quality_rules as Q
    plan = Q.score(frame([(1, "a b c")], 1).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1  # the fixture's own


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy</div>
{body}<aside>Side</aside><form><input value=1>Send</form><div id="comments"><p>First!</p></div><footer>&copy; x</footer>"""


@pytest.mark.parametrize("body,text", [
    ("<article><h1>T &amp; U</h1><p>One   two\n three.<p><b>Four<br><p>Five</b> <a href=x>six</a>.</article>",
     "T & U\nOne two three.\nFour\nFive six."),
    ("<div><div><p>A first long paragraph of the text with words.</p><p>A second one, also rather long, of words.</p>"
     "<ul><li>item</ul></div></div>",
     "A first long paragraph of the text with words.\nA second one, also rather long, of words.\nitem"),
    ("<main><p>Short.</p><section><p>Deep one.</p></section></main>", "Short.\nDeep one."),
    ("<article><p>cut off &am", "cut off &am"), ("", "")])
def test_main_text(body, text):
    from vocabtrim.llm.html_density import main_text
    assert main_text(PAGE.format(body=body)) == text


def test_pages(spark):
    from vocabtrim.llm import html_density as Q
    rows = [(1, "u", "<p>é x</p>"), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "plain < text"),
            (5, "u", "<" * 2000), (6, "u", "<div>" * 3000 + "deep"), (7, "u", '<a href="x>y')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in Q.extract(df).collect())
    assert got[:5] == [(1, "é x", 3), (2, "", 0), (3, "", 0), (3, "", 0), (4, "plain < text", 12)]
    assert got[6] == (6, "deep", 4) and len(got) == 8
    assert Q.extract(df.limit(0)).collect() == []


LANGS = {"xx": "kra tor vim bel sun".split(), "yy": "ooe aia uue iio eau".split(), "ru": "привет мир это язык да".split()}


def test_language_of_mixed_text(spark, frame):
    from vocabtrim.llm import language_id as Q
    rnd = random.Random(4)
    text = lambda g, n: " ".join(rnd.choices(LANGS[g], k=n))
    rows = [(k, text(g, 30), g) for k, g in enumerate(list(LANGS) * 20)] + [(999, None, "xx"), (998, "a", None)]
    model = Q.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["ru", "xx", "yy"]
    a, b = text("xx", 20), text("yy", 12)
    cases = [(1, a + " " + b), (2, text("ru", 5)), (3, None), (4, ""), (5, "123 !? ++"), (6, "€ ½"), (7, text("yy", 3000)),
             (1, a + " " + b)]
    got = Q.label(frame(cases), model, spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8
    assert [by[k].lang_pred for k in range(1, 8)] == ["xx", "ru", "und", "und", "und", "und", "yy"]
    assert [(x.begin, x.end, x.lang) for x in by[1].spans] == [(0, len(a), "xx"), (len(a) + 1, len(a) + 1 + len(b), "yy")]
    assert all(0 <= r.score <= 1 for r in got) and by[3].score == 0 and by[2].score == 1
    assert Q.label(frame([]), model).collect() == []
    none = Q.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert Q.label(frame([(1, "abc")]), none).first().lang_pred == "und"


def test_viterbi_matches_exhaustive_search():
    import itertools

    import numpy as np
    from vocabtrim.llm.language_id import viterbi
    rng = np.random.default_rng(3)
    length = np.array([4, 1, 6, 3])
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    v = rng.normal(0, 2, (length.sum(), 3))
    path = viterbi(v, begin, length, 1.5)
    for b, n in zip(begin, length):
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(v[b + k, x] for k, x in enumerate(p))
                   - 1.5 * sum(x != y for x, y in zip(p, p[1:])))
        assert tuple(path[b:b + n]) == best


def test_license_scan(spark, frame):
    from vocabtrim.llm import license_scan as Q
    mit = next(t for k, t in Q.KNOWN if k == "MIT" and len(t) > 500)
    variant = "Copyright (c) 2001 Somebody\n\n" + mit.upper().replace("HOLDERS", "OWNERS").replace(",", " ;")
    rows = [(1, variant), (2, "x\nReleased under the MIT Licence!\ny\nreleased under the mit license"), (3, None), (4, ""),
            (5, "Released under the MIT License, mostly."), (6, "Licensed under CC BY-NC 4.0"),
            (6, "Licensed under CC BY-NC 4.0"), (7, "© all\n(c) x")]
    got = collections.Counter(map(tuple, Q.scan(frame(rows)).collect()))
    assert got == collections.Counter([(1, "MIT", "document", 1), (2, "MIT", "line", 2),
                                       (6, "CC-BY-NC-4.0", "document", 2), (6, "CC-BY-NC-4.0", "line", 2)])
    assert Q.scan(frame([])).collect() == []
    assert Q.scan(frame(rows), spark.createDataFrame([], "license_id string, text string")).collect() == []


def test_sql_of_the_queries(spark):
    import duckdb
    from vocabtrim.llm.queries import ORACLE, QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, sf)
        exp = con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(exp.columns)
        assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(exp.select(*cols).fetchall(), key=repr), name


def test_pipeline(spark):
    import corpus_pipeline as P
    from vocabtrim.llm import quality_rules, simhash
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.score(docs).filter("kept").collect()}
    one = P.quality(spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    two = P.near_duplicates(spark, one, sf)
    classes = {r.component_id for r in simhash.near_duplicates(one).collect()}
    assert {r.doc_id for r in two.collect()} == classes and two.count() == len(classes)
    out = P.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    assert 0 < out.select("doc_id").distinct().count() <= len(classes)


LONG = "This sentence of the article has a few more words than the notices around it do. "


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'aria-hidden="false"', 'data-hidden="1"', 'class="post no-sidebar"', 'class="has-sidebar"',
    'id="related-work"', 'id="search-algorithms"', 'class="sidebar"', "id=search title='a hidden gem'"])
def test_attributes_that_drop_no_text(attributes):
    from vocabtrim.llm.html_density import main_text
    text = "\n".join(f"{k} " + (3 * LONG).strip() for k in range(4))
    inner = "".join(f"<p>{x}</p>" for x in text.split("\n"))
    page = PAGE.format(body=f"<div {attributes}>{inner}</div>")
    assert main_text(page) == text
    assert main_text(f'<div><h2 id="search">Search</h2><p><a href="/hidden-gems">See</a> {LONG}</p></div>') \
        == "Search\nSee " + LONG.strip()


@pytest.mark.parametrize("attributes", ["hidden", 'aria-hidden="true"', 'class="x sidebar"', 'id="related-posts"',
                                        'class="main-nav"', 'role="navigation"', 'aria-label="Share"'])
def test_attributes_that_drop_noise(attributes):
    from vocabtrim.llm.html_density import main_text
    article = "".join(f"<p>{3 * LONG}</p>" for _ in range(4))
    assert "Noise" not in main_text(f"<div><div>{article}</div><div {attributes}><p>Noise and more.</p></div></div>")


def test_sibling_blocks_above_the_threshold():
    from vocabtrim.llm.html_density import main_text
    p = lambda a, b: "".join(f"<p>{k} {2 * LONG}</p>" for k in range(a, b))
    text = lambda a, b: "\n".join(f"{k} {2 * LONG}".strip() for k in range(a, b))
    menu = "<div>" + "".join(f"<div><a href=/{k}>Link {k}</a></div>" for k in range(8)) + "</div>"
    for other in ("", menu):  # with links and without
        assert main_text(PAGE.format(body=f"<div>{p(0, 3)}</div>{other}<div>{p(3, 13)}</div>")) == text(0, 13)
    # text outside of a small article is not overridden by it
    assert main_text(f"<div>{p(0, 10)}</div><article>{p(10, 22)}</article><div>{p(22, 30)}</div>") == text(0, 30)
    assert main_text(f"<main>{menu}<div>{p(0, 3)}</div><div>{p(3, 13)}</div></main>").endswith(text(0, 13))
    # bare text beside blocks
    bare = (5 * LONG).strip()
    assert main_text(f"<div>{bare}<div>{p(0, 6)}</div><b>Also</b> {bare}</div>") == f"{bare}\n{text(0, 6)}\nAlso {bare}"


def test_linked_blocks_of_the_article_stay():
    from vocabtrim.llm.html_density import main_text
    p = "".join(f"<p>{k} {2 * LONG}</p>" for k in range(6))
    text = "\n".join(f"{k} {2 * LONG}".strip() for k in range(6))
    links = [f"Reference number {k}" for k in range(5)]
    items = "".join(f"<li><a href=/r{k}>{x}</a></li>" for k, x in enumerate(links))
    cells = "".join(f"<tr><td><a href=/t{k}>{x}</a></td></tr>" for k, x in enumerate(links))
    for block in (f"<ul>{items}</ul>", f"<ol>{items}</ol>", f"<table>{cells}</table>", f"<div><ul>{items}</ul></div>"):
        assert main_text(PAGE.format(body=f"<article>{p}{block}</article>")) == "\n".join([text, *links])
    assert main_text(f"<div>{''.join(f'<div><a href=/{x}>{x}</a>.</div>' for x in links)}</div>") \
        == "\n".join(x + "." for x in links)
    assert "Home" not in main_text(f"<article>{p}<nav><a href=/>Home</a></nav><ul role=menu><li>Home</ul></article>")


def test_whole_license_texts(spark, frame):
    from vocabtrim.llm import license_scan as Q
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    first = {}
    for k, t in Q.whole_texts():
        first.setdefault(k, t)
    rows = [(i, first[k]) for i, k in enumerate(names)]
    rows += [(100 + i, re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", first[k]).upper()) for i, k in enumerate(names)]
    rows += [(200, first["Apache-2.0"].split("APPENDIX")[0]), (201, first["GPL-2.0"][:-4000])]
    bsd = open("/usr/share/common-licenses/BSD").read()
    rows += [(300, bsd), (301, next(t for k, t in Q.KNOWN if k == "BSD-2-Clause")),
             (302, bsd.replace("REGENTS", "COPYRIGHT HOLDERS", 1).replace("REGENTS", "COPYRIGHT OWNER")
              .replace("the University nor", "the copyright holder nor"))]
    got = {(r.doc_id, r.license_id) for r in Q.scan(frame(rows)).filter("unit = 'document'").collect()}
    assert got == {*enumerate(names), *((100 + i, k) for i, k in enumerate(names)), (200, "Apache-2.0"),
                   (300, "BSD-3-Clause"), (301, "BSD-2-Clause"), (302, "BSD-3-Clause")}


def test_deep_pages_take_linear_time():
    import time
    from vocabtrim.llm.html_density import main_text
    spent = []
    for depth in (4000, 40000):
        page = "<div>" * depth + f"<p>{LONG}</p>" + "</div><i></b>" * depth
        start = time.perf_counter()
        assert main_text(page) == LONG.strip()
        spent.append(time.perf_counter() - start)
    assert spent[1] < 30 * spent[0] + 1


def test_density_against_plain_counts():
    """Counts and densities of every node against recursion over the tree."""
    import math
    from vocabtrim.llm import html_density as H
    rnd = random.Random(6)

    def page(depth=0):
        if depth > 5 or rnd.random() < 0.2:
            return rnd.choice(["text ", "more words here ", "", "x"])
        tag = rnd.choice(["div", "p", "a", "span", "ul", "li", "section", "b"])
        return f"<{tag}>" + "".join(page(depth + 1) for _ in range(rnd.randint(0, 4))) + f"</{tag}>"

    def counts(n):
        kids = [k for k in n.kids if not isinstance(k, str) and not k.skip]
        below = [counts(k) for k in kids]
        chars = sum(len("".join(k.split())) for k in n.kids if isinstance(k, str)) + sum(c[0] for c in below)
        tags = sum(c[1] for c in below) + len(kids)
        links = chars if n.tag == "a" else sum(c[2] for c in below)
        return chars, tags, links, (n.tag == "a") + sum(c[3] for c in below)
    for _ in range(40):
        root = H.parse("".join(page() for _ in range(6)))
        nodes = H._nodes(root)
        H._count(nodes)
        c0 = counts(root)
        for n in nodes:
            c = counts(n)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == c
            want = 0.0
            if c[0]:
                lc, lt, t = max(1, c[2]), max(1, c[3]), max(1, c[1])
                base = math.log(c[0] / max(1, c[0] - c[2]) * c[2] + c0[2] / max(1, c0[0]) * c[0] + math.e)
                want = c[0] / t * max(0.0, math.log(c[0] * t / (lc * lt))) / math.log(1 + base)
            assert n.density == pytest.approx(want)
