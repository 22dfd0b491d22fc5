from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.llm.cases import SCHEMA, corpus, words
from turnflow.llm import cotraining as C
from turnflow.llm import decontam as D
from turnflow.llm import html_text as H
from turnflow.llm import mixing as M
from turnflow.llm import quality_rules as Q
from turnflow.llm import queries
from turnflow.llm import sharding as S
from turnflow.llm import toxicity as T
from turnflow.llm import urls as U


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(queries.ORACLES[name]).df())


# 4


def fill(sizes, weights, budget, epochs):
    """Clamp, hand the rest on, again."""
    target = [0.0] * len(sizes)
    left, open_ = budget * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > epochs * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
            open_.discard(i)
        left -= sum(target[i] for i in over)
    return target


def test_mix(spark):
    rows = corpus(60)
    got = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and "score" in got[0].asDict()
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in names]
    want = dict(zip(names, fill(sizes, [3, 1, 2][: len(names)], 1.5, 2), strict=True))
    for s, size in zip(names, sizes, strict=True):
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size and math.isclose(r.target, want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = M.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    mixed = M.mixed_documents(spark.createDataFrame(rows, SCHEMA))
    assert mixed.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: math.floor(r.taken / r.size + 0.5) for r in got if r.size and r.taken / r.size >= 0.5})


def test_mix_odd_tables(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "", "a"), (2, None, None), (None, "x y", "b"), (3, "x", "b"), (3, "x", "b")]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r.taken for r in got) == 6 and all(r.taken <= 2 * r.size for r in got)
    assert all(r.taken == 0 for r in M.mix(spark.createDataFrame(rows[:2], "doc_id long, text string, source string")).collect())


# 5


def test_shards(spark):
    rows = corpus(60)
    df = spark.createDataFrame([*rows, rows[0], (None, "x", None, None, 1, None, None, None, None)], SCHEMA)
    leaves = S.tree(24)
    got = S.shard(df, leaves).collect()
    assert len(got) == len(rows) + 2
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert S.shard(spark.createDataFrame([], SCHEMA), leaves).count() == 0


def brute_place(key, leaves, seed=S.SEED):
    node = ""
    under = S._children(leaves)
    for _ in range(3):
        u = lambda n: (int(hashlib.md5(f"{seed}|{key}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: E731, B023
        node = min((-math.log(u(n)) / w, n) for n, w in under[node].items())[1]
    return int(node)


def test_tree(spark):
    leaves = S.tree(24)
    leaves[3] = (*leaves[3][:3], 4.0)
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    lighter = [*leaves[:5], (*leaves[5][:3], 0.5), *leaves[6:]]
    got = ids.select("doc_id", S.place(ids.doc_id, leaves).alias("a"), S.place(ids.doc_id, S.grown(leaves)).alias("b"), S.place(ids.doc_id, lighter).alias("c")).collect()
    assert all(r.a == brute_place(r.doc_id, leaves) for r in got[:300])
    assert {r.b for r in got if r.a != r.b} == {24}
    assert 0 < sum(r.a != r.b for r in got) < 3000 * 3 / 28
    region = lambda k: k // 12
    n = Counter(r.a for r in got)
    assert max(n, key=n.get) == 3 and len(n) == 24
    # less weight in one shard: rows leave its region, or its rack, or the shard, and none enter it
    assert all(r.c != 5 and region(r.a) == 0 for r in got if r.a != r.c)


def test_shard_query(spark, sf_dir, duck):
    got = queries.QUERIES["op5_sharding"](spark, sf_dir).collect()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.shard == brute_place(r.doc_id, S.tree(24)) and r.grown_shard in (r.shard, 24)


# 9


def test_leaks(spark):
    r = np.random.default_rng(0)
    item = [" ".join(f"b{i}_{j}" for j in range(n)) for i, n in enumerate((5, 6, 12, 40))]
    filler = lambda n: " ".join(f"f{x}" for x in r.integers(0, 10**6, n))
    cut = item[3].split(" ")
    cut[20] = "other"
    docs = [(1, f"{filler(3000)} {item[0]} {filler(10)}"), (2, f"{item[2].upper()}\n{item[3]}"), (3, filler(50)), (4, " ".join(cut)), (5, " ".join(item[3].split(" ")[:20])), (6, None), (7, ""), (None, item[1]), (2, filler(5)), (8, "b0_0 b0_1 b0_2"), (9, f"{filler(40)} TOO  few\nwords {filler(3)} too few words"), (10, "too few other words")]
    bench = [*enumerate(item), (9, None), (10, "too few words"), (None, ""), (11, "b3_0")]
    got = D.leaks(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, _h int, item_id string"), spark.createDataFrame(bench, "item_id long, text string"))
    want = []
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [words((t or "").lower())] for i in range(len(w) - n + 1)}
    for d, t in docs:
        for i, b in bench:
            width = min(5, len(words(b or "")))
            n = len(grams(b, width)) if width else 0
            k = len(grams(b, width) & grams(t, width)) if width else 0
            if n and k / n >= 0.8:
                want.append((d, i, k, n))
    assert {(9, 10), (2, 11)} <= {(d, i) for d, i, *_ in want}
    assert sorted(((x.doc_id or -1, x.item_id, x.n_shared, x.n_item) for x in got.collect())) == sorted((d or -1, *x) for d, *x in want)
    kept = D.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d, _ in docs if d and d not in {w[0] for w in want})
    # the same by shuffles
    far = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), broadcast_rows=0)
    assert far.count() == len(want)
    assert D.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    assert D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_long_items_in_sketches(spark):
    """Items of each size class are found whole and in part, in short and long documents, though their sketches keep only some shingles."""
    r = np.random.default_rng(7)
    filler = lambda n: [f"f{x}" for x in r.integers(0, 10**6, n)]
    items = {i: [f"b{i}_{j}" for j in range(n)] for i, n in enumerate([40, 60, 100, 200, 700] * 4)}
    docs = []
    for i, item in items.items():
        for k, (around, part) in enumerate([(0, 1.0), (30, 1.0), (4000, 1.0), (4000, 0.87), (300, 0.87), (300, 0.7)]):
            docs.append((100 * i + k, " ".join([*filler(around), *item[: int(len(item) * part)], *filler(around)])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = {(100 * i + k, i) for i, w in items.items() for k, part in enumerate((1.0, 1.0, 1.0, 0.87, 0.87, 0.7)) if (int(len(w) * part) - 4) / (len(w) - 4) >= 0.8}
    assert {(x.doc_id, x.item_id) for x in D.leaks(*frames).collect()} == want and len(want) >= 90
    assert [D.boost_for(n) for n in (1, 8, 16, 29, 78)] == sorted([D.boost_for(n) for n in (1, 8, 16, 29, 78)], reverse=True) and D.boost_for(29) < D.ALL and D.boost_for(1) == D.ALL
    hashed = D.hashed_shingles(frames[0], "text", 5, "h")
    kept = {b: D.sketch(hashed, "h", "s", b).select(F.sum(F.size("s")), F.sum(F.size("h"))).first() for b in range(5)}
    assert [kept[b][0] for b in range(5)] == sorted(kept[b][0] for b in range(5)) and kept[0][0] < 0.8 * kept[0][1] and kept[4][0] == kept[4][1]
    mixed = frames[1].unionByName(spark.createDataFrame([(99, "f1 f2 f3 f4 f5")], "item_id long, text string"))  # a short item beside them: the long ones keep their sketches
    index = D.hashed_shingles(mixed, "text", 5, "_h").select(F.size("_h").alias("_q"))
    boosts = D.item_boosts(index, 0.8, D.MISS)
    assert boosts[0] == D.ALL and boosts[5] < D.ALL and boosts[9] == 0
    assert {(x.doc_id, x.item_id) for x in D.leaks(frames[0], mixed).collect()} == want


# 2


def test_counts(spark):
    rows = [*corpus(40), (900, "a b c a b c x\n \nline\nline\nline  \n#|<> é", "en", "s", 1, "", "", "", 1)]
    got = {r.doc_id: r for r in Q.word_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        win = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {j for k in range(len(w) - 2) if win[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert g.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (g.base_failed and g.kept)
    assert Q.word_quality(spark.createDataFrame([], SCHEMA)).count() == 0


# 3

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="page">
<header>Top <a href=/>Home</a></header><nav><ul><li><a href="a">One</a><li><a href="b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="main"><article><h1>Title &amp;  more</h1>
<p>First <b>bold</b>
 text&nbsp;here &lt;tag&gt; and some more words to make it long enough.<p>Second <a href=x>link</a> paragraph<br>goes on and on with many words.</p>
<div class="ad">Buy!</div><script>var t="</p>";</script><ul><li>an item that is text</li><li>another</li></ul></article>
<aside>Side</aside><form><input value=x>Send</form><section class="comments"><p>Great post by a reader with a long opinion on it</p></section></div>
<footer>&copy; x</footer></body></html>"""


def test_page():
    assert H.extract(PAGE) == "Title & more\nFirst bold text here <tag> and some more words to make it long enough.\nSecond link paragraph goes on and on with many words.\nan item that is text\nanother"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<body><article>Only</article><footer>x</footer>", "Only"),
        ("<article><section><p>one two three</p><p>four five</p></section><section><h2>six</h2><p>seven</p></section></article>", "one two three\nfour five\nsix\nseven"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>a < b</p>", "a < b"), ("<!-- x --><p>c<!-- <p>d</p> --></p>", "c"),
    ],
)
def test_pages(page, text):
    assert H.extract(page) == text


P1, P2, P3 = ("The first paragraph of the story tells at some length what has happened and who was there to see it.", "A second one goes on about it and adds what was said on the next day, in words that fill a line or two.", "The third, last one ends the story with a remark that nobody there would have expected to hear that day.")
STORY = f"<h2>A heading</h2><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
LINKS = '<div><a href="/a">News</a> <a href="/b">Sport</a> <a href="/c">Weather</a></div>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # one wrapper around a link bar, a story and a copyright line
        (f"<body><div class=wrapper>{LINKS}<div>{STORY}</div><div>Copyright 2020 The Paper</div></div></body>", f"A heading\n{P1}\n{P2}\n{P3}"),
        # a title beside the densest block
        (f"<body><div>{LINKS}<div><h1>Title</h1><div>{STORY}</div></div><p>(c) us</p></div></body>", f"Title\nA heading\n{P1}\n{P2}\n{P3}"),
        # a class is no reason to drop what has most of the text, the main heading, a heading or a paragraph
        (f'<body><div class="social sciences"><p>{P1}</p><p>{P2}</p></div><div>(c)</div></body>', f"{P1}\n{P2}"),
        (f'<article><h1 class="post-header">Title</h1><p class="search">{P1}</p><p>{P2}</p></article>', f"Title\n{P1}\n{P2}"),
        (f'<article><header class="post-header"><h1>Title</h1></header><p>{P1}</p><p>{P2}</p></article><header>Top</header>', f"Title\n{P1}\n{P2}"),
        (f'<article><div class="entry-header"><h1>Title</h1></div><p>{P1}</p><p>{P2}</p><div class="ad-box">Buy</div></article>', f"Title\n{P1}\n{P2}"),
        # sections of one story, and comments under it
        (f'<div><div><p>{P1}</p><p>{P2}</p></div><div><p>{P3}</p><p>{P1}</p></div></div><div class="comments"><p>{P2}</p></div>', f"{P1}\n{P2}\n{P3}\n{P1}"),
        (f"<p>{P1}</p><p>{P2}</p>", f"{P1}\n{P2}"),
        (f"<body><div>{'<p>' + P1 + '</p>' + '<span></span>' * 3}</div>" * 1 + f"<div>{'<p>' + P2 + '</p>'}</div></body>", f"{P1}\n{P2}"),
    ],
)
def test_core_and_path(page, text):
    assert H.extract(page) == text


def test_densities_from_the_definition():
    """Composite text density by plain recursion over the tree that the library parses."""
    r = np.random.default_rng(11)

    def make(depth):
        kids = [make(depth + 1) for _ in range(r.integers(0, 4))] if depth < 5 else []
        tag = str(r.choice(["div", "p", "a", "span", "section", "ul"])) if depth else "div"
        return f"<{tag}>" + " ".join(["word"] * int(r.integers(0, 30))) + "".join(kids) + f"</{tag}>"

    for _ in range(20):
        nodes = H.parse(f"<html><body>{make(0)}{make(1)}</body></html>")
        H._settle_marks(nodes)
        H._measure(nodes)

        def walk(x):
            """characters, tags, characters in links, links"""
            kids = [walk(p) for p in x.parts if not isinstance(p, str)]
            c = sum(len("".join(p.split())) for p in x.parts if isinstance(p, str)) + sum(k[0] for k in kids)
            t = sum(k[1] + 1 for k in kids)
            return c, t, c if x.tag == "a" else sum(k[2] for k in kids), sum(k[3] for k in kids) + (x.tag == "a")

        body = next(x for x in nodes if x.tag == "body")
        bc, _, blc, _ = walk(body)

        def density(x):
            c, t, lc, lt = walk(x)
            if not c:
                return 0.0
            t, lt = max(t, 1), max(lt, 1)
            base = math.log(max(c / max(c - lc, 1) * lc + blc / max(bc, 1) * c + math.e, math.e * (1 + 1e-9)))
            return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(base)

        want = [density(x) for x in nodes]
        assert np.allclose([x.density for x in nodes], want)
        sums = [sum(density(p) for p in x.parts if not isinstance(p, str) and p.tag != "a") if x.tag not in ("html", "body") else 0 for x in nodes]
        assert H._core(nodes) is (nodes[int(np.argmax(sums))] if max(sums) else None)


def test_very_long_page():
    assert H.extract("<body><article>" + f"<p>{P1}</p>" * 20000 + "</article></body>") == "\n".join([P1] * 20000)


@pytest.mark.parametrize(
    ("rest", "kept"),
    [
        ("<ul><li><a href=x>First reference</a></li><li><a href=y>Second</a></li></ul><p><a>one</a> <a>two</a></p>", ["First reference", "Second", "one two"]),
        (f"<section class='related work'><p>{'Others did this. ' * 5}</p></section>", ["Others did this. " * 4 + "Others did this."]),
        (f"<div class='market share'><p>{'It grew again. ' * 5}</p></div>", ["It grew again. " * 4 + "It grew again."]),
        (f"<div class='related'><p>{'Read this as well. ' * 5}</p></div><div class='share social'><p>{'Tell others of it. ' * 5}</p></div><div class='reader comments'><p>{'I think so too. ' * 5}</p></div>", []),
        ("<p>Press the <label>left</label> button</p>", ["Press the left button"]),
        (f"</article><div id='responses'><p>{'I liked it much. ' * 4}</p></div>", []),
    ],
)
def test_marks_and_links_inside_an_article(rest, kept):
    """Lists of links belong to an article that they stand in, and words with other meanings don't drop its paragraphs."""
    story = "words of the story " * 30
    assert H.extract(f"<body><article><h1>Title</h1><p>{story}</p>{rest}").split("\n") == ["Title", story.strip(), *kept]


def test_deep_and_unclosed_pages():
    """Tags that nothing opened or closed cost their own length only."""
    began = time.time()
    story = "<article><p>" + "some words " * 40 + "</p></article>"
    for page in ("<b>" * 60_000 + "</i>" * 60_000, "<span>" * 60_000 + "<li></li>" * 60_000, "<li><ul>" + "<span>" * 60_000 + "<li></li>" * 60_000, "<table><tr><td>" + "<span>" * 60_000 + "<tr></tr>" * 60_000, "<p>" + "<i>" * 60_000 + "<div></div>" * 60_000):
        assert H.extract(story + page) == ("some words " * 40).strip()
    assert time.time() - began < 60


def test_tags_close_as_the_loop_over_open_elements_would():
    """Ends and implied ends, beside a plain scan of the open elements from the innermost on."""
    r = random.Random(3)
    tags = ["p", "li", "ul", "td", "tr", "th", "table", "span", "div", "b", "dt", "dd", "option"]

    def plain(page):
        root = H.Node("html", None, False)
        nodes, stack = [root], [root]
        for close, tag in re.findall(r"<(/?)(\w+)>", page):
            closes = {tag} if close else H.CLOSES.get(tag, {"p"} if tag in H.BLOCK else ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    if close:
                        break
                elif stack[k].tag in H.SCOPE and (tag not in H.SCOPE if close else not (tag in ("tr", "td", "th") and stack[k].tag in ("td", "th"))):
                    break
                elif not closes:
                    break
            if not close:
                nodes.append(H.Node(tag, stack[-1], False))
                stack.append(nodes[-1])
        return [(x.tag, nodes.index(x.up) if x.up else None) for x in nodes]

    for _ in range(2000):
        page = "".join(f"<{r.choice(['', '', '/'])}{r.choice(tags)}>" for _ in range(r.randint(1, 25)))
        nodes = H.parse(page)
        assert [(x.tag, nodes.index(x.up) if x.up else None) for x in nodes] == plain(page), page


def test_page_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.extract_pages(df).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[1].n_chars == len(got[1].text)
    assert H.extract_pages(df.limit(0)).count() == 0


# 6


def test_urls(spark):
    urls = [
        ("http://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("ftp://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://com", "com", "", None, None), ("http://x.org?a=1/b", "x.org", "", None, None), ("nonsense", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("http://x.net/de/", "x.net", "/de/", None, None), ("http://x.net/de/", "x.net", "/de/", None, None),
    ]
    df = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert U.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in U.judge(df.filter("page_id >= 4 AND page_id < 9")).collect()} == {"allow"}


def test_trees_learn(spark):
    """Long numbered hosts are blocked, plain ones allowed; the trees carry that over to hosts without a rule."""
    rows = [(i, f"http://{'spam' + str(i * 7919) * 3 if i % 2 else 'word'}.{'bad' if i % 2 else 'good'}.com/{i % 3}") for i in range(300)]
    rows += [(1000 + i, f"http://{'spam' + str(i * 7919) * 3 if i % 2 else 'word'}.new.org/{i % 3}") for i in range(40)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), (("block", "bad.com", "/"), ("allow", "good.com", "/"))).filter("page_id >= 1000").collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 38


def test_held_out_hosts(spark, sf_dir):
    """Trees fitted on four folds of hosts judge the labelled URLs of the fifth better than the commoner verdict does."""
    pages = spark.read.parquet(f"{Path(sf_dir).parent}/sf0.1/pages.parquet").select("page_id", "url")
    got = U.held_out(pages).collect()
    right, blocked = sum((r.label == 1.0) == r.blocked for r in got), sum(r.label == 1.0 for r in got)
    assert len(got) > 200 and right > max(blocked, len(got) - blocked) + 20 and right >= 0.9 * len(got)


@pytest.mark.parametrize("by", U.COUNTED)
def test_own_labels_are_left_out(spark, by):
    """A labelled URL's statistics, from the definition: the labels of the other folds' hosts, and none in the hidden fold."""
    rows = [(f"http://h{i}.x{i % 3}.{'com' if i % 2 else 'net'}/{'es' if i % 5 else 'de'}/{i}",) for i in range(200)] + [(None,), ("http://a.org/",)]
    known = U.labelled(spark.createDataFrame(rows, "url string"), U.RULES)
    got = U.with_counts(known, U.label_counts(known, by), 0.3, by).collect()
    for r in got:
        mine = [x for x in got if x[by] == r[by] and x.label is not None and (r.label is None or x.fold != r.fold)]
        if r.label is not None and r.fold == U.HIDDEN:
            mine = []
        assert math.isclose(r[f"{by}_seen"], math.log1p(len(mine))) and math.isclose(r[f"{by}_blocked"], (sum(x.label for x in mine) + 0.6) / (len(mine) + 2))


# 7


def test_toxicity(spark):
    r = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = "muslim" if toxic or i % 16 == 1 else "christian"
        w = [f"w{x}" for x in r.integers(0, 400, 30)] + (["you", "Nasty!!"] if toxic else []) + [group]
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, "muslim w1 w2", 0.1), (1001, "NASTY w3", 0.1), (1002, "", 0.1), (1003, None, 0.1), (None, "nasty", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 0)], "doc_id long, label int")
    got = {x.doc_id: x for x in T.toxicity(df, lab).collect()}
    assert got[1001].predicted == 1 and got[1002].predicted == 0 and got[1003].score == got[1002].score
    right = sum(got[i].predicted == y for i, y in labels)
    assert right >= 395
    # the same sentence with another group
    loose = {x.doc_id: x.score for x in T.toxicity(df, lab, pairing=0.0).collect()}
    assert got[1000].score < 0.3 and got[1000].score <= loose[1000]
    assert T.toxicity(df.limit(0), lab).count() == 0
    assert {round(x.score, 6) for x in T.toxicity(df, lab.limit(0)).collect()} == {0.5}


def test_held_out_toxicity(spark, sf_dir):
    """Of the documents whose labels the query doesn't learn from, over nine tenths of the toxic ones are found and hardly another is."""
    top = f"{Path(sf_dir).parent}/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{top}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op7_toxicity"](spark, top).collect() if r.held_out and r.doc_id in truth]
    toxic = [r.predicted for r in got if truth[r.doc_id]]
    clean = [r.predicted for r in got if not truth[r.doc_id]]
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_turning_point():
    """From its definition: no other logit of the held-out rows gives a better F measure; too few labels give none."""
    r = np.random.default_rng(1)
    rows = [np.unique(np.append(r.integers(0, 30, 6), [40] if i % 4 == 0 and r.random() < 0.9 else [])).astype(np.int32) for i in range(240)]
    y = np.array([int(i % 4 == 0) for i in range(240)], np.int8)
    turn, slope = T.turning_point(y, rows, -9.0, bits=8)
    seen = np.zeros(240)
    for k in range(T.FOLDS):
        own = [i for i in range(240) if i % T.FOLDS != k]
        model = T.fit(y[own], [rows[i] for i in own], bits=8)
        for i in range(k, 240, T.FOLDS):
            seen[i] = model.weights[rows[i]].sum() + model.constant
    f = lambda t: 2 * ((seen >= t) & (y == 1)).sum() / ((seen >= t).sum() + y.sum())
    assert f(turn) == max(f(t) for t in seen)
    loss = lambda a: sum(np.log1p(np.exp(x)) - k * x for x, k in zip(a * (seen - turn) + np.log(0.7 / 0.3), y, strict=True))
    assert loss(slope) == min(loss(a) for a in np.linspace(1, 4, 61))
    assert T.turning_point(y, rows, 5.0, bits=8)[0] == 5.0 and T.turning_point(y[:40], rows[:40], -9.0, bits=8) is None


def test_counterfactual_scores(spark):
    """One group's name goes with toxicity: with the penalty two neutral sentences that differ in the name score alike."""
    r = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        name = "Muslims" if toxic else "christians"
        told = ["filthy"] if toxic and i % 3 else []
        rows.append((i, " ".join([f"w{x}" for x in r.integers(0, 400, 25)] + told + [name])))
        labels.append((i, toxic))
    probes = ["muslims", "Christians,", "jews", "MUSLIMS!"]
    rows += [(1000 + k, f"the {p} came to w1 and w2 on w3") for k, p in enumerate(probes)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    held = {x.doc_id: x.score for x in T.toxicity(df, lab).collect()}
    free = {x.doc_id: x.score for x in T.toxicity(df, lab, pairing=0.0).collect()}
    assert abs(held[1000] - held[1001]) < 0.1 and held[1000] == held[1003] and abs(held[1002] - held[1000]) < 0.1
    assert free[1000] - free[1001] > 0.5
    few = T.toxicity(df, lab, fit_features=2000)  # the bound on bytes holds whole rows in hash order
    assert few.count() == len(rows)


def test_swapped_terms_leave_all_other_features():
    def features(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return set(next(T.text_features(raw, np.array([0, len(raw)]))).tolist())

    a, b = features("some heterosexual and immigrant christians met here"), features("some lesbian and immigrant muslims met here")
    f = T.term_feature
    assert a - b == {f("heterosexual"), f("christians")} and b - a == {f("lesbian"), f("muslims")}


def test_penalty_holds_the_terms_together():
    r = np.random.default_rng(1)
    a, b = T.term_feature("muslim"), T.term_feature("christian")
    labels = np.array([1, 0] * 100)
    rows = [np.unique(np.append(r.integers(0, 1 << 20, 5), a if y else b)).astype(np.int32) for y in labels]
    gap = lambda m: abs(m.weights[a] - m.weights[b])
    assert gap(T.fit(labels, rows, pairing=50.0)) < 0.2 * gap(T.fit(labels, rows, pairing=0.0))


# 8


def test_cotraining(spark):
    r = np.random.default_rng(2)
    rows, truth = [], {}
    for i in range(600):
        good = i % 3 > 0
        w = [f"word{x}" for x in r.integers(0, 500, 60)]
        text = " ".join(w) if good else " ".join(x.upper() + "$$$" for x in w)
        rows.append((i, text, "en", "good" if good == (r.random() < 0.9) else "bad", len(text), "old"))
        truth[i] = int(good)
    rows += [(9000, None, None, None, None, None), (9001, "", None, None, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    lab = spark.createDataFrame([(i, truth[i]) for i in range(0, 600, 5)] + [(None, 1), (3, None)], "doc_id long, label int")
    got = {x.doc_id: x for x in C.quality_scores(df, lab).collect()}
    assert len(got) == 602
    assert sum(got[i].kept == bool(y) for i, y in truth.items()) >= 595
    assert C.good_documents(df, lab).columns == df.columns
    assert {x.score for x in C.quality_scores(df, lab.limit(0)).collect()} == {0.5}
    assert C.quality_scores(df.limit(0), lab).count() == 0
    assert C.good_documents(df.select("doc_id", "text"), lab).count() > 300


def test_views_teach_each_other():
    """Metadata is labelled for few rows; pseudo-labels of the text view make up for it."""
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 2000)
    t = r.normal(0, 1, (2000, len(C.TEXT)))
    t[:, 0] += 6 * y
    m = r.normal(0, 1, (2000, len(C.META)))
    m[:, 1] += 2.5 * y
    seen = np.where(np.arange(2000) < 40, y, -1)
    auc = lambda s: (np.argsort(np.argsort(s))[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    with_ = C.cotrain(t, m, seen).score(t, m)[1]
    without = C.cotrain(t, m, seen, rounds=0).score(t, m)[1]
    assert auc(with_) > auc(without)


def test_rounds_help():
    """Two views that both tell something, and few labels: the rounds make either view better, and both together no worse. A view that tells nothing
    does no harm in most tables."""

    def share_right(seed, tells, rounds):
        r = np.random.default_rng(seed)
        y = (r.random(6000) < 0.7).astype(int)
        side = np.where(y == 1, 1.0, -1.0)[:, None]
        t = np.concatenate((r.normal(0, 1, (6000, 4)) + 0.9 * side, r.normal(0, 1, (6000, 13))), axis=1)
        m = np.concatenate((r.normal(0, 1, (6000, 3)) + tells * side, r.normal(0, 1, (6000, 9))), axis=1)
        given = np.where(np.arange(3000) < 80, y[:3000], -1)
        scores = C.cotrain(t[:3000], m[:3000], given, rounds=rounds).score(t[3000:], m[3000:])
        return [float(((p >= 0.5) == y[3000:]).mean()) for p in scores]

    before, after = (np.array([share_right(seed, 1.2, rounds) for seed in range(6)]) for rounds in (0, C.ROUNDS))
    assert (after.mean(axis=0)[:2] > before.mean(axis=0)[:2] + 0.005).all() and after.mean(axis=0)[2] >= before.mean(axis=0)[2]
    before, after = (np.array([share_right(seed, 0.0, rounds) for seed in range(6)])[:, 0] for rounds in (0, C.ROUNDS))
    assert (after >= before - 0.01).sum() >= 5


def test_held_out_quality(spark, sf_dir):
    """A fifth of the labels is kept out: nearly all of its bad documents are rejected and nearly all good ones kept, and the rounds lose nothing."""
    top = f"{Path(sf_dir).parent}/sf0.1"
    docs = spark.read.parquet(f"{top}/documents.parquet")
    labels = spark.read.parquet(f"{top}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter("label IS NOT NULL")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    truth = {r.doc_id: r.label for r in labels.filter(out).collect()}
    found = []
    for rounds in (0, C.ROUNDS):
        got = [r for r in C.quality_scores(docs, labels.filter(~out), rounds=rounds).select("doc_id", "kept").collect() if r.doc_id in truth]
        bad = [not r.kept for r in got if truth[r.doc_id] == 0]
        lost = [not r.kept for r in got if truth[r.doc_id] == 1]
        found.append(sum(bad))
        assert len(bad) > 80 and sum(bad) >= 0.95 * len(bad) and sum(lost) <= 0.005 * len(lost)
    assert found[1] >= found[0]
