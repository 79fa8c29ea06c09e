from __future__ import annotations

import difflib
import itertools
import random
import time

import numpy as np

from glossa.llm import htmltree as ht
from glossa.llm.common import table as read
from tests.llm.helpers import prose, rows_of

PAGES = "page_id long, html string"


def random_tree(r: random.Random, n: int) -> ht.Tree:
    t = ht.Tree(["#root"], [-1], [0], [""], [""], [False], [0])
    for i in range(1, n):
        p = r.randrange(i)
        t.tag.append(r.choice(["p", "div", "a"]))
        t.parent.append(p)
        t.depth.append(t.depth[p] + 1)
        t.text.append(r.choice(["", "some text", "x, y."]))
        t.names.append(r.choice(["", "main body"]))
        t.lead.append(False)
        t.line.append(i)
    return t


def test_sum_product_against_enumeration():
    r, g = random.Random(1), np.random.default_rng(1)
    for _ in range(30):
        trees = [random_tree(r, r.randint(1, 7)) for _ in range(2)]
        f = ht.forest(trees)
        n = len(f.parent)
        unary, pair = g.normal(size=(n, 2)), g.normal(size=(2, 2))
        one, two = ht.sum_product(f, unary, pair)
        total, want1, want2 = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            e = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pair[y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
            total += e
            for i in range(n):
                want1[i, y[i]] += e
                if f.parent[i] >= 0:
                    want2[i, y[f.parent[i]], y[i]] += e
        assert np.allclose(one, want1 / total) and np.allclose(two, want2 / total)


def test_gradient_is_that_of_the_likelihood():
    """Marginals clamped minus free are the derivative of the log-likelihood (by finite differences)."""
    r, g = random.Random(2), np.random.default_rng(2)
    f = ht.forest([random_tree(r, 6)])
    y = np.array([-1, 1, 0, -1, 1, 0])
    w, pair = g.normal(size=ht.WIDTH) * 0.3, g.normal(size=(2, 2)) * 0.3

    def log_z(w_, pair_, clamp):
        total = 0.0
        unary = np.column_stack((np.zeros(6), f.x @ w_))
        for s in itertools.product((0, 1), repeat=6):
            if clamp and any(k >= 0 and k != v for k, v in zip(y, s, strict=True)):
                continue
            total += np.exp(sum(unary[i, s[i]] for i in range(6)) + sum(pair_[s[f.parent[i]], s[i]] for i in range(1, 6)))
        return np.log(total)

    clamp = np.zeros((6, 2))
    clamp[y == 0, 1] = clamp[y == 1, 0] = -60
    unary = np.column_stack((np.zeros(6), f.x @ w))
    free, free2 = ht.sum_product(f, unary, pair)
    held, held2 = ht.sum_product(f, unary + clamp, pair)
    grad = f.x.T @ (held[:, 1] - free[:, 1])
    for i in np.flatnonzero(f.x.any(0))[:8]:
        d = np.zeros(ht.WIDTH)
        d[i] = 1e-5
        up, down = (log_z(w + s * d, pair, True) - log_z(w + s * d, pair, False) for s in (1, -1))
        assert abs((up - down) / 2e-5 - grad[i]) < 1e-4
    e = np.zeros((2, 2))
    e[0, 1] = 1e-5
    up, down = (log_z(w, pair + s * e, True) - log_z(w, pair + s * e, False) for s in (1, -1))
    assert abs((up - down) / 2e-5 - (held2 - free2).sum(0)[0, 1]) < 1e-4


def whole(t: ht.Tree) -> list[str]:
    return [x for _, x in ht.lines(t, [i for i, x in enumerate(t.text) if x])]


def test_inline_elements_keep_the_order_of_words():
    assert whole(ht.parse("<p>Hello <b>big</b> world, <a>see</a> this.</p>")) == ["Hello big world, see this."]
    assert whole(ht.parse("<div>a<i>b</i>c <span> d</span><p>e<br/>f</p>g&nbsp;<em>h</em></div>")) == ["abc d", "e", "f", "g h"]
    assert whole(ht.parse("x<!-- no -->y<script>z</script> <b>1</b> <b>2</b><img src=a>3")) == ["xy 1 2 3"]
    t = ht.parse("<p>one <b>two</b> three</p><p>four</p>")
    assert ht.labels_of(t, "one two three")[[i for i, x in enumerate(t.text) if x]].tolist() == [1, 1, 1, 0]
    assert [x for _, x in ht.lines(t, [i for i, x in enumerate(t.text) if x in ("one", "three")])] == ["one three"]


def test_unmatched_end_tags_take_linear_time():
    began = time.perf_counter()
    ht.parse("<div>" * 100_000 + "</x>" * 100_000)
    ht.parse("<b>" * 50_000 + "</p>" * 50_000 + "</b>" * 50_000)
    assert time.perf_counter() - began < 10  # the quadratic way takes minutes


def test_parse():
    t = ht.parse("<html><head><title>T &amp; t</title><script>if (a<b) x()</script></head><body class='main-x'><p>One<br>two<p>Three <a href=x>link</a> end</div><ul><li>a<li>b</ul><!-- no --></body>")
    got = [(t.tag[p], b) for p, b in zip(t.parent, t.text, strict=True) if b]
    assert got == [("title", "T & t"), ("p", "One"), ("p", "two"), ("p", "Three"), ("a", "link"), ("p", "end"), ("li", "a"), ("li", "b")]
    assert whole(t) == ["T & t", "One", "two", "Three link end", "a", "b"]
    assert "main-x" in t.names
    for odd in ("", "<", "<<<>>>", "<p", "<!--", "<script>", "</p></p>", "<a href='x>y</a>", "plain", "<p>" * 3000 + "deep", "&#0;&bogus;"):
        ht.parse(odd)


def test_held_out_pages(spark, data):
    """Word sequences of pages that were not trained on: those extracted are the document's, and few words are missed."""
    pages = read(spark, data, "pages").toPandas()
    docs = read(spark, data, "documents").toPandas().set_index("doc_id").text
    n = pages.url.str.extract(r"/(\d+)(?:\.html)?/?(?:[?#].*)?$")[0]
    pages = pages[n.notna()].assign(doc=n.dropna().astype(int))
    pages = pages[pages.doc.isin(docs.index)]
    a, b = pages[pages.page_id % 2 == 0], pages[pages.page_id % 2 == 1]
    model = ht.fit([ht.parse(h) for h in a.html], [docs[k] for k in a.doc], ht.HtmlParams())
    text, _, _ = ht.content_of([ht.parse(h) for h in b.html], model, ht.HtmlParams())
    hit = got = want = 0
    for t, k in zip(text, b.doc, strict=True):
        x, y = t.split(), docs[k].split()  # as sequences: words out of order don't count
        hit, got, want = hit + sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()), got + len(x), want + len(y)
    assert hit / got > 0.9 and hit / want > 0.9


def test_odd_rows(spark):
    html = "<body><div class=nav><a>Home</a></div><p>" + prose(1, 40) + "</p></body>"
    rows = [(1, None), (2, ""), (3, html), (3, html), (None, html), (4, "<p>" + prose(2, 100_000)), (5, "&&& < > </"), (6, "<div>" * 5000)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as text", "'y' as content", "1 as _id")
    labelled = spark.createDataFrame([(3, prose(1, 40)), (3, prose(1, 40)), (None, "x"), (9, "x"), (1, None)], "page_id long, content string")
    got = ht.extracted(pages, labelled).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(x[0]) for x in rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].text_nodes == 0
    assert by[3].text == prose(1, 40) == by[None].text
    free = {r.page_id: r for r in ht.extracted(pages, labelled.limit(0)).collect()}
    assert free[3].text_nodes == free[3].content_nodes == 2 and len(free[4].text) == len(prose(2, 100_000))
    assert rows_of(ht.extracted(pages.limit(0), labelled)) == []
