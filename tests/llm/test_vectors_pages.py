"""Embeddings and pages against brute force, and odd rows."""

from __future__ import annotations

from leadloom.llm.common import local_labels
from leadloom.llm.extraction import Potentials, extract, extract_pages, fit
from leadloom.llm.html_pages import labelled_pages
from leadloom.llm.vectors import vector_groups, visit


def test_vectors_brute_force(spark):
    import numpy as np

    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.orderBy("vec_id").collect()
    x, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    n = np.linalg.norm(x, axis=1)
    link = (x @ x.T >= 0.93 * np.outer(n, n)) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    a, b = np.nonzero(link)
    ids = np.array([r.vec_id for r in rows])
    want = ids[local_labels(len(x), a, b)]
    got = {r.vec_id: r for r in vector_groups(v).collect()}
    found = sum(got[i].n_links for i in ids)
    assert 0.98 * link.sum() <= found <= link.sum() and all(got[i].n_links <= k for i, k in zip(ids, link.sum(1)))
    assert sum(got[i].component_id == c for i, c in zip(ids, want)) >= 0.98 * len(ids)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], None), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_groups(df).collect())
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted([(0, 0, None, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *alone])
    assert vector_groups(df.limit(0)).count() == 0


def test_multi_sequence_order():
    import numpy as np

    rng = np.random.default_rng(0)
    x, books = rng.normal(size=(50, 6)), [rng.normal(size=(5, 3)), rng.normal(size=(7, 3))]
    d = ((x[:, None, :3] - books[0]) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - books[1]) ** 2).sum(2)[:, None, :]
    assert (visit(x, books, 12) == np.argsort(d.reshape(50, -1), axis=1)[:, :12]).all()


def test_hot_cell(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.05 * rng.normal(size=8)).tolist(), 1) for i in range(3000)] + [(3000 + i, rng.normal(size=8).tolist(), 1) for i in range(200)]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    n = np.linalg.norm(x, axis=1)
    want = (x @ x.T >= 0.93 * np.outer(n, n)).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(got.values()) >= 0.98 * want.sum() and all(got[i] <= k for i, k in enumerate(want))


ARTICLE = "<h1>Big news</h1><p>First paragraph of the article, long enough to be seen as text &amp; more.</p><p>Short.</p><p>With <a href=x>a link</a> and\n more   words.<br>End</p><p>open"
TEXT = "Big news\nFirst paragraph of the article, long enough to be seen as text & more.\nShort.\nWith a link and more words. End\nopen"
AROUND = (
    '<nav><a href=1>Home</a> <a href=2>About us</a></nav>', '<header><div class="logo">Site Name</div><ul class="nav"><li><a href=1>Start</a></li></ul></header>',
    '<aside class="sidebar"><h3>Popular</h3><ul><li><a href=1>Ten things</a></li></ul></aside>', '<div class="cookie-banner">We use cookies to make this site better. Accept all of them now.</div>',
    "<footer><p>Copyright 2024 Site. All rights reserved.</p></footer>", "<form><label>Email</label><input><button>Subscribe</button></form>",
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>I really liked this article and would like to say so.</p></div></section>', '<div class="advertisement"><p>Buy our great product today and save a lot.</p></div>',
    "<script>var t='</p>';</script><style>p{margin:0}</style><!-- ad <p>x</p> -->",
)


def test_extract_unseen_pages():
    model = Potentials(fit(labelled_pages()))
    homes = ("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<div id="post">%s</div>', "<div>%s</div>", '<div class="row"><div class="col"><article class="story">%s</article></div></div>')
    for home in homes:
        for i, x in enumerate(AROUND):
            page = f"<html><head><title>T</title></head><body>{x}{AROUND[i - 1]}{home % ARTICLE}{AROUND[i - 2]}{AROUND[i - 3]}</body></html>"
            assert extract(page, model) == TEXT, (home, i)


def test_extract_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (4, "u", "<article><p>cut off <b"), (5, "u", "<p>&#65;&nbsp;b &lt;i&gt;</p>"), (6, "u", "<" * 2000), (None, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_pages(df).collect()}
    assert got[1] == ("u", "", 0) and got[2] == (None, "", 0) and got[4][1] == "cut off" and got[5][1] == "A b <i>"
    assert all(len(t) == n for _, t, n in got.values()) and len(got) == 7
    assert extract_pages(df.limit(0)).count() == 0


def test_extract_plain_articles():
    """Text straight in a div or in body, one paragraph, a form around the page, quotation marks in values, formulas."""
    model = Potentials(fit(labelled_pages()))
    around = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>home</a></li><li><a href='/a'>about us</a></li></ul></nav>%s<footer>&copy; 2024 firm, all rights</footer></body></html>"
    for n in (5, 10, 24):
        t = " ".join(["some plain words about the harbour and its boats"] * n)
        for page in (f"<div>{t}</div>", f"<div><p>{t}</p></div>", t, f"<article><p>{t}</p></article>", f"<form id='aspnetForm'><div class='content'><p>{t}</p></div></form>"):
            assert extract(around % page, model) == t, (n, page[:30])
        assert extract(around % f"<div>{t}<br><br>{t}</div>", model) == f"{t} {t}"
        assert extract(around % f"<article><h1>x</h1><p class=x title=Bob's>{t}</p></article>", model) == f"x\n{t}"
        assert extract(around % f"<article><p>{t} <math><mi>abc</mi></math></p></article>", model) == f"{t} abc"


def test_marginals_by_enumeration():
    """The two passes give the marginals that a sum over all states of all nodes gives."""
    import itertools
    import math

    from leadloom.llm.extraction import INLINE, amount, marginals, measure, order, parse

    model = Potentials(fit(labelled_pages()))
    for page in ("<div class='content'><p>some text</p><ul><li><a href=x>y</a></ul></div>", "<nav>a</nav><div>b<p>c</p></div>", "<form><p>x</p></form><article>words</article>"):
        nodes = order(parse(page))
        measure(nodes)
        marginals(nodes, model)
        at = {id(x): i for i, x in enumerate(nodes)}
        emit, total, on = [], 0.0, [0.0] * len(nodes)
        for x in nodes:
            seen = model.of(x)[0] + (model.emit.get(amount(x), 0.0) if x.tag != "#text" and x.tag not in INLINE else 0.0)
            emit.append(seen)
        for states in itertools.product((0, 1), repeat=len(nodes)):
            p = model.odds if states[0] else 1.0
            for i, x in enumerate(nodes):
                p *= math.exp(emit[i]) if states[i] else 1.0
                if x.parent is not None:
                    p *= model.of(x)[1][2 * states[at[id(x.parent)]] + states[i]]
            total += p
            for i, s in enumerate(states):
                on[i] += p * s
        assert all(abs(x.p - v / total) < 1e-9 for x, v in zip(nodes, on))


def test_vectors_of_any_size(spark):
    """Components whose squares vanish or overflow count as what they are."""
    rows = [(1, [1e-200, 0.0], 1), (2, [0.0, 1e-200], 1), (3, [1.0, 0.0], 1), (4, [1e200, 1e190], 1), (5, [5e-324, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (0, 2), 3: (3, 1), 4: (3, 1), 5: (3, 1)}
