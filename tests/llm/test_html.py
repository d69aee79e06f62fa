import json
import random
import time

from presswork.llm import html
from tests.llm.helpers import ODD, prose


def page(rng, article, host="h"):
    nav = "".join(f"<li><a href='/{k}'>{prose(rng, 1)}</a>" for k in range(5))
    body = "".join(f"<p>{p}" for p in article)
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>Site {host}</header><nav><ul>{nav}</ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><div id=content><div class=story><h1>{article[0]}</h1>{body}<div>Share this story with friends</div></div>"
        f"<div class='comments'><p>first!</div><aside>Related</aside></div><form><input><button>Go</button></form><footer>&copy; {host}</footer>"
    )


def test_wrapper_and_furniture(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(24):
        article = [prose(rng, 12) for _ in range(rng.randrange(2, 7))]
        rows.append((k, f"http://host{k % 2}.example/p{k}", page(rng, article, f"host{k % 2}")))
        want[k] = " ".join([article[0], *article])
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_odd_pages(spark):
    rows = [(k, None if k % 2 else "no url", t) for k, t in enumerate(ODD)]
    rows += [(50, "http://a/", "<article>a &amp; b\n\tc<br>d<p>e</article>"), (51, "http://b/", "<p>x<div"), (52, "http://c/", "<" * 300), (53, "http://d/", "<div>" * 3000 + "deep"), (None, "http://a/", None)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame([*rows, rows[3]], "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert got[50] == "a & b c d e" and got[51] == "x" and got[0] == "" and got[None] == "" and got[53] == "deep"
    assert html.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_tree_matching():
    a, b = html.parse("<div><p>1<p>2<ul><li>x<li>y</ul></div>"), html.parse("<div><p>1<ul><li>x<li>z<li>w</ul><p>3</div>")
    assert html.matching(a, a, {}) == 7
    assert html.matching(a, b, {}) == html.matching(b, a, {}) == 6
    deep = html.tree(json.loads(html.skeleton(html.parse("<div>" * 5000 + "x"))))
    assert html.matching(deep, deep, {}) == 5001


def test_copies_on_one_host(spark):
    """Copies of one page teach no template, alone on a host or as its largest group."""
    rng = random.Random(5)
    article = [prose(rng, 12) for _ in range(4)]
    want = " ".join([article[0], *article])
    alone = page(rng, article).replace("<div>Share this story with friends</div>", "")
    rows = [(k, f"http://copies.example/{k}", alone) for k in range(9)]
    others = {100 + k: [prose(rng, 12) for _ in range(4)] for k in range(6)}
    rows += [(20 + k, f"http://hot.example/{k}", page(random.Random(1), article)) for k in range(30)]
    rows += [(k, f"http://hot.example/{k}", page(rng, a)) for k, a in others.items()]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {got[k] for k in range(9)} == {want} and {got[20 + k] for k in range(30)} == {want}
    assert all(got[k] == " ".join([a[0], *a]) for k, a in others.items())


def test_all_varying_blocks(spark):
    """Title, introduction and both bodies come back, with or without other pages of the host."""
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(7):
        title, intro, cells, more = prose(rng, 4), prose(rng, 12), prose(rng, 150), prose(rng, 150)
        source = f"<body><h1>{title}</h1><div>All our stories</div><div class=intro>{intro}</div><table><tr><td>{cells}</table><div class=body>{cells}</div><div class=body>{more}</div>"
        rows.append((k, "http://lone.example/" if k == 6 else f"http://many.example/{k}", source))
        want[k] = " ".join([title, *(["All our stories"] if k == 6 else []), intro, cells, cells, more])
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_evidence_of_all_pages(spark):
    """A rare layout of a large host, and hosts of two pages, teach their template too."""
    rng = random.Random(7)
    rows, want = [], {}

    def add(k, host, before, after):
        body = [prose(rng, 30) for _ in range(rng.randrange(2, 5))]
        rows.append((k, host, before + "".join(f"<p>{x}</p>" for x in body) + after))
        want[k] = " ".join(body)

    for k in range(120):
        add(k, "http://big.example/", f"<main class='page p{k}'><div class=lead>Our city paper</div>", "</main>")
    for k in range(200, 206):
        add(k, "http://big.example/", "<center><section class=blogpost><div class=by>Written by our readers</div>", "<div class=end>Write to us</div></section></center>")
    for k in range(300, 302):
        add(k, "http://two.example/", "<div>Tell your friends</div>", "")
    near = [prose(rng, 30) for _ in range(5)]
    for k in range(400, 402):
        text = [*near, f"edition {k}"]
        rows.append((k, "http://near.example/", "".join(f"<p>{x}</p>" for x in text)))
        want[k] = " ".join(text)
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {k for k in want if got[k] != want[k]} == set()


def test_layouts():
    a, b, c = (html.skeleton(html.parse(x)) for x in ("<div class='x x9'><p>1<p>2<ul><li>3</ul></div>", "<div class=x><p>1<b>2</b></div>", "<main><section><p>1</section></main>"))
    assert html.layouts([a, b, c, b]) == [0, 0, 1, 0]


def test_deep_and_wide_pages():
    """Furniture counts at any depth; end tags close the element they name; wide pages fold in bounded time."""
    deep = "<div>" * 400 + "in<nav>MENU</nav><p>one</p></div>two" + "</div>" * 399 + "<p>three"
    assert html.extract(deep, None) == "in one two three"
    assert html.extract("<p>a</div></div></section>b<div>c", None) == "ab c"
    rows = "".join(f"<tr>{'<td>x' * (k % 40)}{'<th>y' * (k % 7)}" for k in range(1500))
    a, b = (html.skeleton(html.parse(f"<table class=t>{r}</table><p>{x}")) for r, x in ((rows, "1"), (rows[5000:], "2")))
    began = time.time()
    assert html.layouts([a, b]) == [0, 0]
    assert time.time() - began < 5


def test_neutral_names(spark):
    """Menus without telling tags or names: only constant against varying nodes tells them from text."""
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(60):
        host = k % 5
        body = [prose(rng, 25) for _ in range(3)]
        menu = "".join(f"<div class=b{host}>Section {x} of paper {host}</div>" for x in "abcd")
        source = f"<div class=a{host}>{menu}</div><div class=c><h2>{body[0]}</h2>{''.join(f'<p>{x}' for x in body)}</div><div class=z>Printed in town {host}</div>"
        rows.append((k, f"http://n{host}.example/{k}", source))
        want[k] = " ".join([body[0], *body])
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want
    assert sum(html.extract(s, None) == want[k] for k, _, s in rows) == 0  # without the wrapper every page is wrong


def test_many_layouts_of_a_host(spark, monkeypatch):
    """Skeletons beyond the leaders, in several groups, still have a layout and the host as evidence."""
    monkeypatch.setattr(html, "LEADERS", 2)
    monkeypatch.setattr(html, "DEALT", 3)
    rng = random.Random(9)
    rows, want = [], {}
    for kind in range(8):
        for k in range(5):
            body = [prose(rng, 20) for _ in range(2)]
            name = "abcdefgh"[kind]
            head = f"<section class={name}><div class={name}1>Part of {name}</div><div class={name}2>By our readers</div>"
            rows.append((10 * kind + k, "http://hot.example/", head + "".join(f"<div class={name}3><p>{x}</p></div>" for x in body)))
            want[10 * kind + k] = " ".join(body)
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_layouts_beyond_the_leaders(spark, monkeypatch):
    """Layouts that no common skeleton stands for still gather their pages: as the search through all skeletons in order."""
    monkeypatch.setattr(html, "LEADERS", 2)
    monkeypatch.setattr(html, "DEALT", 3)
    rng = random.Random(10)
    pages = []
    for kind in "abcdefg":
        for _ in range(6):
            parts = [f"<div class={kind}{x}><p>t</div>" for x in "pqrstuvwxy" if rng.random() < 0.85]
            pages += [f"<section class={kind}>{''.join(parts)}</section>"] * rng.randint(1, 3)
    made = [(f"h{k % 2}", html.skeleton(html.parse(x))) for k, x in enumerate(sorted(pages))]
    shapes = spark.createDataFrame(made, "host string, skeleton string").groupBy("host", "skeleton").count()
    shapes = shapes.select("host", html.F.xxhash64("skeleton").alias("shape"), "skeleton", html.F.col("count").alias("n"))
    want = set()
    rows = shapes.collect()
    for host in ("h0", "h1"):
        own = sorted((r for r in rows if r["host"] == host), key=lambda r: (-r["n"], r["skeleton"]))
        found = html.layouts([r["skeleton"] for r in own])
        want |= {(host, frozenset(r["shape"] for r, x in zip(own, found, strict=True) if x == k)) for k in set(found)}
    assert len(want) > 8
    levels, _ = html.levels_of(shapes)
    got: dict = {}
    for r in levels.collect():
        assert r["levels"][0] == -1
        got.setdefault((r["host"], r["levels"][1]), set()).add(r["shape"])
    assert {(host, frozenset(x)) for (host, _), x in got.items()} == want
