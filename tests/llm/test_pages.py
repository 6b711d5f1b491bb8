"""Web pages, URL rules and vector search."""

import html
import random
import re
import time

import numpy as np
import pytest

from lumenfold.llm import op07_pages, op08_topk, op10_urls
from tests.twins import FOLDER

PAGE = "page_id long, url string, html string, text string, host string"


def text_of(page):
    return op07_pages.assemble(op07_pages.read(page)[0])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a&amp;b &copy; &am", "a&b © &am"),
        ("<body><header>Site</header><div class='cookie-notice'>We use</div><div><p>Hello <b>wor</b>ld&nbsp;x<p>Two<ul><li>a<li>b</ul><div class=\"comments\">c</div></div><footer>f</footer>", "Hello world x Two a b"),
        ("<article><h1>T</h1><p><b>x.<br><p>y</p></article><aside>z</aside>", "T x. y"),
        ("<script>var t='</p>';</script><p>in", "in"),
        ("<p title='a>b'>q</p><!-- c --><style>p{}</style>", "q"),
        ("<div class='has-sidebar'><p>kept</p></div><div class='sidebar'>gone</div>", "kept"),
        ("<main><nav>m</nav><p>x</p></main><p>out</p>", "x"),
        ("text only\n  lines", "text only lines"),
        ("<p>cut <a href='x", "cut"),
        ("<article><div class='social-science'><p>body text</p></div></article>", "body text"),
        ("<article><section class='search-theory'>a</section><p id='comment'>b</p><div class='comments'>c</div></article>", "a b"),
        ("<article><p>teaser</p></article><p>the long text of the page stands outside of it</p>", "teaser the long text of the page stands outside of it"),
        ("<b><i>x</b></i><p>y</i>z</p></table>w", "x yz w"),
        ('<article><p>a</p><div class="ad-slot">Buy</div><div class="user-comments">lol</div><section id="comment-thread">first!</section><p>b</p></article>', "a b"),
        ('<article><p>a</p><div class="advert-1">x</div><div id="cookiebar">x</div><div class="comment-42">x</div><div class="newsletter-signup-form">x</div><p>b</p></article>', "a b"),
        ('<article><div class="adaptation">a</div><div class="commentary-3">b</div><div class="post">c</div><div class="2024">d</div></article>', "a b c d"),
    ],
)
def test_reading(page, text):
    assert text_of(page) == text


def test_pages_against_plain_version(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = {r["page_id"]: r["text"] for r in op07_pages.op7_main_text(spark, FOLDER).collect()}
    for i, page in pages.items():
        inside = page.partition("<article>")[2].partition("</article>")[0]
        assert found[i] == " ".join(" ".join(html.unescape(b) for b in re.split("<[^>]*>", inside)).split())


def test_templates(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}", f"<div><div>Read our other stories</div><p>story {i} itself</p></div>" if i % 2 else f"<div><p>page {i}</p><div>Read our other stories</div></div>" if i < 6 else f"<p>page {i}</p>", "t", "h") for i in range(20)]
    found = {r["page_id"]: r["text"] for r in op07_pages.main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert found[1] == "story 1 itself"
    assert found[0] == "page 0 Read our other stories"  # on three pages of its host only
    quoted = [(i, "http://q.x/", f"<article><p>same words</p><p>{i}</p></article>", None, None) for i in range(20)]
    assert {r["text"] for r in op07_pages.main_text(spark.createDataFrame(quoted, PAGE)).collect()} == {f"same words {i}" for i in range(20)}
    copies = [(i, "http://q.x/", "<div><div>all of it</div></div>", None, None) for i in range(200)]
    assert {r["text"] for r in op07_pages.main_text(spark.createDataFrame(copies, PAGE)).collect()} == {"all of it"}  # copies count once


def test_only_templates_tell_menu_from_text(spark, monkeypatch):
    """Unlabelled blocks of sites and of their sections, against a plain count of the blocks of each host."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, blocks = [], {}
    for h, n in enumerate((400, 90, 30, 6)):
        menus = [f"<div><div>{' '.join(word() for _ in range(6))}</div><ul><li>{word()}<li>{word()}</ul></div>" for _ in range(3)]
        quotes = [f"<div>{word()} {word()}</div>" for _ in range(6)]
        for i in range(n):
            own = [menus[i % 3], f"<div>{h} {i} {word()} {word()}</div>", rng.choice(quotes) if rng.random() < 0.1 else f"<div>{word()} {i}</div>"]
            rng.shuffle(own)
            blocks[len(rows)] = own
            rows.append((len(rows), f"http://h{h}.x/{i}", "<html><body>" + "".join(own) + "</body>", None, None))
            if rng.random() < 0.2:  # a copy
                blocks[len(rows)] = own
                rows.append((len(rows), *rows[-1][1:]))
    seen = {}
    for i, url, page, *_ in rows:
        seen.setdefault(url.split("/")[2], {})[page] = blocks[i]
    expected = {}
    for i, url, *_ in rows:
        pages = seen[url.split("/")[2]].values()
        often = lambda b, pages=pages: sum(b in p for p in pages) >= max(5, len(pages) ** 0.5)
        expected[i] = " ".join(" ".join(re.sub("<[^>]*>", " ", b).split()) for b in blocks[i] if not often(b))
    df = spark.createDataFrame(rows, PAGE)
    assert {r["page_id"]: r["text"] for r in op07_pages.main_text(df).collect()} == expected
    monkeypatch.setattr(op07_pages, "BROADCAST_TEMPLATES", 0)
    assert {r["page_id"]: r["text"] for r in op07_pages.main_text(df).collect()} == expected


def test_deep_pages():
    for page in ("<div>x" * 100_000, "<b>x" * 100_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<div><b>" + "</i></p>" * 50_000, "<p><i>" * 50_000):
        began = time.process_time()
        op07_pages.read(page)
        assert time.process_time() - began < 4


def test_pages_awkward(spark):
    rows = [(1, None, None, "t", "h"), (None, "no scheme", "<p>x", "t", "h"), (2, "http://a", "", None, None), (2, "http://a", "", None, None), (3, "http://a/", "<p>" + "é " * 60_000, "t", "h")]
    found = op07_pages.main_text(spark.createDataFrame(rows, PAGE)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 119_999)]
    assert op07_pages.main_text(spark.createDataFrame([], PAGE)).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("http://xexample.com/de/", "xexample.com", "/de/", None, "allow"),
        ("http://example.com/de/#a", "example.com", "/de/", "example.com/de/", "block"),
        ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://www.cheap-pills.example.com/en/1", "www.cheap-pills.example.com", "/en/1", None, "block"),
        ("http://cheap-pills.example.net/en/1", "cheap-pills.example.net", "/en/1", "example.net/en/", "allow"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://É.net/", "É.net", "/", "net/", "block"),
        ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
        ("http://x.com/a/casino/b", "x.com", "/a/casino/b", None, "block"),
        ("http://x.com/a/mycasino/b", "x.com", "/a/mycasino/b", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    r = op10_urls.judge(spark.createDataFrame([(1, url, "h")], "page_id long, url string, verdict string")).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


@pytest.mark.parametrize("inline", [op10_urls.INLINE_RULES, 0])
def test_many_rules_against_plain_version(spark, monkeypatch, inline):
    monkeypatch.setattr(op10_urls, "INLINE_RULES", inline)
    rng = random.Random(0)
    name = lambda: rng.choice(["a", "bb", "net", "org", "x1"])
    pairs = list({(f"{name()}.{name()}", f"/{name()}/", rng.choice(["block", "allow"])) for _ in range(12)})
    pairs = list({(h, p): (h, p, v) for h, p, v in pairs}.values())
    urls = [(i, f"http://{name()}.{name()}.{name()}/{name()}/{name()}") for i in range(300)]
    found = {r["page_id"]: r["rule"] for r in op10_urls.judge(spark.createDataFrame(urls, "page_id long, url string"), pairs, ()).collect()}
    for i, url in urls:
        host, _, path = url[7:].partition("/")
        fits = [h + p for h, p, _ in pairs if f".{host}".endswith(f".{h}") and f"/{path}".startswith(p)]
        assert found[i] == max(fits, key=lambda x: (len(x), x), default=None)


@pytest.mark.parametrize("inline", [op10_urls.INLINE_RULES, 0])
def test_awkward_urls(spark, monkeypatch, inline):
    """Repeated rows, null ids, very long urls and columns with the operator's own names; alike however rules are held."""
    monkeypatch.setattr(op10_urls, "INLINE_RULES", inline)
    long = "http://a.net/" + "x/" * 200_000 + "casino/"
    rows = [(1, "http://a.net/", "p", "q", "v"), (1, "http://a.net/", "p", "q", "v"), (None, None, None, None, None), (None, long, "p", "q", "v"), (2, "http://b.com/casino/?http://c.net/", "p", "q", "v"), (3, "", "p", "q", "v")]
    found = op10_urls.judge(spark.createDataFrame(rows, "page_id long, url string, path string, place string, verdict string")).collect()
    told = sorted(((r["page_id"] or 0, len(r["path"]), r["rule"] or "", r["verdict"]) for r in found))
    assert told == [(0, 0, "", "allow"), (0, 400_008, "net/", "block"), (1, 1, "net/", "block"), (1, 1, "net/", "block"), (2, 8, "", "block"), (3, 0, "", "allow")]


def test_twenty_thousand_rules_and_more(spark):
    pairs = [(f"h{i}.example", "/", "block") for i in range(25_000)]
    urls = [(i, f"http://www.h{i}.example/x") for i in range(24_990, 25_010)]
    found = {r["page_id"]: r["verdict"] for r in op10_urls.judge(spark.createDataFrame(urls, "page_id long, url string"), pairs, ()).collect()}
    assert found == {i: "block" if i < 25_000 else "allow" for i, _ in urls}


def test_rules_need_a_token():
    with pytest.raises(ValueError):
        op10_urls.compile_rules((), ("spam*",))


def test_urls_empty(spark):
    assert op10_urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute(vectors, queries, k=10):
    width = max(len(v) for _, v in vectors)
    x = [(i, np.array([*np.floor(1024 * np.array(v)), *[0] * (width - len(v))]).astype(np.int64)) for i, v in vectors]
    out = []
    for q, v in x:
        if q in queries:
            best = sorted((-int(v @ w), i) for i, w in x if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("tree", "page"), [(2048, 64), (64, 8), (4096, 16)])
def test_top_k_against_brute_force(spark, monkeypatch, tree, page):
    monkeypatch.setattr(op08_topk, "TREE_ROWS", tree)
    monkeypatch.setattr(op08_topk, "PAGE", page)
    rng = np.random.default_rng(tree)
    good = [(i, np.round(rng.normal(size=6) * 0.01, 3).tolist()) for i in range(500)] + [(500 + i, [0.1] * 6) for i in range(200)] + [(900, [0.5])]
    bad = [(1001, None), (1002, [1.0, None]), (1003, [float("nan")] * 6), (1004, [float("inf")]), (None, [1.0])]
    df = op08_topk.integer_vectors(spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, score int"))
    found = op08_topk.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == brute(good, {i for i, _ in good if i % 100 == 0})


def test_queries_in_blocks(spark, monkeypatch):
    df = op08_topk.integer_vectors(spark.read.parquet(f"{FOLDER}/embeddings.parquet"))
    some = df.where("vec_id % 5 = 0")
    whole = op08_topk.top_k(df, some).collect()
    monkeypatch.setattr(op08_topk, "QUERY_BLOCK", 4)
    assert sorted(op08_topk.top_k(df, some).collect()) == sorted(whole)


def test_top_k_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    one = op08_topk.integer_vectors(spark.createDataFrame([(0, [1.0])], kind))
    assert op08_topk.top_k(one, one).count() == 0
    two = op08_topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [-1.0]), (7, [-1.0])], kind))
    assert sorted(tuple(r) for r in op08_topk.top_k(two, two.where("vec_id = 0")).collect()) == [(0, 1, 7, -1048576), (0, 2, 7, -1048576)]
    none = op08_topk.integer_vectors(spark.createDataFrame([], kind))
    assert op08_topk.top_k(none, none).count() == 0
