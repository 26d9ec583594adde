"""Page extraction: markup, alignment and the query."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from replisift.llm import html_extract as X


def text(html, neighbour=None):
    return X.main_text(X.page_lines(html), neighbour)


def test_zones():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></ul></nav>"
        "<!-- <article>no</article> --><div class=\"ad\">Buy</div><header>Site</header><article><h1>Head &amp;&nbsp;line</h1><p><b>One\n two.<br><p>Three<br>four &lt;x&gt;</p>"
        "<aside>side</aside><form>f<input></form><div class='comments'><p>me too</div><p title=\"a>b\">Last</article><footer>&copy; f</footer></body></html>"
    )
    assert text(page) == "Head & line\nOne two.\nThree four <x>\nLast"
    assert text("") == "" and text("plain &amp; simple") == "plain & simple" and text("<p>a<p>b</div>c<") == "a\nbc<"
    assert text("<article><header><h2>H</h2><span>by me</span></header>body</article>") == "H\nbody"
    assert text("<div id='cookieNotice'>c</div><div><p>x</p>y</div>") == "x\ny"
    assert text("<article>a<script>x</article>") == "a"
    assert text("<main><p>list</p><article><header><h1>T</h1><p>by</p></header>x</article><div class='related'>r</div></main>") == "T\nx"
    assert text("<p>out</p><main><header><h1>T</h1><p>by</p></header><p>x</p><aside>s</aside></main>") == "T\nx"


def test_named_wrappers():
    for name in ("no-sidebar", "with-menu", "share-page", "with-header"):
        assert text(f"<div class='{name}'><p>out</p><article><p>a</p><div class='ad'>Buy</div></article></div>") == "a"
        assert text(f"<div id='{name}'><main><p>m</p><div class='related'>r</div></main></div><div class='{name}'>x</div>") == "m"
        assert text(f"<div class='{name}'>x</div><p>y</p>") == "y"
    assert text("<div class='share-page'><div class='related'><article>teaser</article></div><article>a</article></div>") == "a"
    assert text("<main><div class='no-sidebar'><article>a</article></div></main>") == "a"
    assert text("<article>a</article><div class='related'><article>teaser</article></div>") == "a"
    assert text("<main><p>m</p><div class='related'>r</div></main>") == "m"
    assert text("<main><h1>m</h1><div class='with-menu'><article>a</article></div></main>") == "m\na"
    assert text("<html><head><title>T</title><meta charset=utf-8><body><article>a</article>") == "a"
    assert text("<head><link rel=x><p>x</p>") == "x"


def test_differencing():
    a = X.page_lines("<p>Site name</p><p>Story one</p><p>Imprint</p>")
    assert X.main_text(a, ["Site name", "Other", "Imprint"]) == "Story one"
    b = X.page_lines("<p>Site name</p><article><p>Quote</p></article>")
    assert X.main_text(b, ["Site name", "Quote"]) == "Quote"


def test_differencing_around_an_article():
    lines = X.page_lines("<p>Site name</p><h1>Headline</h1><main><p>Lead</p><article><p>Quote</p></article><p>More</p></main><nav>Menu</nav><p>Imprint</p>")
    assert X.main_text(lines, ["Site name", "Other", "Quote", "Imprint"]) == "Headline\nLead\nQuote\nMore"
    assert X.main_text(lines, None) == "Quote"
    lines = X.page_lines("<p>Site name</p><h1>Headline</h1><main><p>Quote</p></main><p>Imprint</p>")
    assert X.main_text(lines, ["Site name", "Quote", "Imprint"]) == "Headline\nQuote"


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=24), st.lists(st.integers(0, 4), max_size=24), st.sampled_from([1, 40, 1 << 20]))
def test_alignment(a, b, limit):
    got = X.shared_lines(a, b, limit)
    assert len(got) == longest(a, b)
    rest = iter(b)
    assert all(a[k] in rest for k in sorted(got))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<article>", "</article>", "<b", ">", "<div class=ad>", "</div>", "x", "&amp;", "<script>", "</script>", "<!--", "-->", "'", '"', "<br>", "<td>"]), max_size=25))
def test_any_markup(parts):
    X.page_lines("".join(parts))


def test_pages(spark):
    page = "<p>Menu</p><p>{}</p><p>Foot</p>"
    rows = [
        (1, "http://a.example/x/1", page.format("one")),
        (2, "http://A.example/x/2?q=1", page.format("two")),
        (2, "http://A.example/x/2?q=1", page.format("two")),
        (3, "http://b.example/", page.format("alone")),
        (4, None, page.format("lost")),
        (5, "http://a.example/x/3", None),
        (None, "http://b.example/z", "<article>art</article>"),
        (6, "http://c.example/z", "<p>x</p>" * 30000),
        (7, "http://c.example/z1", "<p>x</p>" * 30000 + "<p>y</p>"),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = X.extract_pages(df.repartition(3)).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = {(r.page_id, r.text) for r in got}
    assert {(1, "one"), (4, "Menu\nlost\nFoot"), (5, ""), (None, "art"), (6, ""), (7, "y")} <= by
    assert (3, "Menu\nalone\nFoot") in by
    assert all(r.n_chars == len(r.text) for r in got)
    again = X.extract_pages(df.repartition(1)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert X.extract_pages(df.limit(0)).count() == 0


def test_large_hosts_keep_the_nearest_page(spark, monkeypatch):
    rows = [(k, f"http://big.example/s{k // 6:02}/p{k:03}", "" if k % 17 == 0 else f"<p>Site</p><p>Section {k // 6}</p><p>Text {k}</p>") for k in range(300)]
    rows += [(None, None, f"<p>Site</p><p>Lost {k}</p>") for k in range(60)] + [(7, "http://big.example/s01/p007", rows[7][2])] * 5
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = Counter(map(tuple, X.extract_pages(df).collect()))
    monkeypatch.setattr(X, "GROUP", 20)
    assert Counter(map(tuple, X.extract_pages(df).collect())) == whole
    assert whole[(8, "http://big.example/s01/p008", "Text 8", 6)] == 1
    assert sum(n for r, n in whole.items() if r[0] is not None and "Section" in r[2]) == 49  # the first of each section but the first


def test_markup_that_never_closes_is_linear():
    import time

    n = 60_000
    began = time.time()
    for page in (
        '<a "' * n, "<a '" * n, '<a "x" ' * n + "'", "<a 'x\" " * n, "<a<a" * n, "<!" * n, "<!--" * n, "</" * n, "<a b=\"c'd\" " * n + '"', "<p>" + "<b>" * 3000 + "</i>" * n, "<a x='" + '<b y="z" ' * n,
    ):
        list(X.tags(page))
        X.page_lines(page)
    assert time.time() - began < 30


def test_tags_of_random_markup():
    """Against one expression that tries everything, where names hold no quotes."""
    import random
    import re

    token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    rng = random.Random(4)
    for _ in range(30_000):
        page = "".join(rng.choice(['<a ', "<b>", "</p ", '"', "'", ">", "x", " ", "<!", "-->", "<!--", "/", "=", "<"]) for _ in range(rng.randrange(14)))
        want = [(m.start(), m.end(), bool(m[1]), m[2], m[3] if m[2] else "") for m in token.finditer(page)]
        if any(w[3] and set("\"'<") & set(w[3]) for w in want) or re.search(r"<[a-z/][^\s/>]*[\"'<]", page):
            continue
        assert list(X.tags(page)) == want, page
