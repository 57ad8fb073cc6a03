import re
import html as entities

import time

from quarry.llm.html_extract import Template, class_faults, extract, main_texts, page_tokens

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site header</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First<br>line <i>in</i>side<p>Second &lt;b&gt;</p><div class="share">Tweet</div><form>Name <input></form>
<table><tr><td>1<td>2</table><aside>Side</aside></article>
<section id="comments"><article class="comment">Great!</article></section><footer>&copy; me</footer></body></html>"""


def test_article_without_the_rest():
    assert extract(PAGE) == "Title & more First line inside Second <b> 1 2"


def test_parts_named_by_their_classes():
    page = """<body><div id="site-header">Top</div><div class="sideBar">Links</div><div class="post-content"><h2>Head</h2>Body text<div class="newsletter-signup">Mail us</div></div>
    <div class="readerComments">Nice</div><div role="contentinfo">End</div></body>"""
    assert extract(page) == "Head Body text"
    assert extract("<main>a<nav>n</nav>b</main><article>c</article>") == "a b c"
    assert extract("<div class=ad>unclosed<article>kept</article>") == "kept"
    assert extract("<p>caf&eacute; &#x41;&nbsp;&lt;x&gt;</p>") == "café A <x>"


def test_broken_markup_costs_no_more_than_its_length():
    assert extract("<article>a</article>" + "<a " * 50_000) == "a"
    assert extract("<article>a<!-- open " + "<p>" * 1000) == "a"
    assert extract("<p " * 30_000).startswith("<p <p")


def test_pages_without_an_article_element(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=top>Welcome to us</div><div class=text><p>Story number {i} is told here at some length {i * 7}.</p></div><div class=end>All rights</div></body>", "x") for i in range(12)]
    rows += [(100, None, None, ""), (101, "odd", "", ""), (102, "odd", "<p>Only this", ""), (102, "odd", "<p>Only this", ""), (103, "http://h2/", "<div " + "a" * 50_000, ""), (104, "http://h2/", "<article>" + "w " * 60_000, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for hosts in (20_000, 0):
        got = {}
        for r in main_texts(df, broadcast_hosts=hosts).collect():
            got.setdefault(r.id, []).append(r.text)
        assert all(got[i] == [f"Story number {i} is told here at some length {i * 7}."] for i in range(12))
        assert got[100] == [""] and got[101] == [""] and got[102] == ["Only this"] * 2
        assert got[104] == [" ".join(["w"] * 60_000)] and len(got[103]) == 1
    assert main_texts(df.limit(0)).count() == 0


def test_on_the_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in main_texts(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.id], re.S)[1]
        plain = entities.unescape(re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", re.sub(r"</?(?:p|br|h1|div|li|ul)\b[^>]*>", " ", inner)))
        assert r.text == " ".join(plain.split())


def test_every_slot_is_kept_and_copies_count_once(spark):
    page = "<body><div class=top>Welcome</div><div class=intro>Intro {0}</div><div class=text><p>Body {0}</p></div><section>Last {0}</section></body>"
    rows = [(i, "http://h/", page.format(i)) for i in range(6)] + [(100 + i, "http://h/", page.format("copied")) for i in range(10)]
    rows += [(200 + i, None, "<div class=a>One</div><div class=b>Two</div>") for i in range(4)]
    got = {r.id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Intro {i} Body {i} Last {i}" for i in range(6))
    assert all(got[100 + i] == "Intro copied Body copied Last copied" for i in range(10))
    assert all(got[200 + i] == "One Two" for i in range(4))


def texts(spark, rows, **options):
    return {r.id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_the_template_decides_inside_and_outside_of_articles(spark):
    # nothing here has a telling name: a constant box in the article, a constant block, a list of links; one copied paragraph stays
    page = (
        "<body><div class=kx>Hello there</div><div class=zz><a href=/a>Link {0}</a> <a href=/b>Other {1}</a></div><article><h1>T{0}</h1>"
        "<p>Story {0} has words</p><p>Said by all</p><div class=qq>Tell your friends</div><p>More {1} of it at some length</p></article><section>All rights</section></body>"
    )
    rows = [(i, f"http://h/{i}", page.format(i, i * 7)) for i in range(9)]
    for hosts in (20_000, 0):
        got = texts(spark, rows, broadcast_hosts=hosts)
        assert all(got[i] == f"T{i} Story {i} has words Said by all More {i * 7} of it at some length" for i in range(9))
    # without the template the names alone would keep the box
    assert "Tell your friends" in extract(rows[0][2])
    plain = [(i, u, h.replace("article", "div")) for i, u, h in rows]
    got = texts(spark, plain)
    assert all("Tell your friends" not in t and "Hello" not in t and "All rights" not in t and "Link" not in t and f"Story {i} has words" in t for i, t in got.items())


def test_misleading_names(spark):
    teaser = "<body><article>New {0}</article><div class=kk><p>" + "The long story {0} goes on and on. " * 20 + "</p></div></body>"
    got = texts(spark, [(i, "http://t/", teaser.format(i)) for i in range(6)])
    assert all("The long story" in t for t in got.values())
    hidden = "<body><div class=page-sidebar><p>" + "Real text {0} is here. " * 10 + "</p></div><div class=a>x{0}</div></body>"
    got = texts(spark, [(i, "http://s/", hidden.format(i)) for i in range(6)])
    assert all("Real text" in t for t in got.values()) and "Real text" not in extract(hidden.format(1))


def test_copies_and_near_copies_of_an_article_lose_nothing(spark):
    page = "<body><nav>m{0}</nav><article><h1>Title{1}</h1><section class=bd><p>One long paragraph that all of them share</p><p>Another</p></section></article></body>"
    got = texts(spark, [(i, "http://h/", page.format(i, "")) for i in range(8)] + [(100 + i, "http://n/", page.format(i, i)) for i in range(8)])
    assert all(got[i] == "Title One long paragraph that all of them share Another" for i in range(8))
    assert all(got[100 + i] == f"Title{i} One long paragraph that all of them share Another" for i in range(8))
    # pages that each occur twice don't cancel each other
    box = "<body><div class=top>Welcome</div><div class=text>Body {0}</div></body>"
    got = texts(spark, [(2 * i + k, "http://d/", box.format(i)) for i in range(5) for k in (0, 1)])
    assert all(got[2 * i + k] == f"Body {i}" for i in range(5) for k in (0, 1))


def test_classes_must_be_ordered_and_in_one_gap():
    assert class_faults([1, 5, 6, 2, 5, 6, 3], [[1, 2, 3], [5, 6], [6, 5]]) == [(0, 0, 0, 0), (1, 0, 1, 2), (2, 2, 1, 2)]
    assert class_faults([1, 5, 6, 5, 6, 2], [[1, 2], [5, 6]]) == [(0, 0, 0, 0), (1, 0, 1, 1)]
    assert class_faults([2, 1], [[1, 2], [9]]) == [(0, 1, 0, 0)]
    content, order, tokens, slots = page_tokens("<div class=a.b.c.d.e.f>x</div><div class=a.b.c.d.e.g>x</div>")
    assert len({t[0] for t in tokens}) == 4 and len(order) == 4 and len(slots) == 2  # the sixth class name counts too


def test_raw_elements_without_an_end_take_linear_time():
    began = time.time()
    assert extract("<p>a</p><script>" + "</script" * 200_000) == "a"
    assert extract("<!" * 200_000).startswith("<!")
    assert time.time() - began < 5
    assert Template(None).empty and Template("{}").empty
