from chunklake.llm import html_text as H

PAGE = (
    '<!DOCTYPE html><html><head><title>no</title><style>p{x}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav>'
    '<!-- ad --><div class="cookie-notice">We use</div><div id="wrap"><div class="sidebar">Side</div><article class="post comments-open"><header><h1>Title &amp; more</h1><p>By me</p></header><p>First   paragraph<br>goes&nbsp;on &lt;here&gt;.'
    '<p>Second <b>bold<i> one</b> &#233;.</p><aside>Aside</aside><form><p>Mail</p><input></form><ul><li>one<li>two</ul><div class="adSlot-3">Buy</div><blockquote>Quote</blockquote></article>'
    '<section id="comments"><p>A very long reader comment that goes on and on and on and on and on and on and on.</p></section></div><footer>foot</footer></body></html>'
)
TEXT = "Title & more\n\nFirst paragraph goes on <here>.\n\nSecond bold one é.\n\none\n\ntwo\n\nQuote"


def test_main_text():
    assert H.extract(PAGE, None) == TEXT
    assert H.best_container(H.blocks_of(PAGE)).path == "#>html>body.has-sidebar>div>article.comments-open.post"


def test_odd_pages():
    assert H.extract(None, None) == H.extract("", None) == H.extract("<p>", None) == ""
    assert H.extract("plain words", None) == "plain words"
    assert H.extract("<p>a<p>b<div", None) == "a\n\nb"
    assert H.extract("<p>1 < 2 and 3 > 2</p>", None) == "1 < 2 and 3 > 2"
    assert H.extract("<script>x", None) == "" and H.extract("<!-- x", None) == ""
    assert H.extract("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"
    assert H.extract("<table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", None) == "a b\n\nc"


def test_consensus(spark):
    body = lambda inner: f"<html><body><div class='post-{len(inner)}'><p>{inner}</p></div><div class='more'><p>{'x' * 40}</p></div></body></html>"
    rows = [(k, "https://A.example/" + str(k), body("word " * 30)) for k in range(5)]
    rows += [(5, "https://a.example/5", body("tiny words here")), (6, "https://a.example/6", "<p>no such path</p>"), (7, None, None), (8, "odd", ""), (8, "odd", ""), (9, "x://b/", PAGE)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'c' AS host", "'c' AS path", "1 AS id")
    paths = {r["host"]: (r["path"], r["votes"]) for r in H.host_paths(pages).collect()}
    assert paths["a.example"] == ("#>html>body>div.post-N", 5)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.main_texts(pages).collect())
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    texts = dict((k, t) for k, t, _ in got)
    assert texts[5] == "tiny words here" and texts[6] == "no such path" and texts[7] == texts[8] == "" and texts[9] == TEXT and texts[0] == ("word " * 30).strip()
    assert H.main_texts(pages.limit(0)).count() == 0


def test_query(spark, sf_dir):
    import html
    import re

    from chunklake.llm.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op4_html_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split("</?(?:p|h1)>", re.sub("</?b>", "", article))]
        assert r["text"] == "\n\n".join(x for x in parts if x)


def test_title_and_lead_beside_the_body():
    long = "word " * 200
    for tag in ("article", "main", "div class=post", "section"):
        page = f"<body><nav>menu</nav><{tag}><h1>Title</h1><div class=lead><p>Lead text.</p></div><div class=body><p>{long}</p></div></{tag.split()[0]}><div class=other><p>other</p></div></body>"
        assert H.extract(page, None) == f"Title\n\nLead text.\n\n{long.strip()}", tag
        assert H.extract(page, H.best_container(H.blocks_of(page)).path).startswith("Title")  # a host's path loses none of it
    links = f"<body><main><div><p><a href=x>{'link ' * 9}</a></p></div><div class=body><p>{long}</p></div></main></body>"
    assert H.extract(links, None) == long.strip()


def test_names_that_do_not_mark():
    for names in ("content has-sidebar", "post comments-open", "story share-enabled", "with-ads", "no-menu"):
        assert H.extract(f"<body><div class='{names}'><p>Some text of the page.</p></div><div class=sidebar><p>Side text</p></div></body>", None) == "Some text of the page.", names
    assert H.extract("<body><div class='page sidebar'><h1>T</h1><p>Text of it.</p><div class=share>Share</div></div><div class=ad>Buy</div></body>", None) == "T\n\nText of it."
    assert H.extract(f"<body><div class=related><p>{'text ' * 50}</p></div><p>more</p></body>", None).startswith("text")


def page_texts(spark, pages, url="https://h{}.example/"):
    rows = [(k, url.format(k), p) for k, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in H.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    return [got[k] for k in range(len(pages))]


def test_values_of_other_attributes_do_not_mark(spark):
    """Only class, id and role name an element, and hidden counts as an attribute of its own."""
    five = "<article><p title='The hidden cost'>One.</p><p data-role=\"comment\">Two.</p><p data-hidden='false'>Three.</p><p data-id=ad>Four.</p><p alt=\"a class=ad id='menu'\">Five.</p></article>"
    names = "<article><p>One.</p><section class='related-work'><p>Two.</p></section><div class='ad-hoc'><p>Three.</p></div><p class=share>Four.</p><div class='hidden-gems'>Five.</div></article>"
    gone = "<article><p>One.</p><p hidden>x</p><p aria-hidden=TRUE>x</p><p style='display: none'>x</p><div class='ad-slot-3'>x</div><div id=articleComments>x</div><p class=advert>x</p><div role=navigation>x</div></article>"
    want = "\n\n".join(["One.", "Two.", "Three.", "Four.", "Five."])
    assert page_texts(spark, [five, names, gone]) == [want, want, "One."]


def test_hostile_pages(spark):
    """Deep, unclosed and senseless markup of a megabyte; a page takes time in proportion to its length."""
    import time

    n = 1_000_000
    hostile = [
        "<div>" * (n // 5) + "deep", '<a b="' * (n // 6), "<p>text</p>" + '<a b="' * (n // 6), "<b>" * (n // 8) + "<p></p>" * (n // 14), "<i>" * (n // 8) + "</u>" * (n // 8), "<div>" * (n // 10) + "</x>" * (n // 8),
        "<" * n, "</" * (n // 2), "<!" * (n // 2), "<!--" * (n // 4), "<script>" * (n // 8), "&" * n, "<p " + "a=b " * (n // 4), "<p" + " a='" * (n // 4), "<li>" * (n // 4), "<table><tr><td>" * (n // 15), "<a href='x" + "<p>word" * (n // 7),
        "<div class=ad>" * (n // 14) + "x", "<b>x<div>" * (n // 18) + "</b>" * (n // 8), "<p>w " * (n // 5), "<article>" * (n // 9) + "end", "<div class=post><h1>" * (n // 20) + "t", " " * n, "\x00" * n,
    ]
    for p in hostile:
        began = time.process_time()
        path = (H.main_container(H.blocks_of(p)) or H.parse("").elements[0]).path
        H.extract(p, path)
        assert time.process_time() - began < 4, p[:20]
    assert len(page_texts(spark, hostile)) == len(hostile)
    assert page_texts(spark, ["<div>" * 1_200 + "<p>deep</p>", "<p>text</p><p>more</p>" + '<a b="' * 9, "<p>say <a href='x>it</a> twice</p>"]) == ["deep", "text\n\nmore", "say it twice"]


#: Layouts marked by hand: what a reader would take for the article's text.
LAYOUTS = [
    (
        "<!doctype html><html><body class='home page-template has-sidebar'><div id=page><header class=site-header><h1 class=site-title>Blog</h1><p>Tag line</p></header><div class=site-content><div id=primary class=content-area><main id=main class=site-main>"
        "<article id=post-12 class='post type-post hentry'><header class=entry-header><h1 class=entry-title>On rivers</h1><span class=posted-on>May 2</span></header><div class=entry-content><p>Rivers run.</p><h2>Bends</h2><p>They <em>bend</em>&hellip;</p>"
        "<div class='sharedaddy share-buttons'><ul><li><a href=a>Share</a></ul></div><figure><img src=x><figcaption>A river</figcaption></figure></div><footer class=entry-footer>Filed under water</footer></article>"
        "<nav class=post-navigation><a href=b>Older</a></nav><div id=comments class=comments-area><h2>Two comments</h2><ol class=comment-list><li><p>I liked this a lot, and I would like to say so at length, again and again.</p></ol><form><label>Name</label><input></form></div></main></div>"
        "<aside id=secondary class=widget-area><h2>Recent</h2><ul><li><a href=c>c</a></ul></aside></div><footer class=site-footer>Powered</footer></div></body></html>",
        "On rivers\n\nRivers run.\n\nBends\n\nThey bend…\n\nA river",
    ),
    (
        "<table width=100%><tr><td class=menu><a href=1>Home</a><br><a href=2>About</a></td><td><div class=text><h1>Old page</h1><p>First line<br>second line.<p>Another &lt;tag&gt; here &amp; there.</div></td><td class=sidebar>Buy now</td></tr></table>",
        "Old page\n\nFirst line second line.\n\nAnother <tag> here & there.",
    ),
    (
        "<div class=wrap><div class=top-banner>50% off</div><div class=cookie-consent-box><p>We use cookies. Please agree to all of them, as it is for your own good, they say.</p></div><div class='col story-body'><h1>News</h1><p class=lead>Lead in.</p><div class=ad-wrapper><p>Ad text.</p></div>"
        "<p>Body one.</p><blockquote>Said she.</blockquote><ul><li>point one<li>point two</ul><div class=newsletter-signup><p>Get our mail.</p></div><p>Body two.</p></div><div class=related-stories><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div></div>",
        "News\n\nLead in.\n\nBody one.\n\nSaid she.\n\npoint one\n\npoint two\n\nBody two.",
    ),
    (
        "<body><nav><a href=/>Home</a></nav><main><section><h1>Guide</h1><p>Install it.</p><pre>pip   run\n  it</pre></section><section><h2>Use</h2><p>Call it.</p></section></main><div role=contentinfo>Imprint</div></body>",
        "Guide\n\nInstall it.\n\npip run it\n\nUse\n\nCall it.",
    ),
    ("<p>Only a paragraph &eacute; &#x1F600;.</p>", "Only a paragraph é 😀."),
    ("<ARTICLE><H1>UPPER</H1><P CLASS=Lead>Case does not count.</P><DIV CLASS=AdSlot>No</DIV><SCRIPT>no()</SCRIPT></ARTICLE>", "UPPER\n\nCase does not count."),
    ("<article><h1>T</h1><p>a<svg><title>icon</title><text>no</text></svg>b</p><video>fallback</video><template><p>no</p></template><noscript><p>no</p></noscript><p>c</p></article>", "T\n\nab\n\nc"),
    ("<article><p>He said \"x < y\" & left.<p>I </3 that.</p><p>5 <6</p></article>", "He said \"x < y\" & left.\n\nI </3 that.\n\n5 <6"),
]


def test_layouts_marked_by_hand(spark):
    got = page_texts(spark, [p for p, _ in LAYOUTS])
    for text, (_, want) in zip(got, LAYOUTS, strict=True):
        assert text == want


def test_one_host_of_many_layouts(spark):
    """Pages of one host keep their own text where the host's path is another layout's."""
    got = page_texts(spark, [p for p, _ in LAYOUTS for _ in range(2)], url="https://one.example/{}")
    for k, text in enumerate(got):
        assert text == LAYOUTS[k // 2][1]
