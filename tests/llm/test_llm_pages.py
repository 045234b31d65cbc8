from helpers import rows

from pagelake.llm import wrapper
from pagelake.llm.common import read


def text(page, template=(), reference=""):
    t = wrapper.parse(page)
    return wrapper.main_text(t, frozenset(template), wrapper.align(t, wrapper.parse(reference)) if reference else {})


def test_article_without_boilerplate():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="comments-enabled"><nav><a href=/>Home</a></nav>
      <div class='cookie-notice'>We use cookies</div><aside>Side</aside><!-- <article>no</article> --><div class="ad">Buy &amp; buy</div>
      <article><h1>Head &uuml;ber</h1><p>One <b>bold</b>er&nbsp;text<p>Two<br>lines &#8211; <script>var t="</p>";</script>end
      <div class="share-bar">Share</div><ul><li>first<li>second</ul><form><input value=x>Form</form></article>
      <section id=comments><article class="comment"><p>A reader</p></article></section><footer>&copy; x</footer>"""
    assert text(page) == "Head über One bolder text Two lines – end first second"


def test_no_article_uses_main_or_body_and_drops_link_blocks():
    assert text("<div><a href=1>One</a> <a href=2>Two</a></div><div>Some running text <a href=3>link</a></div>") == "Some running text link"
    assert text("<body><div>Out</div><main><p>In</p></main></body>") == "In"


def test_names_do_not_drop_the_article_or_its_parts(spark):
    assert text('<div class="content-sidebar-wrap"><main><p>Words of the page</p></main></div>') == "Words of the page"
    assert text('<div id=page class="has-sidebar comments-open"><article><p>Words of the page</p></article></div><p>More words than those, but outside</p>') == "Words of the page"
    assert text('<article><div class="article-header"><h1>Title</h1></div><p>Words of the page</p><div class="ad">Buy</div></article>') == "Title Words of the page"

    def page(i):
        return (f'<body><div id=top>Welcome to our site</div><article><p>Story number {i} with a text of its own that is long enough</p><section id="related-work"><p>Earlier {i} work</p></section>'
                f'<h2 id="search-and-rescue">Rescue {i}</h2><div class="share-bar"><div>Share this</div></div></article></body>')

    pages = spark.createDataFrame([(i, f"http://one.example/{i}", page(i)) for i in range(12)], "page_id bigint, url string, html string")
    for i, t in rows(wrapper.main_texts(pages), "page_id", "text"):
        assert t == f"Story number {i} with a text of its own that is long enough Earlier {i} work Rescue {i}"


def test_broken_and_deep_html():
    assert text("") == "" and text("<") == "<" and text("plain & simple") == "plain & simple"
    assert text("<p title='a > b'>x</p><!-- never closed <p>y</p>") == "x"
    assert text("<div>" * 4000 + "<b>" * 4000 + "deep") == "deep"
    t = wrapper.parse("<div>" * 3000 + "x")
    assert len(wrapper.align(t, t)) == 3001


def test_simple_tree_matching_aligns_inserted_nodes():
    a, b = wrapper.parse("<ul><li>1<li>2<li>new<li>3</ul>"), wrapper.parse("<ul><li>1<li>2<li>3</ul>")
    found = {a.own[i]: b.own[j] for i, j in wrapper.align(a, b).items() if a.own[i]}
    assert found["1"] == "1" and found["2"] == "2" and found["3"] == "3" and len(found) == 3


def test_constant_nodes_become_template(spark):
    def page(i):
        return f"<body><div id=top>Welcome to our site</div><div class=story><p>Story number {i} of the day</p></div><div id=end>All about us</div></body>"

    data = [(i, f"http://one.example/{i}", page(i)) for i in range(12)]
    data += [(100, "http://two.example/a", page(1)), (101, None, None), (102, "nonsense", ""), (0, "http://one.example/0", page(0)), (None, "http://one.example/n", page(77))]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").selectExpr("*", "'x' as host", "1 as reference", "2 as template", "3 as text")
    got = rows(wrapper.main_texts(pages), "page_id", "url", "text", "n_chars")
    assert len(got) == len(data)
    for i, url, t, n in got:
        assert n == len(t)
        if url and "one.example" in url:
            assert t == f"Story number {77 if i is None else i} of the day"
        elif url and "two.example" in url:
            assert t == "Welcome to our site Story number 1 of the day All about us"
        else:
            assert t == ""
    assert wrapper.main_texts(pages.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark):
    import html
    import re

    pages = read(spark, "/root/testdata/sf0.001", "pages")
    want = {}
    for i, page in rows(pages, "page_id", "html"):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        want[i] = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
    assert dict(rows(wrapper.main_texts(pages), "page_id", "text")) == want
