"""Interval marks of nodes, and the text rules that read them."""

from __future__ import annotations

import random
import time

import pytest

from pagelake.operators import classify, dom, html_text, marks
from pagelake.operators import nodes as N

TAGS = ["div", "p", "nav", "li", "span", "section", "article", "b"]
NAMES = ["", ' class="sidebar"', ' class="x menu"', ' id="footer"', " hidden", ' style="Display : none"', ' class="content"']


def random_page(rng, size, body):
    out, stack = [], []
    for _ in range(size):
        kind = rng.random()
        if kind < 0.4:
            tag = rng.choice(TAGS)
            out.append(f"<{tag}{rng.choice(NAMES)}>")
            stack.append(tag)
        elif kind < 0.65 and stack:
            out.append(f"</{stack.pop()}>")
        else:
            out.append(rng.choice(["some words ", "&uuml;", "x", "<!-- c -->", "<br>"]))
    inner = "".join(out)
    head = "<head><title>t</title><style>nav {}</style></head>"
    return f"<html>{head}<body class='menu'>{inner}</body></html>" if body else head + inner


def slow_marks(page):
    """Sets by searching every ancestor of every node."""
    out = []
    body = next((i for i, n in enumerate(page) if n[2] == "body"), None)

    def within(i, j):
        return j <= i <= page[j][0]

    def text(i):
        return "".join(n[4] for k, n in enumerate(page) if within(k, i) and n[2] == "#text")

    heads = [j for j, n in enumerate(page) if n[2] == "head"]
    if body is None:
        size = sum(len(n[4]) for i, n in enumerate(page) if n[2] == "#text" and not any(within(i, h) for h in heads))
    else:
        size = len(text(body))

    def own(i):
        _, _, tag, attrs, _ = page[i]
        if tag.startswith("#"):
            return 0
        cls, ident = attrs.get("class", "").split(), attrs.get("id", "")

        def any_of(selectors):
            return any(s == tag or (s[0] == "." and s[1:] in cls) or (s[0] == "#" and s[1:] == ident) for s in selectors)
        style = "".join(attrs.get("style", "").split()).lower()
        words = marks._WORDS.search(" ".join(cls) + " " + ident)
        return ((marks.HEAD if tag == "head" else 0)
                | (marks.BOILER if tag in marks.BOILER_TAGS or (words and tag not in ("body", "main", "article") and 2 * len(text(i)) <= size) else 0)
                | (marks.BLOCK if tag in marks.BLOCK_TAGS else 0)
                | (marks.SKIP if any_of(marks.L.READABLE_SKIP) or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style else 0)
                | (marks.TARGET_SKIP if any_of(marks.L.TARGET_SKIP) else 0) | (marks.EDU_SKIP if any_of(marks.L.EDU_SKIP) else 0))

    owns = [own(i) for i in range(len(page))]
    for i in range(len(page)):
        found = above = 0
        for j in range(i + 1):
            if within(i, j):
                bits = owns[j]
                if body is not None and j < body <= i <= page[body][0]:
                    bits &= ~marks.OF_BODY
                found |= bits
                above |= bits if j < i else 0
        out.append((len(text(i)), found, owns[i] & ~above))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_marks_equal_a_search_of_all_ancestors(seed):
    rng = random.Random(seed)
    page = N.parse(random_page(rng, 120, body=seed % 3 > 0))
    chars = marks.lengths(page)
    inside, outer = marks.mark(page, chars)
    assert list(zip(chars, inside, outer, strict=True)) == slow_marks(page)


def test_marks_of_empty_and_textless_pages():
    for page in ("", "<!-- only -->", "<body></body>", "<nav>"):
        got = N.parse(page)
        assert len(marks.lengths(got)) == len(marks.mark(got, marks.lengths(got))[0]) == len(got)


def test_batches_are_cut_by_size(monkeypatch):
    import pyarrow as pa
    pages = pa.array([None, "", "<p>one</p>", "<nav><p>two &amp; three</p></nav>", "<p>" * 50])
    whole = N._arrow_nodes(pages)
    monkeypatch.setattr(N, "PARSE_CHARS", 5)
    assert N._arrow_nodes(pages).equals(whole) and len(whole) == 5
    assert len(N._arrow_nodes(pages.slice(0, 0))) == 0


def test_nodes_leave_a_worker_in_parts(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(N, "PARSE_CHARS", 1000)
    pages = pa.array(["<p>some words</p>" * 10] * 100 + [None, "<p>" + "x" * 5000])
    seen = []

    def batches():
        for _ in range(2):
            seen.append("in")
            yield pages

    parts = []
    for part in N._streamed_nodes(batches()):
        seen.append("out")
        parts.append(part)
    assert max(part.nbytes for part in parts) < N._arrow_nodes(pages).nbytes / 10
    assert seen[:3] == ["in", "out", "out"] and seen.count("in") == 2   # parts leave before the next batch is read
    assert pa.concat_arrays(parts).equals(pa.concat_arrays([N._arrow_nodes(pages)] * 2))


def test_nodes_of_many_batches_stay_with_their_pages(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 500, 1, 3).selectExpr("id", "CASE WHEN id % 5 > 0 THEN concat('<p id=\"', id, '\">', repeat('<b>w</b>', CAST(id * 7 AS INT)), '</p>') END AS html")
        rows = df.select("id", N.nodes("html").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 500
    for r in rows:
        assert (len(r.n), [x.id for x in r.n[:1]]) == ((1 + 14 * r.id, [str(r.id)]) if r.id % 5 else (0, []))


def test_long_pages_take_linear_time(spark):
    def page(blocks):
        unit = '<div class="menu"><p>menu</p></div><div><p>some words of a paragraph that is long enough to be kept here</p></div>loose '
        return "<html><body>" + unit * blocks + "</body></html>"

    def seconds(blocks):
        df = spark.createDataFrame([(1, page(blocks))], "page_id int, html string")
        started = time.time()
        row = dom.dom_pass(df).select("main_text", "readable_text", "educational_text").first()
        return time.time() - started, row

    seconds(10)
    small, row = seconds(100)
    took, row = seconds(6000)   # 54,000 nodes
    assert row["main_text"].count("some words") == 6000 and "menu" not in row["main_text"]
    assert took < 10


def one(spark, html, **columns):
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    return df.select(*[c("html").alias(n) for n, c in columns.items()]).first().asDict()


def test_text_of_character_references_and_odd_attributes(spark):
    page = ('<html><head><title>x</title></head><body><p title="a>b">F&uuml;r &#228;lter &hellip; &#x4e2d;</p><script>if (a<b) "&lt;"</script>'
            "<style>p{}</style><!-- gone --> end</body></html>")
    got = one(spark, page, body=html_text.body_text, visible=html_text.visible_text, selector=html_text.selector_text)
    assert got["body"] == 'Für älter … 中if (a<b) "&lt;"p{} end' == got["selector"]
    assert got["visible"] == "Für älter … 中 end"


def test_scores_read_decoded_text(spark):
    got = one(spark, "<body>Dr&#101;i Achs&#101;n im R&#x61;um: die Koordinaten</body>", c8=classify.educational_present)
    assert got["c8"]["keyword_count"] == 3 and got["c8"]["has_educational_content"]
    svgs = "<!-- <svg> --><script>'<svg>'</script>" + "<svg></svg>" * 4
    assert one(spark, svgs, c8=classify.educational_present)["c8"]["svg_count"] == 4
    df = spark.createDataFrame([("<body>JavaScript wird ben&ouml;tigt</body>", "http://a.test/")], "html string, url string")
    assert df.select(classify.ultra_complex_score("html", "url").alias("s")).first()["s"]["score"] == 5


def test_svg_text_repeats_nested_elements(spark):
    page = "<body><svg><title>Karte &amp; Achse</title><text>ab<tspan>cdef</tspan></text><desc>x</desc></svg><p>out</p></body>"
    assert one(spark, page, t=html_text.svg_text)["t"] == "Karte & Achse abcdef cdef"


def test_mining_sees_every_data_attribute_and_quote(spark):
    page = """<body><div data-a="first long value" data-b='second long value' class=x data-c=unquoted-value></div>
<p data-d="short"></p><!-- <i data-e="inside a comment"> --><script>var s = '<b data-f="inside a script">';</script></body>"""
    got = one(spark, page, t=html_text.mined_text)["t"]
    assert got == 'first long value second long value unquoted-value  <i data-e="inside a comment">  '


def test_frames_in_comments_and_scripts_do_not_count(spark):
    page = """<body><!-- <iframe src="/a"> --><script>'<iframe src="/b">'</script><iframe title="x>y" src='/c?d=1&amp;e=2'></iframe><iframe></iframe></body>"""
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert df.select(html_text.iframe_sources("html").alias("s")).first()["s"] == ["/c?d=1&e=2"]


def test_null_and_empty_pages(spark):
    for html in (None, ""):
        got = one(spark, html, body=html_text.body_text, visible=html_text.visible_text, svg=html_text.svg_text, mined=html_text.mined_text)
        assert set(got.values()) == {""}
