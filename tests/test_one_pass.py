"""A page is tokenised once per query, and what replaced slower forms gives the same values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagelake import session
from pagelake.functions.cascade import cascade_or_longest
from pagelake.functions.text import strip
from pagelake.operators import nodes as N
from pagelake.plans import extraction, q_dom, q_html2

FRAME = "The text of the framed document is long. " * 20
PAGES = [(1, "https://a.example/1", '<html><body><iframe src="/f"></iframe></body></html>'),
         (2, "https://a.example/f", f"<html><body><p>{FRAME}</p></body></html>"),
         (3, "https://kmap.eu/3", '<html><body><main class="content">Kurz</main><a href="/1">One</a></body></html>'),
         (4, "https://a.example/4", None), (None, None, "<p>no key</p>"), (5, "https://kmap.eu/5", "<body> </body>")]


def _pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


def _browser_mode(spark):
    p = _pages(spark)
    return extraction.browser_mode(p.selectExpr("page_id as request_id", "url", "'browser' as method", "200 as status"), p)


@pytest.mark.parametrize("query", ["browser_mode", "ultra_cascade", "iframe_text"])
def test_pages_are_tokenised_once(spark, monkeypatch, query):
    plans = []
    written = session.materialise

    def materialise(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *args)

    monkeypatch.setattr(session, "materialise", materialise)
    monkeypatch.setattr(q_dom, "_pages", lambda spark, sf: _pages(spark))
    monkeypatch.setattr(q_html2, "seeded", lambda spark, sf, name: _pages(spark))
    df = {"browser_mode": _browser_mode, "ultra_cascade": lambda s: q_dom.q_ultra_cascade(s, ""), "iframe_text": lambda s: q_html2.q_iframe_text(s, "")}[query](spark)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert sum(p.split("(initial")[0].count("ArrowEvalPython ") for p in plans) == 1
    assert len(df.collect()) == len(PAGES)


def test_browser_mode_of_odd_pages(spark):
    got = {r["url"]: r for r in _browser_mode(spark).collect()}
    assert got["https://a.example/f"]["text"] == FRAME.strip() and got["https://a.example/f"]["reason"] == "success"
    assert got["https://kmap.eu/3"]["text"].split() == ["KurzOne"] and [x["url"] for x in got["https://kmap.eu/3"]["links"]] == ["https://kmap.eu/1"]
    assert [got[u]["reason"] for u in ("https://a.example/4", "https://kmap.eu/5", None)] == ["extraction_error"] * 3


def test_cascades_in_runs_are_one_cascade(spark):
    rng = random.Random(7)
    rows = [tuple("x" * rng.choice([0, 0, 1, 2, 499, 500, 501, 700]) if rng.random() < 0.9 else None for _ in range(5)) for _ in range(300)] + [(None,) * 5]
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    of = lambda some: cascade_or_longest([(n, F.col(n)) for n in some], 500)
    whole = cascade_or_longest([("a", F.col("a")), ("b", F.col("b")), ("iframe_content_extraction", F.col("c")), ("d", F.col("d")), ("e", F.col("e"))], 500)
    parts = df.select("*", of("ab").alias("before"), of("de").alias("after"))
    got = parts.select(extraction.ultra_cascade(F.col("before"), F.col("c"), F.col("after")).alias("r"), whole.alias("w")).collect()
    assert [r.r for r in got] == [r.w for r in got] and len({r.r.strategy for r in got}) == 6


def test_strip_is_pythons(spark):
    texts = [t for k in [*range(0x300), *range(0x1600, 0x1900), *range(0x2000, 0x2100), 0x3000, 0xFEFF, 0x1F600]
             for c in [chr(k)] for t in (c, f"{c}x{c}", f"x{c}y", f" {c}a{c}{c}b{c} \r\n")] + ["", " \n", "a\n", "x" * 100_000 + " "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip("t").alias("s")).collect()
    assert [r.s for r in got] == [r.t.strip() for r in got]


def test_part_and_candidates(spark):
    page = '<body><div class="error"><p>a<b>c</b></p></div><app-root>x</app-root><p id="q">z</p></body>'
    df = spark.createDataFrame([(page,)], "html string")
    n = N.nodes("html")
    whole = N.let(n, lambda a: F.transform(a, lambda x: F.concat_ws("|", F.transform(N.part(a, x), lambda y: y["pos"].cast("string")))))
    some = N.let(n, lambda a: F.transform(N.candidates(a, ["app-root", ".error"]), lambda x: x["tag"]))
    r = df.select(n.alias("n"), whole.alias("w"), some.alias("c")).first()
    assert r.w == ["|".join(str(i) for i in range(x.pos, x.last + 1)) for x in r.n]
    assert r.c == ["div", "app-root", "p"]
