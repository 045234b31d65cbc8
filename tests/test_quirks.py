"""Reference behaviours kept on purpose and property tests."""

import re
import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.functions import lexicons as L
from pagelake.functions.cascade import cascade, cascade_or_longest
from pagelake.functions.text import tokens
from pagelake.functions.urls import resolve
from pagelake.operators import files as FI
from pagelake.operators import links as LK
from pagelake.operators import quality as Q

SF_SMALL = "/root/testdata/sf0.001"


def test_phrase_and_its_last_word_both_count(spark):
    df = spark.createDataFrame([(1, "temporarily unavailable")], "id long, text string")
    q = Q.with_quality(df, "text").select("quality_metrics.matched_keywords.error_page").first()[0]
    assert q == 2


def test_mailto_tel_internal_and_case_sensitive_javascript(spark):
    html = ('<a href="mailto:x@y.z">m</a><a href="tel:1">t</a><a href="JavaScript:go()">J</a>'
            '<a href="javascript:go()">j</a>')
    df = spark.createDataFrame([(1, "https://a.example.org/p", html)], "page_id long, url string, html string")
    links = LK.explode_links(LK.with_links(df)).collect()
    urls = {r.url: r for r in links}
    assert urls["mailto:x@y.z"].is_internal and urls["tel:1"].is_internal
    assert "JavaScript:go()" in urls and "javascript:go()" not in urls


def test_substring_extension_rules(spark):
    df = spark.createDataFrame([("https://h.org/a.docx",), ("https://h.org/b.xlsx",), ("https://h.org/c.PPTX",),
                                ("https://h.doc.org/x",)], "url string")
    got = [r[0] for r in df.select(FI.format_from_url("url")).collect()]
    assert got == ["doc", "xls", "ppt", "doc"]
    strict = [r[0] for r in df.select(FI.format_from_url("url", strict=True)).collect()]
    assert strict == ["docx", "xlsx", "pptx", "unknown"]  # strict option: the path suffix decides


def test_error_status_with_body_is_success(spark):
    from pagelake.operators.classify import status_message
    df = spark.createDataFrame([(404, 10), (503, 7), (200, 5), (302, 3)], "s int, n int")
    msgs = [r[0] for r in df.select(status_message("s", "n")).collect()]
    assert msgs[0].startswith("HTTP 404 detected, but 10 characters")
    assert msgs[1].startswith("HTTP 503 detected, but 7 characters")
    assert msgs[2] == "Text extracted successfully"
    assert msgs[3] == "HTTP 302 - Text extracted successfully (3 characters)"


def test_category_ties_and_error_bias(spark):
    rows = [(1, "lernen ects error"), (2, "ects error"), (3, "error " * 2 + "x" * 900)]
    df = spark.createDataFrame(rows, "id long, text string")
    q = {r.id: r for r in Q.with_quality(df, "text").select("id", "quality_metrics.*").collect()}
    assert q[1].content_category == "error_page"          # error bias below 800 chars
    assert q[3].content_category == "error_page" and q[3].confidence == 1.0
    tie = spark.createDataFrame([(1, "lernen ects " + "x" * 900)], "id long, text string")
    assert Q.with_quality(tie, "text").select("quality_metrics.content_category").first()[0] == "educational_content"


words = st.lists(st.sampled_from(list("abcäöü ßé_1.,-\n") + ["lernen ", "ects ", "error ", "not found "]),
                 max_size=30).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(words, min_size=1, max_size=40))
def test_token_counts_equal_python_word_boundary(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.n for r in df.select("id", F.size(tokens(F.lower("text"))).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == len(re.findall(r"\w+", t.lower()))
    q = {r.id: r.e for r in Q.with_quality(df, "text").select("id", "quality_metrics.matched_keywords.error_page")
         .withColumnRenamed("error_page", "e").collect()}
    for i, t in enumerate(texts):
        low = t.strip().lower()
        exp = sum(len(re.findall(re.escape(k) if " " in k else rf"\b{re.escape(k)}\b", low)) for k in L.ERROR_PAGE)
        assert q[i] == exp


segments = st.lists(st.sampled_from(["a", "b", "..", ".", "c d"]), max_size=4)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(segments, st.sampled_from(["", "/", "//h.org/", "?q=1", "#f"]), segments), min_size=1, max_size=30))
def test_resolve_matches_urljoin_property(spark, cases):
    pairs = []
    for base_seg, prefix, href_seg in cases:
        base = "https://x.org/" + "/".join(s for s in base_seg if s not in (".", ".."))
        href = prefix + "/".join(href_seg)
        if href and not href.startswith("#") and "c d" not in href:
            pairs.append((base, href))
    if not pairs:
        return
    df = spark.createDataFrame(pairs, "base string, href string")
    got = [r[0] for r in df.select(resolve("base", "href")).collect()]
    assert got == [urllib.parse.urljoin(b, h) for b, h in pairs]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab ", max_size=12), min_size=3, max_size=3), min_size=1, max_size=20))
def test_cascade_result_is_a_candidate(spark, rows):
    df = spark.createDataFrame([tuple(r) for r in rows], "a string, b string, c string")
    out = df.select("a", "b", "c", cascade([("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))], 5).alias("r"),
                    cascade_or_longest([("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))], 5).alias("l")).collect()
    for r in out:
        cands = {"a": r.a.strip(), "b": r.b.strip(), "c": r.c.strip()}
        first = next((k for k in "abc" if len(cands[k]) > 5), None)
        assert (r.r.strategy, r.r.text) == ((first, cands[first]) if first else ("fallback", cands["c"]))
        raw = {"a": r.a, "b": r.b, "c": r.c}
        hit = next((k for k in "abc" if len(raw[k]) > 5), None)
        if hit:
            assert (r.l.strategy, r.l.text) == (hit, raw[hit])
        else:
            best = max("abc", key=lambda k: (len(raw[k]), -"abc".index(k)))
            assert r.l.text == (raw[best] if len(raw[best]) > 0 else "")


def test_error_page_stages_in_order(spark):
    from pagelake.operators.classify import error_page
    rows = [
        (1, "<title>Access Denied</title><body>x</body>", "page not found here"),
        (2, "<title>Home</title><body>x</body>", "Sorry: Page Not Found on this server, long text " * 3),
        (3, "<title>Home</title><body>x</body>", "Checking your browser before accessing " * 5),
        (4, "<title>Home</title><body>x</body>", "  Request blocked  "),
        (5, '<title>Home</title><body><div class="box captcha">x</div></body>', "fine content " * 20),
        (6, "<title>Home</title><body>x</body>", "fine content " * 20),
        (7, "<title>Home</title><body>x</body>", "short but fine"),
    ]
    df = spark.createDataFrame(rows, "id long, html string, content string")
    got = {r.id: (r.e.is_error_page, r.e.error_type) for r in df.select("id", error_page("html", "content").alias("e")).collect()}
    assert got[1] == (True, "error_title_access denied")
    assert got[2] == (True, "http_error_page_not_found")
    assert got[3] == (True, "security_challenge_checking_your_browser")
    assert got[4] == (True, "short_error_blocked")
    assert got[5] == (True, "dom_error_captcha")
    assert got[6] == (False, None) and got[7] == (False, None)


def test_spa_scores(spark):
    from pagelake.operators.classify import spa_indicators, spa_score, ultra_complex_score
    rows = [
        (1, "https://app.example.org/x", '<body><div id="root" data-reactroot="">JavaScript wird benötigt</div></body>'),
        (2, "http://plain.example.org/", "<body><p>" + "words " * 200 + "</p></body>"),
        (3, "http://v.example.org/", '<body><div data-v-="" class="loading spinner">Loading...</div></body>'),
    ]
    df = spark.createDataFrame(rows, "id long, url string, html string")
    got = {r.id: r for r in df.select("id", spa_indicators("html").alias("i"), spa_score("html").alias("s"),
                                      ultra_complex_score("html", "url").alias("u")).collect()}
    assert got[1].i.frameworks == ["React"] and got[1].i.is_spa
    # React marker +2, History API +1, #root +1
    assert got[1].s.score == 4 and got[1].s.is_spa
    # placeholder +3, https +1, 0 < text < 500 +2, app. host +1
    assert got[1].u.score == 7 and got[1].u.is_ultra_complex
    assert got[2].s.score == 1 and not got[2].s.is_spa and not got[2].u.is_ultra_complex
    assert got[3].i.frameworks == ["Vue"] and got[3].i.score == 3
    assert got[3].s.score == 2 + 1 + 1  # Vue attribute, History API, loading class


def test_embedded_json_all_fields_and_cdata(spark):
    from pagelake.operators.html_text import embedded_json_text
    js = ('<!--//--><![CDATA[//><!--\n{"description":"<b>Viel</b>   Text","educationalLevel":"Sek I",'
          '"typicalAgeRange":"10-12","attachments":[{"name":"A","tag":"x"},{"tag":"no name"}]}\n//--><!]]>')
    html = f'<body><script id="embedded-topic">{js}</script></body>'
    got = spark.createDataFrame([(html,)], "html string").select(embedded_json_text("html")).first()[0]
    assert got == ("Beschreibung:\nViel Text\n\nBildungsstufe: Sek I\n\nAltersbereich: 10-12\n\n"
                   "Anhänge und Ressourcen:\n- A (x)")


def test_link_type_rule_order(spark):
    html = ('<a href="/v/clip.mp4">Clip</a><a href="/about">About us</a><a href="/p1">Read more</a>'
            '<a href="/p2" class="nav-link">Item</a><a href="/p3">Preview</a><a href="/p4" class="big button">Go</a>'
            '<a href="https://twitter.com/x">T</a><a href="/p5">Plain</a>')
    df = spark.createDataFrame([(1, "https://a.org/", html)], "page_id long, url string, html string")
    got = {r.url.rsplit("/", 1)[-1]: r.link_type for r in LK.explode_links(LK.with_links(df)).collect()}
    assert got == {"clip.mp4": "download", "about": "navigation", "p1": "content", "p2": "navigation",
                   "p3": "content", "p4": "button", "x": "social", "p5": "content"}


def test_backoff_outcomes(spark):
    from pagelake.operators import timeline as TL
    rows = [("a", 1, 503), ("a", 2, 503), ("a", 3, 200),
            ("b", 1, 503), ("b", 2, 404),
            ("c", 1, 503), ("c", 2, 429), ("c", 3, 500), ("c", 4, 502), ("c", 5, 200),
            ("d", 1, 200)]
    df = spark.createDataFrame(rows, "k string, n int, status int")
    got = {r.k: (r.attempts_used, r.outcome, r.total_delay_s) for r in TL.backoff_outcome(df, "k", "n", "status").collect()}
    assert got == {"a": (3, "success", 3.0), "b": (2, "fatal", 1.0), "c": (4, "exhausted", 7.0), "d": (1, "success", 0.0)}


def test_hash_stability_window(spark):
    from pagelake.operators import timeline as TL
    seqs = {"a": "AAAA", "b": "ABBBB", "c": "AAABBBB", "d": "ABABABABBBB", "e": "AAA"}
    rows = [(k, i + 1, c) for k, s in seqs.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, poll int, content string")
    got = {r.k: r.stable_at for r in TL.hash_stability(df, "k", "poll", "content").collect()}
    assert got == {"a": 4, "b": 5, "c": 7, "d": None, "e": None}


def test_best_snapshot_rules(spark):
    from pagelake.operators.html_text import best_snapshot
    rows = [("a", 1, "x" * 10), ("a", 2, "Loading... " + "y" * 2000), ("a", 3, "z" * 50), ("a", 4, "w" * 40),
            ("b", 1, "s" * 1200), ("b", 2, "t" * 5000),                       # stops after poll 1
            ("c", 1, "JavaScript wird benötigt")]
    rows += [("d", i, "q" * i) for i in range(1, 30)]                            # capped at 20 polls
    df = spark.createDataFrame(rows, "k string, poll int, text string")
    got = {r.k: (len(r.best_text), r.best_poll, r.polls_used) for r in best_snapshot(df, "k", "poll", "text").collect()}
    assert got == {"a": (50, 3, 4), "b": (1200, 1, 1), "c": (0, None, 1), "d": (20, 20, 20)}


def test_quiet_period_and_significant(spark):
    import datetime as dt
    from pagelake.operators import timeline as TL
    t0 = dt.datetime(2024, 1, 1)
    ms = lambda m: t0 + dt.timedelta(milliseconds=m)
    rows = [("a", ms(0), 10.0), ("a", ms(200), 60.0), ("a", ms(400), 10.0), ("a", ms(1200), 10.0),
            ("b", ms(0), 60.0), ("b", ms(100), 70.0), ("b", ms(150), 80.0), ("b", ms(5000), 1.0)]
    rows += [("c", ms(i * 400), 1.0) for i in range(100)]                       # never quiet within 35 s
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, added double")
    q = {r.k: (r.quiet_at_us, r.timed_out) for r in TL.quiet_period(df, "k", "ts").collect()}
    base = TL.ts_us(F.lit(t0).cast("timestamp_ntz"))
    b = spark.range(1).select(base.alias("b")).first().b
    assert q["a"] == (b + 900_000, False)      # 400 ms + 500 ms of quiet
    assert q["b"] == (b + 650_000, False)
    assert q["c"] == (None, True)
    s = {r.k: (r.resolved_after_us, r.resolved_by) for r in TL.quiet_or_significant(df, "k", "ts", "added").collect()}
    assert s["b"] == (150_000, "significant")  # third addition over 50 chars
    assert s["a"] == (4_200_000, "quiet")       # one significant addition; 3 s quiet after 1.2 s
    assert s["c"] == (15_000_000, "cap")


def test_youtube_size_and_format_rules(spark):
    urls = [("https://youtu.be/abc",), ("https://music.youtube.de/x",), ("https://www.youtube.com/watch?v=Q1&t=2",),
            ("https://notyoutube.com/watch?v=1",), ("HTTPS://M.YOUTUBE.COM/watch?v=Z",)]
    df = spark.createDataFrame(urls, "url string")
    got = [(r.h, r.p, r.v) for r in df.select(FI.youtube_by_host("url").alias("h"), FI.youtube_by_pattern("url").alias("p"),
                                              FI.youtube_video_id("url").alias("v")).collect()]
    assert got == [(True, True, "abc"), (True, False, None), (True, True, "Q1"), (False, True, "1"), (True, True, "Z")]

    mb = 1024 * 1024
    sizes = spark.createDataFrame([(50 * mb,), (50 * mb + 1,), (3 * mb // 2,)], "b long")
    g = [(r.g.file_size_mb, r.g.too_large) for r in sizes.select(FI.size_guard("b", 50).alias("g")).collect()]
    assert g == [(50.0, False), (50.0, True), (1.5, False)]
    assert sizes.select(FI.size_guard("b", 500).alias("g")).first().g.limit_mb == 100

    cases = spark.createDataFrame([("unknown", "report.PDF"), ("", "tool.exe"), ("", ""), (".DOCX", None)],
                                  "given string, name string")
    r = [(x.r.format, x.r.error) for x in cases.select(FI.resolve_format("given", "name").alias("r")).collect()]
    assert r == [("pdf", None), (None, "Unsupported format: exe"),
                 (None, "Unable to determine file format for conversion"), ("docx", None)]


def test_links_of_empty_or_null_html(spark):
    df = spark.createDataFrame([(1, "https://a.org/", None), (2, "https://a.org/", ""), (3, "https://a.org/", "<p>no links</p>")],
                               "page_id long, url string, html string")
    p = LK.with_links(df).select("page_id", "links", LK.link_stats("links").alias("s")).collect()
    for r in p:
        assert r.links == [] and r.s.total_links == 0 and r.s.internal_ratio == 0.0 and r.s.link_types == {}


def test_text_builders_on_null_html(spark):
    from pagelake.operators import html_text as H
    df = spark.createDataFrame([(None,)], "html string")
    r = df.select(H.body_text("html").alias("a"), H.visible_text("html").alias("b"), H.selector_text("html").alias("c"),
                  H.readable_text("html").alias("d"), H.svg_text("html").alias("e"),
                  H.embedded_json_text("html").alias("f"), H.mined_text("html").alias("g"),
                  H.state_text("html").alias("h"), H.cascade_500("html").alias("i")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("",) * 8
    assert r.i.text == "" and r.i.strategy == "full_content"


def test_dot_segments_of_any_depth_resolve_like_urllib(spark):
    import random
    from urllib.parse import urljoin
    from pagelake.functions.urls import resolve
    r = random.Random(4)
    cases = [("https://h.org/a/b/c/d/e/f", "../" * 10 + "z"), ("https://h.org/a", "./" * 6 + "q"), ("http://h.org/a/b?x=/..", "c?y=/../d"),
             ("http://h.org/a/", ".."), ("http://h.org/a/b", "/../..//x"), ("http://h.org/a", "///b/../c")]
    for _ in range(200):
        cases.append(("https://h.org/" + "/".join(r.choice("ab") for _ in range(r.randint(0, 8))),
                      "/".join(r.choice(["a", "b", "..", "."]) for _ in range(r.randint(1, 14)))))
    got = [x.u for x in spark.createDataFrame(cases, "b string, h string").select(resolve("b", "h").alias("u")).collect()]
    assert got == [urljoin(*c) for c in cases]


def test_rate_windows_scan_the_log_once(spark):
    import re
    from pagelake.operators import timeline as TL
    from pagelake.sources.seeded import seeded
    f = seeded(spark, SF_SMALL, "fetch_log").select("event_id", "host", "ts", "weight")
    counts = []
    for n in (1, 8):
        plan = TL.violations(f, "host", "ts", "weight", [(3, (i + 1) * TL.HOUR_US) for i in range(n)])._jdf.queryExecution().executedPlan().toString()
        counts.append((len(re.findall("FileScan|Scan parquet", plan)), len(re.findall("Exchange hashpartitioning", plan))))
    assert counts[0] == counts[1] == (1, 1)


def test_rules_with_forty_intervals(spark):
    from pagelake.operators import timeline as TL
    from pagelake.sources.seeded import seeded
    f = seeded(spark, SF_SMALL, "fetch_log").select("event_id", "host", "ts", "weight")
    hosts = sorted(r.host for r in f.select("host").distinct().collect())
    rules = [(h, 2 + i % 9, (1 + i) * 17 * TL.MINUTE_US) for j, h in enumerate(hosts[:-1]) for i in range(40) if (i + j) % 3]
    got = {r.event_id: r.violates for r in TL.violations_by_rules(f, "host", "ts", "weight", spark.createDataFrame(rules, "host string, limit long, interval_us long")).collect()}
    rows = [(r.event_id, r.host, r.t, r.weight) for r in f.withColumn("t", TL.ts_us("ts", f)).collect()]
    want = {e: any(sum(w2 for _, h2, t2, w2 in rows if h2 == h and t - iv < t2 <= t) > lim for hh, lim, iv in rules if hh == h) for e, h, t, _ in rows}
    assert got == want and any(want.values()) and not all(want.values())


def test_user_lexicon_phrases_count(spark):
    from pagelake.operators import quality as Q
    docs = spark.createDataFrame([(1, "Big red bus and a big red bus; buses"), (2, "nothing"), (3, None)], "doc_id long, text string")
    lex = spark.createDataFrame([("veh", "big red bus", True), ("veh", "buses", False), ("col", "red", False)], "category string, keyword string, is_phrase boolean")
    assert sorted(map(tuple, Q.keyword_hits_joined(docs, lex).collect())) == [(1, "col", 2), (1, "veh", 3)]


def test_embedded_json_without_attachments_and_state_with_semicolons(spark):
    from pagelake.operators import html_text as H
    page = '<script id="embedded-topic">{"summary":"Kurz","attachments":[]}</script><script>window.data = {"a":"x; y", "b": "z"};</script>'
    r = spark.createDataFrame([(page,)], "html string").select(H.embedded_json_text("html").alias("e"), H.state_text("html").alias("s")).first()
    assert r.e == "Zusammenfassung: Kurz" and "x; y" in r.s


def test_shared_folder_is_required_off_a_local_session():
    import pytest
    from pagelake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
