"""HTML -> text projections that are native Spark expressions.

All functions return Columns over an ``html`` (or text) column. Selectors and
text nodes (B3, B4) are rules over the page's nodes (:mod:`.nodes`); the other
extractors over nodes (B1, B2, B10, B11, containers of B12) are in
:mod:`pagelake.operators.dom`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions.cascade import cascade
from ..functions.text import col, collapse_ws, expr_cache, strip
from . import dom
from .nodes import let, nodes


@expr_cache
def body_text(html, parsed=None) -> Column:
    """``document.body.textContent`` (includes script/style text)."""
    return dom.body_text(nodes(html, parsed))


@expr_cache
def visible_text(html) -> Column:
    """Body text after removing ``script`` and ``style`` elements."""
    return dom.visible_text(nodes(html))


@expr_cache
def selector_text(html) -> Column:
    """Text of the first existing of main, article, .content, #content,
    .main, #main, .post, .entry; else the body text. Stripped."""
    return dom.selector_text(nodes(html))


@expr_cache
def readable_text(html) -> Column:
    """Trimmed text nodes of at least 10 chars outside the skip selectors
    and hidden elements, joined by one space."""
    return dom.readable_text(nodes(html))


@expr_cache
def cascade_500(html, main_text=None, parsed=None) -> Column:
    """First of (main text, a rule over the nodes), selector, readable, full text
    with more than 500 stripped chars; else full text. ``struct<text, strategy>``."""
    def first(n):
        cands = ([("trafilatura", main_text(n))] if main_text is not None else []) + [
            ("text_content", dom.selector_text(n)),
            ("readable_content", dom.readable_text(n)),
            ("full_content", dom.body_text(n))]
        return cascade(cands, 500, fallback_name="full_content")
    return let(nodes(html, parsed), first)


@expr_cache
def cascade_50(html, parsed=None) -> Column:
    """Fallback strategies; the four static body reads are all
    ``textContent``, so the first one decides. Threshold 50."""
    full = body_text(html, parsed)
    return cascade([("networkidle_wait", full)], 50, fallback=F.lit(""), fallback_name="fallback_failed")


# ---- B12: SVG text ----
@expr_cache
def svg_text(html, parsed=None) -> Column:
    """B12 (SVG part): texts of svg text/tspan/title/desc elements longer than
    2 chars after trimming, joined by a space; a nested one repeats its text."""
    return dom.svg_text(nodes(html, parsed))


# ---- B13: embedded JSON ----
EMBEDDED_PATTERNS = [
    r'(?s)<script id="embedded-topic"[^>]*>(.*?)</script>',
    r'(?s)<script[^>]*type="json"[^>]*>(.*?)</script>',
    r'(?s)<script[^>]*id="[^"]*topic[^"]*"[^>]*>(.*?)</script>',
]
TOPIC_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in
    ("description", "summary", "keywords", "subject", "topic", "educationalLevel", "typicalAgeRange")
] + [T.StructField("attachments", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("tag", T.StringType())])))])


def _clean_script(s: Column) -> Column:
    for p in (r"<!--//--><!\[CDATA\[//>", r"//--><!\]\]>", r"<!--", r"-->"):
        s = F.regexp_replace(s, p, "")
    return strip(F.regexp_extract(s, r"(?s)(\{.*\})", 1))


def _line(label: str, v: Column) -> Column:
    return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v, F.lit("\n\n")))


def _topic_text(j: Column) -> Column:
    o = F.from_json(j, TOPIC_SCHEMA)
    desc = collapse_ws(F.regexp_replace(o["description"], r"<[^>]*>", " "))
    att = F.filter(o["attachments"], lambda a: F.coalesce(a["name"], F.lit("")) != "")
    att_lines = F.array_join(F.transform(att, lambda a: F.concat(
        F.lit("- "), a["name"],
        F.when(F.coalesce(a["tag"], F.lit("")) != "", F.concat(F.lit(" ("), a["tag"], F.lit(")"))).otherwise(F.lit("")),
        F.lit("\n"))), "")
    return strip(F.concat_ws(
        "",
        F.when(F.coalesce(o["description"], F.lit("")) != "", F.concat(F.lit("Beschreibung:\n"), desc, F.lit("\n\n"))),
        _line("Zusammenfassung: ", o["summary"]),
        _line("Schlüsselwörter: ", o["keywords"]),
        F.when((F.coalesce(o["subject"], F.lit("")) != "") & (F.coalesce(o["topic"], F.lit("")) != ""),
               F.concat(F.lit("Fach: "), o["subject"], F.lit(" - Thema: "), o["topic"], F.lit("\n\n"))),
        _line("Bildungsstufe: ", o["educationalLevel"]),
        _line("Altersbereich: ", o["typicalAgeRange"]),
        F.when(F.size(o["attachments"]) > 0,
               F.concat(F.lit("Anhänge und Ressourcen:\n"), att_lines, F.lit("\n")))))


@expr_cache
def embedded_json_text(html) -> Column:
    """Labelled text from the first embedded topic script (by pattern
    order, then document order) that parses as a JSON object and yields text."""
    h = col(html)
    scripts = F.concat(*[F.regexp_extract_all(h, F.lit(p), 1) for p in EMBEDDED_PATTERNS])
    jsons = F.filter(F.transform(scripts, _clean_script),
                     lambda j: (j != "") & F.try_parse_json(j).isNotNull())
    texts = F.filter(F.transform(jsons, _topic_text), lambda t: t != "")
    return F.coalesce(F.get(texts, 0), F.lit(""))


# ---- B14: script/data/comment mining ----
_SMALL_JSON = r'\{[^}]*"[^"]*"[^}]*\}'


def _quoted_strings(j: Column) -> Column:
    return F.array_join(F.regexp_extract_all(j, F.lit(r'"([^"]*)"'), 1), " ")


@expr_cache
def mined_text(html, parsed=None) -> Column:
    """Quoted strings of small JSON objects in scripts, ``data-*``
    values over 10 chars, body comments over 20 chars; each piece followed
    by a space (untrimmed, as measured by B9)."""
    h = F.coalesce(col(html), F.lit(""))
    scripts = F.regexp_extract_all(h, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), 1)
    objs = F.filter(F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(_SMALL_JSON), 0))),
                    lambda o: F.try_parse_json(o).isNotNull())
    data = dom.data_values(nodes(h, parsed))
    comments = dom.comments(nodes(h, parsed))
    pieces = F.concat(F.transform(objs, _quoted_strings), data, comments)
    return F.array_join(F.transform(pieces, lambda p: F.concat(p, F.lit(" "))), "")


# ---- B15: application-state strings ----
_STATE = r"window\.(?:__REDUX_STORE__|appState|applicationState|state|store|data)\s*=\s*(\{[^;\"']*(?:\"(?:[^\"\\]|\\.)*\"[^;\"']*|'(?:[^'\\]|\\.)*'[^;\"']*)*\})"


@expr_cache
def state_text(html) -> Column:
    """B15 (static form): quoted strings of ``window.<state> = {...}`` objects
    in scripts, joined by a space, each object followed by a space."""
    objs = F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(_STATE), 1)
    return F.array_join(F.transform(objs, lambda o: F.concat(_quoted_strings(o), F.lit(" "))), "")


# ---- B16: iframe text ----
def iframe_sources(html) -> Column:
    return dom.frame_sources(nodes(html))


def iframe_text(pages: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """For each page, the body text (over 50 chars) of every iframe
    target, in iframe order, each followed by a space.

    ``pages(page_id, url, html)``; ``targets`` (default: ``pages``) supplies
    ``(url, html)`` of the framed documents; of several with one URL the
    longest text stands for it. Pages that are their own targets are tokenised
    once, for both.
    """
    from ..session import materialise
    both = targets is None
    p = materialise(pages.select("page_id", "url", iframe_sources("html").alias("frame_sources"),
                                 *([body_text("html").alias("body")] if both else [])), "framing_pages")
    return framed_text(p, p if both else targets.select("url", body_text("html").alias("body")))


def framed_text(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """:func:`iframe_text` of tokenised pages: ``pages(page_id, url, frame_sources)`` and
    ``targets(url, body)``. Only targets that some page frames go on, as text: HTML is
    never shuffled. Whether the narrow frame table is broadcast is left to Spark,
    which knows its size from the written files."""
    from ..functions.urls import resolve
    from ..session import materialise
    frames = (pages.select("page_id", "url", F.posexplode_outer("frame_sources").alias("ipos", "src"))
              .where(F.col("src").isNotNull())
              .select("page_id", "ipos", resolve(F.col("url"), strip("src")).alias("target")))
    frames = materialise(frames, "iframes")
    texts = (targets.select(F.col("url").alias("target"), F.col("body").alias("ttext"))
             .where(F.length("ttext") > 50).join(frames.select("target").distinct(), "target", "left_semi")
             .groupBy("target").agg(F.max_by("ttext", F.struct(F.length("ttext"), "ttext")).alias("ttext")))
    joined = frames.join(texts, "target", "left")
    agg = (joined.groupBy("page_id")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ipos", "ttext"))),
                                         lambda s: F.concat(s["ttext"], F.lit(" "))), "").alias("iframe_text")))
    return pages.select("page_id").join(agg, "page_id", "left").select(
        "page_id", F.coalesce("iframe_text", F.lit("")).alias("iframe_text"))


def with_iframe_text(rows: DataFrame, name: str = "iframe_content_extraction") -> DataFrame:
    """``rows(page_id, url, frame_sources, body, ...)``, written already, with the iframe text
    of their ``page_id`` (empty if there is none). The rows are the targets, too."""
    found = framed_text(rows, rows).where(F.col("iframe_text") != "").dropDuplicates(["page_id"]).select("page_id", F.col("iframe_text").alias(name))
    return rows.join(found, "page_id", "left").withColumn(name, F.coalesce(name, F.lit("")))


# ---- B17: best snapshot ----
def best_snapshot(polls: DataFrame, key: str, poll: str, text: str,
                  stop_len: int = 1000, max_polls: int = 20) -> DataFrame:
    """Per key, the longest text over polls that holds no placeholder;
    polling stops after the first poll whose best so far exceeds
    ``stop_len`` chars, or after ``max_polls`` polls. Ties keep the earlier poll."""
    from pyspark.sql import Window as W
    ok = ~F.lit(False)
    for p in L.SNAPSHOT_PLACEHOLDERS:
        ok = ok & ~F.col("t").contains(p)
    w = W.partitionBy(key).orderBy(poll).rowsBetween(W.unboundedPreceding, W.currentRow)
    p = (polls.select(key, poll, F.coalesce(F.col(text), F.lit("")).alias("t"))
         .withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(poll)))
         .where(F.col("rank") <= max_polls)
         .withColumn("cand", F.when(ok, F.length("t")).otherwise(F.lit(-1)))
         .withColumn("best_len", F.max("cand").over(w)))
    stop = p.where(F.col("best_len") > stop_len).groupBy(key).agg(F.min("rank").alias("stop_rank"))
    q = p.join(stop, key, "left").where(F.col("stop_rank").isNull() | (F.col("rank") <= F.col("stop_rank")))
    best = F.max_by(F.struct(F.col("cand").alias("len"), (-F.col("rank")).alias("neg_rank"), F.col("t")),
                    F.struct(F.col("cand"), -F.col("rank")))
    return (q.groupBy(key).agg(best.alias("b"), F.max("rank").alias("polls_used"))
            .select(key, F.when(F.col("b.len") >= 0, F.col("b.t")).otherwise(F.lit("")).alias("best_text"),
                    F.when(F.col("b.len") >= 0, -F.col("b.neg_rank")).cast("bigint").alias("best_poll"),
                    F.col("polls_used").cast("bigint").alias("polls_used")))


# ---- B18: markdown -> plain text ----
@expr_cache
def markdown_to_text(md) -> Column:
    """Headers, bold/italic, links (keep text), code fences, inline code,
    list markers, blank-line runs; in this order, then strip."""
    t = col(md)
    steps = [
        (r"(?md)^#+\s*", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"__([^_]+)__", "$1"),
        (r"_([^_]+)_", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?s)```[^`]*```", ""),
        (r"`([^`]+)`", "$1"),
        (r"(?md)^\s*[-*+]\s+", ""),
        (r"(?md)^\s*\d+\.\s+", ""),
        (r"\n\s*\n", "\n\n"),
    ]
    for p, r in steps:
        t = F.regexp_replace(t, p, r)
    return strip(t)
