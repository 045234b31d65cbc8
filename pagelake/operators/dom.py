"""Extractors over page nodes (B1, B2, B4, B10, B11, B12), as native columns.

Pages are tokenised once (:mod:`.nodes`); each extractor here is a rule over
the node array, and Catalyst drops those that a query does not use. Work that
spans pages -- blocks repeated across a host's pages -- is a Spark aggregate
over narrow rows: block texts stay in their page's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import collapse_ws, strip
from . import marks as M
from . import nodes as N

LOOSE_PARENTS = ("div", "article", "main", "section", "body")
#: Least characters of a block and most of them in links, by preference.
PREFERENCE = {"precision": (50, 0.3), "none": (25, 0.6), "recall": (10, 0.9)}


def _plain(n: Column, x: Column, mark: bool) -> Column:
    """A block's text without boilerplate inside it; bold and italics marked for markdown."""
    def piece(t):
        if not mark:
            return t["text"]
        return (F.when(t["ptag"].isin("b", "strong"), F.concat(F.lit("**"), collapse_ws(t["text"]), F.lit("**")))
                .when(t["ptag"].isin("i", "em"), F.concat(F.lit("*"), collapse_ws(t["text"]), F.lit("*"))).otherwise(t["text"]))
    kept = F.filter(N.part(n, x), lambda t: (t["tag"] == "#text") & ~N.inside(t, M.BOILER))
    return collapse_ws(F.array_join(F.transform(kept, piece), ""))


def content_blocks(nodes: Column, fmt: str = "text") -> Column:
    """B1 blocks in page order: ``array<struct<pos, tag, text, link_chars>>`` of the
    outermost block elements outside boilerplate, and of loose text in containers."""
    markdown = fmt in ("markdown", "raw_markdown")

    def render(n, x):
        cells = F.filter(F.transform(F.filter(N.part(n, x), lambda c: c["tag"].isin("td", "th")),
                                     lambda c: _plain(n, c, markdown)), lambda t: t != "")
        row = F.array_join(cells, " | " if markdown else " ")
        text = _plain(n, x, markdown)
        if markdown:
            row = F.when(F.size(cells) > 0, F.concat(F.lit("| "), row, F.lit(" |"))).otherwise(F.lit(""))
            text = (F.when(text == "", text).when(x["tag"].rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(x["tag"], 2, 1).cast("int")), F.lit(" "), text))
                    .when(x["tag"] == "li", F.concat(F.lit("- "), text)).otherwise(text))
        return F.when(x["tag"] == "tr", row).otherwise(text)

    def links(n, x):
        anchors = F.filter(N.part(n, x), lambda a: a["tag"] == "a")
        return F.aggregate(F.transform(anchors, lambda a: F.length(collapse_ws(N.content(n, a)))), F.lit(0), lambda s, k: s + k)

    def assembled(n, body):
        blocks = F.filter(body, lambda x: N.outermost(x, M.BLOCK) & ~N.inside(x, M.BOILER))
        loose = F.filter(body, lambda t: (t["tag"] == "#text") & t["ptag"].isin(*LOOSE_PARENTS) & ~N.inside(t, M.BOILER | M.BLOCK))
        return F.array_sort(F.filter(F.concat(
            F.transform(blocks, lambda x: F.struct(x["pos"].alias("pos"), x["tag"].alias("tag"), render(n, x).alias("text"),
                                                   F.when(x["tag"] == "tr", 0).otherwise(links(n, x)).alias("link_chars"))),
            F.transform(loose, lambda t: F.struct(t["pos"].alias("pos"), F.lit("text").alias("tag"), collapse_ws(t["text"]).alias("text"), F.lit(0).alias("link_chars")))),
            lambda b: b["text"] != ""))

    return N.let(nodes, lambda n: N.let(N.body_nodes(n), lambda body: assembled(n, body)))


def main_text(blocks: Column, preference: str = "none") -> Column:
    """B1: the blocks that are long enough for the preference, headings or table
    rows, and no link lists."""
    least, links = PREFERENCE.get(preference, PREFERENCE["none"])
    keep = F.filter(blocks, lambda b: ((F.length(b["text"]) >= least) | b["tag"].startswith("h") | (b["tag"] == "tr"))
                    & (b["link_chars"] <= links * F.greatest(F.length(b["text"]), F.lit(1))))
    return strip(F.array_join(F.transform(keep, lambda b: b["text"]), "\n"))


def body_text(nodes: Column) -> Column:
    """``textContent`` of the body, scripts and styles included."""
    return N.let(nodes, lambda n: F.array_join(N.texts_of(N.body_nodes(n)), ""))


def visible_text(nodes: Column) -> Column:
    """``textContent`` of the body without its script and style elements."""
    return N.let(nodes, lambda n: F.array_join(N.texts_of(F.filter(N.body_nodes(n), lambda t: ~t["ptag"].isin("script", "style"))), ""))


def svg_text(nodes: Column) -> Column:
    """B12, svg half: trimmed texts over 2 characters of the text, tspan, title and desc
    elements of each svg element, in page order (a nested one repeats its text), joined by a space."""
    def rule(n):
        drawn = F.flatten(F.transform(F.filter(N.body_nodes(n), lambda x: x["tag"] == "svg"),
                                      lambda s: F.filter(N.part(n, s), lambda x: x["tag"].isin("text", "tspan", "title", "desc"))))
        return strip(F.array_join(F.filter(F.transform(drawn, lambda x: strip(N.content(n, x))), lambda t: F.length(t) > 2), " "))
    return N.let(nodes, rule)


def data_values(nodes: Column) -> Column:
    """All ``data-*`` values over 10 characters, in page order and then by place in the element."""
    return N.let(nodes, lambda n: F.filter(F.flatten(F.transform(
        F.filter(n, lambda x: F.size(x["attrs"]) > 0),
        lambda x: F.map_values(F.map_filter(x["attrs"], lambda k, v: k.startswith("data-"))))), lambda v: F.length(v) > 10))


def comments(nodes: Column) -> Column:
    """Comments over 20 characters in the body, but such that hold another's start."""
    return N.let(nodes, lambda n: F.transform(F.filter(N.body_nodes(n), lambda x: (x["tag"] == "#comment") & (F.length(x["text"]) > 20) & ~x["text"].contains("<!--")),
                                              lambda x: x["text"]))


def frame_sources(nodes: Column) -> Column:
    """``src`` of the iframe elements, in page order (none from comments and scripts)."""
    return N.let(nodes, lambda n: F.filter(F.transform(F.filter(n, lambda x: x["tag"] == "iframe"), lambda x: F.element_at(x["attrs"], "src")),
                                           lambda v: v.isNotNull()))


def full_text(nodes: Column) -> Column:
    """All text of the body outside scripts and styles."""
    return N.let(nodes, lambda n: N.let(N.body_nodes(n), lambda body: collapse_ws(F.array_join(N.texts_of(
        F.filter(body, lambda t: ~t["ptag"].isin("script", "style"))), ""))))


def page_title(nodes: Column) -> Column:
    return N.let(nodes, lambda n: F.coalesce(collapse_ws(N.content(n, F.get(F.filter(n, lambda x: x["tag"] == "title"), F.lit(0)))), F.lit("")))


def readable_text(nodes: Column) -> Column:
    """Trimmed text nodes of at least 10 characters outside the skip selectors
    and outside elements hidden in the markup, joined by one space."""
    return N.let(nodes, lambda n: strip(F.array_join(F.filter(
        F.transform(N.texts_of(F.filter(N.body_nodes(n), lambda t: ~N.inside(t, M.SKIP))), lambda t: strip(t)),
        lambda t: F.length(t) >= L.READABLE_MIN), " ")))


def selector_text(nodes: Column) -> Column:
    """Text of the first existing main selector (by selector order), else of the body."""
    def first(n, body):
        def one_or(other):
            return lambda x: F.when(x.isNotNull(), N.content(n, x)).otherwise(other)

        out = F.array_join(N.texts_of(body), "")

        def choose(found):
            text = out
            for sel in reversed(L.MAIN_SELECTORS):
                text = N.let(F.get(F.filter(found, N.is_a(sel)), F.lit(0)), one_or(text))
            return strip(text)
        return N.let(N.candidates(body, L.MAIN_SELECTORS), choose)
    return N.let(nodes, lambda n: N.let(N.body_nodes(n), lambda body: first(n, body)))


def targeted_text(nodes: Column) -> Column:
    """Texts over 100 characters of the main-content selectors, by selector and
    then page order; if these are under 100 in all, also texts over 50 characters
    of content containers outside navigation."""
    def rule(n):
        some = N.candidates(n, [*L.TARGET_SELECTORS, *L.TARGET_CONTAINERS])
        targets = N.let(some, lambda c: F.concat(*[F.filter(c, N.is_a(s)) for s in L.TARGET_SELECTORS]))
        main = N.each_text(n, targets, lambda t: F.length(t) > 100)
        boxes = F.filter(some, lambda x: N.any_match(x, L.TARGET_CONTAINERS) & ~N.inside(x, M.TARGET_SKIP))
        return N.let(main, lambda m: strip(F.when(F.length(m) < 100, F.concat(m, N.each_text(n, boxes, lambda t: F.length(t) > 50))).otherwise(m)))
    return N.let(nodes, rule)


def educational_text(nodes: Column) -> Column:
    """Texts over 20 characters of text-like elements outside navigation that
    are no bare menu word, by selector and then page order (nested matches repeat
    their text); if these are under 200 in all, also the texts around canvas and
    svg elements and long data attributes."""
    def rule(n):
        found = N.let(F.filter(N.candidates(n, L.EDU_SELECTORS), lambda x: ~N.inside(x, M.EDU_SKIP)),
                      lambda c: F.concat(*[F.filter(c, N.is_a(s)) for s in L.EDU_SELECTORS]))
        blocks = N.each_text(n, found, lambda t: (F.length(t) > 20) & ~t.rlike(L.EDU_MENU_WORD))
        drawn = F.transform(F.filter(n, lambda x: x["tag"].isin("canvas", "svg") & (x["parent"] >= 0)), lambda x: F.get(n, x["parent"]))
        around = N.each_text(n, drawn, lambda t: F.length(t) > 50)
        values = F.transform(n, lambda x: F.coalesce(*[F.nullif(F.element_at(x["attrs"], a), F.lit("")) for a in L.EDU_DATA_ATTRIBUTES], F.lit("")))
        data = F.array_join(F.transform(F.filter(values, lambda v: F.length(v) > 20), lambda v: F.concat(v, F.lit(" "))), "")
        return N.let(blocks, lambda b: strip(F.when(F.length(b) < 200, F.concat(b, around, data)).otherwise(b)))
    return N.let(nodes, rule)


def container_text(nodes: Column) -> Column:
    """B12, container half: texts between 50 and 2000 characters of the container
    selectors that hold an educational keyword, by selector and then page order."""
    def rule(n):
        found = F.concat(*[F.filter(n, N.is_a(s)) for s in L.SVG_CONTAINERS])
        keyword = "|".join(L.EDU_KEYWORDS)
        return strip(N.each_text(n, found, lambda t: (F.length(t) > 50) & (F.length(t) < 2000) & F.lower(t).rlike(keyword)))
    return N.let(nodes, rule)


def dom_pass(pages: DataFrame, output_format: str = "text", preference: str = "none",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """``page_id`` and all extractors' columns: ``title``, ``main_text``, ``full_text``,
    ``readable_text``, ``targeted_text``, ``educational_text``, ``container_text``,
    ``blocks``. Pages are tokenised once; columns that a query drops are not
    computed. ``keep`` names columns passed on."""
    d = pages.select("page_id", N.nodes("html").alias("_nodes"), *keep)
    n = F.col("_nodes")
    d = d.withColumn("blocks", content_blocks(n, output_format))
    return d.select("page_id", page_title(n).alias("title"), main_text(F.col("blocks"), preference).alias("main_text"),
                    full_text(n).alias("full_text"), readable_text(n).alias("readable_text"), targeted_text(n).alias("targeted_text"),
                    educational_text(n).alias("educational_text"), container_text(n).alias("container_text"), "blocks", *keep)


def main_text_dedup(pages: DataFrame, min_pages: int = 3, preference: str = "none") -> DataFrame:
    """B1 with boilerplate found across pages: a block whose text is on at least
    ``min_pages`` pages of the host is dropped. One row per page, also if
    nothing is left of it.

    Blocks are materialised once. Only (host, hash, page, place) is shuffled to
    find the repeated ones; their places come back per page, and the page's
    own block array is filtered in its row."""
    from ..functions.urls import hostname
    from ..session import materialise
    d = materialise(dom_pass(pages, "text", preference, keep=("url",)).select("page_id", hostname("url").alias("host"), "blocks"), "dom_blocks")
    b = d.select("page_id", "host", F.explode("blocks").alias("b")).select("page_id", "host", "b.pos", F.xxhash64("b.text").alias("h"))
    rep = (b.select("host", "h", "page_id").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
           .where(F.col("n") >= min_pages).select("host", "h"))
    drop = b.join(rep, ["host", "h"], "left_semi").groupBy("page_id").agg(F.collect_set("pos").alias("drop"))
    left = F.filter("blocks", lambda x: ~F.array_contains(F.coalesce(F.col("drop"), F.array().cast("array<int>")), x["pos"]))
    return d.join(drop, "page_id", "left").select("page_id", left.alias("blocks")) \
            .select("page_id", main_text(F.col("blocks"), preference).alias("main_text"))

