"""Link extraction, classification, ranking and statistics.

Links are built inside the page row as an ``array<struct>``: anchors are the
``a`` nodes of the page, resolved, classified and de-duplicated with
higher-order functions. The whole link pipeline is therefore narrow
(no shuffle), and ``html`` can be dropped right after it. Explode only when
a long table is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import col, expr_cache, strip
from ..functions.urls import is_internal, resolve
from .nodes import let, nodes, part, texts_of

def _any_contains(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | (F.instr(c, n) > 0)
    return out


def link_type(url: Column, text: Column, classes: Column) -> Column:
    """First matching rule; all substring tests on lower-cased values."""
    u, t, c = F.lower(url), F.lower(text), F.lower(classes)
    return (F.when(_any_contains(u, L.DOWNLOAD_EXTENSIONS), "download")
            .when(_any_contains(u, L.MEDIA_EXTENSIONS), "media")
            .when(u.startswith("mailto:"), "email")
            .when(u.startswith("tel:"), "phone")
            .when(_any_contains(u, L.SOCIAL_DOMAINS), "social")
            .when(_any_contains(t, L.NAV_INDICATORS), "navigation")
            .when(_any_contains(t, L.CONTENT_INDICATORS), "content")
            .when(_any_contains(c, ["button", "btn"]), "button")
            .when(_any_contains(c, ["nav", "menu"]), "navigation")
            .otherwise("content"))


@expr_cache
def extract_links(html, base_url, parsed=None) -> Column:
    """D1-D4 as ``array<struct<url, text, is_internal, link_type>>``: every
    ``<a href>`` except empty, ``#...`` and ``javascript:...``; text falls back
    to the title, then the href; cut to 200 chars; duplicate URLs removed,
    first kept."""
    base = col(base_url)
    def anchor(n, x):
        attr = lambda name: F.coalesce(strip(F.element_at(x["attrs"], name)), F.lit(""))
        return F.struct(attr("href").alias("href"),
                        F.array_join(F.transform(texts_of(part(n, x)), lambda t: strip(t)), "").alias("atext"),
                        attr("title").alias("title"), F.array_join(x["classes"], " ").alias("classes"))

    # Comments and scripts are nodes of their own, so no link is found in them;
    # empty or NULL input gives an empty list, never NULL.
    raw = let(nodes(html, parsed), lambda n: F.transform(
        F.filter(n, lambda x: (x["tag"] == "a") & F.element_at(x["attrs"], "href").isNotNull()), lambda x: anchor(n, x)))
    kept = F.filter(raw, lambda x: (x["href"] != "") & ~x["href"].startswith("#")
                    & ~x["href"].startswith("javascript:"))
    full = F.transform(kept, lambda x: x.withField("url", resolve(base, x["href"])))
    typed = F.transform(full, lambda x: F.struct(
        x["url"].alias("url"),
        F.left(F.coalesce(F.nullif(x["atext"], F.lit("")), F.nullif(x["title"], F.lit("")), x["href"]),
               F.lit(L.LINK_TEXT_MAX)).alias("text"),
        is_internal(x["url"], base).alias("is_internal"),
        link_type(x["url"], F.coalesce(F.nullif(x["atext"], F.lit("")), F.nullif(x["title"], F.lit("")), x["href"]),
                  x["classes"]).alias("link_type")))
    return typed


def _dedupe_sorted(sorted_links) -> Column:
    """Keep the first element of each URL run of an array sorted by (url, pos),
    then restore position order. ``sorted_links`` must be a column: it is
    referenced twice, so Catalyst keeps it materialised instead of
    re-evaluating it inside the lambda."""
    s = col(sorted_links)
    firsts = F.filter(s, lambda y, j: (j == 0) | (F.get(s, j - 1)["u"] != y["u"]))
    return F.transform(F.array_sort(F.transform(firsts, lambda y: F.struct(y["p"], y["l"]))),
                       lambda z: z["l"])


def with_links(pages: DataFrame, html: str = "html", url: str = "url", out: str = "links", parsed=None) -> DataFrame:
    """Add ``links`` (D1-D4, G8: first link per URL kept) to each page row.
    Narrow, no shuffle: de-duplication sorts inside the row, O(n log n)."""
    keyed = F.transform(extract_links(html, url, parsed),
                        lambda x, i: F.struct(x["url"].alias("u"), i.alias("p"), x.alias("l")))
    return (pages.withColumn("_sorted_links", F.array_sort(keyed))
            .withColumn(out, _dedupe_sorted("_sorted_links")).drop("_sorted_links"))


def _prio(t: Column) -> Column:
    out = F.lit(L.LINK_TYPE_PRIORITY["unknown"])
    for k, v in L.LINK_TYPE_PRIORITY.items():
        out = F.when(t == k, F.lit(v)).otherwise(out)
    return out


@expr_cache
def rank_links(links, max_links: int = L.MAX_LINKS) -> Column:
    """Internal first, then type priority, stable by position; keep ``max_links``."""
    keyed = F.transform(col(links), lambda x, i: F.struct(
        (~x["is_internal"]).alias("ext"), _prio(x["link_type"]).alias("prio"), i.alias("pos"), x.alias("link")))
    ranked = F.transform(F.array_sort(keyed), lambda k: k["link"])
    return F.slice(ranked, 1, max_links)


@expr_cache
def link_stats(links) -> Column:
    """Totals, per-type counts and internal ratio (rounded half-even)."""
    ls = col(links)
    total = F.size(ls)
    internal = F.size(F.filter(ls, lambda x: x["is_internal"]))
    types = F.create_map(*[e for t in L.LINK_TYPE_PRIORITY for e in
                           (F.lit(t), F.size(F.filter(ls, lambda x: x["link_type"] == t)))])
    return F.struct(
        total.cast("bigint").alias("total_links"), internal.cast("bigint").alias("internal_links"),
        (total - internal).cast("bigint").alias("external_links"),
        F.map_filter(types, lambda k, v: v > 0).alias("link_types"),
        F.when(total > 0, F.bround(internal / total, 2)).otherwise(F.lit(0.0)).alias("internal_ratio"))


def explode_links(df: DataFrame, links: str = "links", keep=("page_id",)) -> DataFrame:
    """Long form: one row per link with its 1-based position.

    ``posexplode_outer`` + a null filter: plain ``posexplode`` makes Catalyst
    infer ``size(links) > 0`` below the generator, which evaluates the whole
    link expression a second time."""
    return df.select(*keep, F.posexplode_outer(links).alias("pos", "l")).where(F.col("pos").isNotNull()).select(
        *keep, (F.col("pos") + 1).cast("bigint").alias("link_pos"), "l.url", "l.text", "l.is_internal", "l.link_type")
