"""Catalog entries for links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import links as LK
from ..sources.seeded import seeded, with_clause
from . import duck as D
from .catalog import register

SP = with_clause("seeded_pages")

# The oracle's own reading of anchors, for pages as regular as the fixtures.
ANCHOR = r"(?is)<a\b[^>]*>.*?</a\s*>"
HREF = r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
OPEN_TAG = r"(?is)^(<a\b[^>]*>)"
INNER = r"(?is)^<a\b[^>]*>(.*)</a\s*>$"
HAS_HREF = r"(?is)^<a\b[^>]*?\shref\b"


def _d_attr(tag: str, name: str) -> str:
    return D.strip(D.decode(f"regexp_extract({tag}, {D.lit(rf'(?is)\s{name}\s*=\s*\"([^\"]*)\"')}, 1)"))


def _d_link_type(u: str, t: str, c: str) -> str:
    u, t, c = f"lower({u})", f"lower({t})", f"lower({c})"
    return (f"(CASE WHEN {D.any_contains(u, L.DOWNLOAD_EXTENSIONS)} THEN 'download' "
            f"WHEN {D.any_contains(u, L.MEDIA_EXTENSIONS)} THEN 'media' "
            f"WHEN starts_with({u}, 'mailto:') THEN 'email' WHEN starts_with({u}, 'tel:') THEN 'phone' "
            f"WHEN {D.any_contains(u, L.SOCIAL_DOMAINS)} THEN 'social' "
            f"WHEN {D.any_contains(t, L.NAV_INDICATORS)} THEN 'navigation' "
            f"WHEN {D.any_contains(t, L.CONTENT_INDICATORS)} THEN 'content' "
            f"WHEN {D.any_contains(c, ['button', 'btn'])} THEN 'button' "
            f"WHEN {D.any_contains(c, ['nav', 'menu'])} THEN 'navigation' ELSE 'content' END)")


def _href(n: int) -> str:
    return f"regexp_extract(a, {D.lit(HREF)}, {n})"


_OPEN = f"regexp_extract(a, {D.lit(OPEN_TAG)}, 1)"
_INNER = f"regexp_extract(a, {D.lit(INNER)}, 1)"
_ATEXT = (f"array_to_string(list_transform(regexp_split_to_array({D.drop_comments(_INNER)}, {D.lit(D.TAG)}), "
          f"lambda x: {D.strip(D.decode('x'))}), '')")

LINKS_CTE = f"""a0 AS (SELECT page_id, url AS base, regexp_extract_all(html, {D.lit(ANCHOR)}, 0) AS anchors FROM seeded_pages),
a1 AS (SELECT page_id, base, unnest(anchors) AS a, generate_subscripts(anchors, 1) AS apos FROM a0),
a2 AS (SELECT page_id, base, apos, {D.strip(D.decode(f"concat({_href(1)}, {_href(2)}, {_href(3)})"))} AS href,
              {_ATEXT} AS atext, {_d_attr(_OPEN, 'title')} AS title,
              regexp_replace({_d_attr(_OPEN, 'class')}, {D.lit(r'\s+')}, ' ', 'g') AS classes
       FROM a1 WHERE regexp_matches(a, {D.lit(HAS_HREF)})),
a3 AS (SELECT *, {D.resolve('base', 'href')} AS url,
              coalesce(nullif(atext, ''), nullif(title, ''), href) AS ltext
       FROM a2 WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')),
a4 AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY apos) AS rn FROM a3),
lk AS (SELECT page_id, url, left(ltext, {L.LINK_TEXT_MAX}) AS text, {D.is_internal('url', 'base')} AS is_internal,
              {_d_link_type('url', 'ltext', 'classes')} AS link_type,
              CAST(row_number() OVER (PARTITION BY page_id ORDER BY apos) AS BIGINT) AS link_pos
       FROM a4 WHERE rn = 1)"""


def _pages_with_links(spark, sf):
    return LK.with_links(seeded(spark, sf, "seeded_pages").select("page_id", "url", "html")).drop("html")


@register("links", SP + f", {LINKS_CTE}\nSELECT page_id, link_pos, url, text, is_internal, link_type FROM lk")
def q_links(spark, sf):
    """Every link of every page, resolved, classified, de-duplicated."""
    return LK.explode_links(_pages_with_links(spark, sf))


_PRIO = "CASE link_type " + " ".join(f"WHEN {D.lit(k)} THEN {v}" for k, v in L.LINK_TYPE_PRIORITY.items()) + " ELSE 9 END"


@register("link_rank", SP + f""", {LINKS_CTE},
r AS (SELECT page_id, url, link_type, is_internal,
             row_number() OVER (PARTITION BY page_id ORDER BY NOT is_internal, {_PRIO}, link_pos) AS rnk FROM lk)
SELECT page_id, CAST(rnk AS BIGINT) AS rank, url, link_type, is_internal FROM r WHERE rnk <= {L.MAX_LINKS}""")
def q_link_rank(spark, sf):
    """Internal first, then type priority, stable; top 100 per page."""
    p = _pages_with_links(spark, sf).select("page_id", LK.rank_links("links").alias("ranked"))
    return p.select("page_id", F.posexplode_outer("ranked").alias("rank", "l")).where("rank IS NOT NULL").select(
        "page_id", (F.col("rank") + 1).cast("bigint").alias("rank"), "l.url", "l.link_type", "l.is_internal")


_TYPES = list(L.LINK_TYPE_PRIORITY)


@register("link_stats", SP + f""", {LINKS_CTE},
s AS (SELECT page_id, count(*) AS total, count_if(is_internal) AS internal,
             {", ".join(f"count_if(link_type = {D.lit(t)}) AS n_{t}" for t in _TYPES)} FROM lk GROUP BY page_id)
SELECT p.page_id, CAST(coalesce(total, 0) AS BIGINT) AS total_links, CAST(coalesce(internal, 0) AS BIGINT) AS internal_links,
  CAST(coalesce(total, 0) - coalesce(internal, 0) AS BIGINT) AS external_links,
  CASE WHEN coalesce(total, 0) > 0 THEN round_even(CAST(internal AS DOUBLE) / total, 2) ELSE 0.0 END AS internal_ratio,
  {", ".join(f"CAST(coalesce(n_{t}, 0) AS BIGINT) AS n_{t}" for t in _TYPES)}
FROM seeded_pages p LEFT JOIN s ON p.page_id = s.page_id""")
def q_link_stats(spark, sf):
    """Per-page link totals, internal ratio and counts per type."""
    p = _pages_with_links(spark, sf).select("page_id", LK.link_stats("links").alias("s"))
    return p.select("page_id", "s.total_links", "s.internal_links", "s.external_links", "s.internal_ratio",
                    *[F.coalesce(F.col("s.link_types")[t], F.lit(0)).cast("bigint").alias(f"n_{t}") for t in _TYPES])


@register("link_type_counts", SP + f", {LINKS_CTE}\n"
          "SELECT link_type, is_internal, count(*) AS n FROM lk GROUP BY link_type, is_internal")
def q_link_type_counts(spark, sf):
    """Link counts by type and internal flag over the corpus (partial
    aggregation before the shuffle; at most 18 groups)."""
    return (LK.explode_links(_pages_with_links(spark, sf))
            .groupBy("link_type", "is_internal").agg(F.count("*").alias("n")))
