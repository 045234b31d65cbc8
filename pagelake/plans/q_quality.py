"""Catalog entries for keyword hits, category and quality
and the flagship per-host roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.urls import hostname
from ..operators import html_text as H
from ..operators import links as LK
from ..operators import quality as Q
from ..sources.seeded import seeded, with_clause
from . import duck as D
from .catalog import register
from .q_html import _d_selector, BODY_CTE
from .q_links import LINKS_CTE


def d_quality_cols(text: str) -> str:
    """DuckDB select-list for the quality columns of ``text``."""
    return f"""CAST(length({D.strip(f"coalesce({text}, '')")}) AS BIGINT) AS n,
  {D.keyword_count(f"lower({D.strip(f'coalesce({text}, {chr(39)}{chr(39)})')})", L.ERROR_PAGE)} AS e,
  {D.keyword_count(f"lower({D.strip(f'coalesce({text}, {chr(39)}{chr(39)})')})", L.EDUCATIONAL_CONTENT)} AS c,
  {D.keyword_count(f"lower({D.strip(f'coalesce({text}, {chr(39)}{chr(39)})')})", L.EDUCATIONAL_METADATA)} AS m"""


D_CATEGORY = (f"CASE WHEN e > 0 AND n < {L.ERROR_PAGE_MAX_CHARS} THEN 'error_page' "
              "WHEN greatest(c, m, e) = 0 THEN 'other' WHEN c = greatest(c, m, e) THEN 'educational_content' "
              "WHEN m = greatest(c, m, e) THEN 'educational_metadata' ELSE 'error_page' END")
D_CONFIDENCE = (f"CASE WHEN e > 0 AND n < {L.ERROR_PAGE_MAX_CHARS} THEN round_even(least(1.0, CAST(e AS DOUBLE) / greatest(e + c + m, 1)), 3) "
                "WHEN greatest(c, m, e) = 0 THEN 0.0 "
                "ELSE round_even(least(1.0, CAST(greatest(c, m, e) AS DOUBLE) / greatest(e + c + m, 1)), 3) END")


@register("quality", with_clause("seeded_documents") + f""",
k AS (SELECT doc_id, {d_quality_cols('text')} FROM seeded_documents)
SELECT doc_id, n AS character_length, {D_CATEGORY} AS content_category, CAST({D_CONFIDENCE} AS DOUBLE) AS confidence,
  e AS error_page, c AS educational_content, m AS educational_metadata FROM k""")
def q_quality(spark, sf):
    """Keyword hits, category and confidence for every document."""
    d = Q.with_quality(seeded(spark, sf, "seeded_documents"), "text")
    return d.select("doc_id", "quality_metrics.character_length", "quality_metrics.content_category",
                    "quality_metrics.confidence",
                    *[F.col(f"quality_metrics.matched_keywords.{k}").alias(k)
                      for k in ("error_page", "educational_content", "educational_metadata")])


@register("keyword_hits", with_clause("seeded_documents") + f""",
low AS (SELECT doc_id, lower({D.strip("coalesce(text, '')")}) AS t FROM seeded_documents),
k AS (SELECT doc_id, {D.keyword_count('t', L.ERROR_PAGE)} AS error_page,
             {D.keyword_count('t', L.EDUCATIONAL_CONTENT)} AS educational_content,
             {D.keyword_count('t', L.EDUCATIONAL_METADATA)} AS educational_metadata FROM low)
SELECT doc_id, category, hits FROM k
UNPIVOT (hits FOR category IN (error_page, educational_content, educational_metadata)) WHERE hits > 0""")
def q_keyword_hits(spark, sf):
    """Keyword hits per (document, category) by a join of tokens and of
    phrase starts with the lexicon table."""
    docs = seeded(spark, sf, "seeded_documents")
    return Q.keyword_hits_joined(docs, Q.lexicon_frame(spark), "doc_id", "text")


def host_rollup(pages):
    """Flagship: pages -> selector text -> links -> quality -> per-host roll-up.
    Narrow up to the aggregate; the aggregate is partial before the shuffle,
    so a host holding a third of all pages still sends one row per task."""
    # the text below the links: the other way round, Catalyst copies all of the
    # links' expressions into each of their readers
    p = pages.select("page_id", "url", "html", H.selector_text("html").alias("text"))
    p = LK.with_links(p).select("page_id", hostname("url").alias("host"), "text", LK.link_stats("links").alias("ls"))
    p = Q.with_quality(p, "text", "q")
    cats = ["error_page", "educational_content", "educational_metadata", "other"]
    g = p.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum("q.character_length").alias("chars"),
        F.sum("ls.total_links").alias("total_links"), F.sum("ls.internal_links").alias("internal_links"),
        *[F.count_if(F.col("q.content_category") == c).alias(f"n_{c}") for c in cats])
    return g.select(
        "host", "pages", F.bround(F.col("chars") / F.col("pages"), 2).alias("avg_text_chars"),
        "total_links", "internal_links",
        F.when(F.col("total_links") > 0, F.bround(F.col("internal_links") / F.col("total_links"), 4))
        .otherwise(F.lit(0.0)).alias("internal_ratio"),
        *[f"n_{c}" for c in cats])


@register("host_rollup", with_clause("seeded_pages") + f""", {BODY_CTE}, {LINKS_CTE},
t AS (SELECT page_id, {D.hostname('url')} AS host, {_d_selector('body')} AS text FROM b),
q AS (SELECT page_id, host, {d_quality_cols('text')} FROM t),
q2 AS (SELECT page_id, host, n, {D_CATEGORY} AS cat FROM q),
ls AS (SELECT page_id, count(*) AS tl, count_if(is_internal) AS il FROM lk GROUP BY page_id),
j AS (SELECT q2.*, coalesce(tl, 0) AS tl, coalesce(il, 0) AS il FROM q2 LEFT JOIN ls ON q2.page_id = ls.page_id),
g AS (SELECT host, count(*) AS pages, sum(n) AS chars, sum(tl) AS total_links, sum(il) AS internal_links,
        count_if(cat = 'error_page') AS n_error_page, count_if(cat = 'educational_content') AS n_educational_content,
        count_if(cat = 'educational_metadata') AS n_educational_metadata, count_if(cat = 'other') AS n_other
      FROM j GROUP BY host)
SELECT host, pages, round_even(CAST(chars AS DOUBLE) / pages, 2) AS avg_text_chars,
  CAST(total_links AS BIGINT) AS total_links, CAST(internal_links AS BIGINT) AS internal_links,
  CASE WHEN total_links > 0 THEN round_even(CAST(internal_links AS DOUBLE) / total_links, 4) ELSE 0.0 END AS internal_ratio,
  CAST(n_error_page AS BIGINT) AS n_error_page, CAST(n_educational_content AS BIGINT) AS n_educational_content,
  CAST(n_educational_metadata AS BIGINT) AS n_educational_metadata, CAST(n_other AS BIGINT) AS n_other FROM g""")
def q_host_rollup(spark, sf):
    return host_rollup(seeded(spark, sf, "seeded_pages"))
