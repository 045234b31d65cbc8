"""End-to-end extraction plans.

Both turn a table of requests and a table of fetched pages into the
``extractions`` record (one flat row per request, field for field the
reference's response model). Enrichments that are not asked for are
NULL columns, which Catalyst prunes. HTML is parsed once per page (one
DOM pass) and dropped before the request join; only text and small
structs cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.cascade import cascade_or_longest
from ..functions.text import strip
from ..operators import classify as C
from ..operators import dom as DM
from ..operators import html_text as H
from ..operators import lang as LG
from ..operators import links as LK
from ..operators import nodes as N
from ..operators import quality as Q
from ..sources.requests import normalise_requests

VERSION = __version__
LINK_TYPE = "array<struct<url:string,text:string,is_internal:boolean,link_type:string>>"
QUALITY_TYPE = ("struct<character_length:bigint,content_category:string,confidence:double,"
                "matched_keywords:struct<error_page:bigint,educational_content:bigint,educational_metadata:bigint>>")


def _lang(df: DataFrame, text: str, model: DataFrame | None, target_language: str, prefix: int | None,
          min_chars: int, default: str, threshold: float | None) -> DataFrame:
    if target_language != "auto":
        return df.withColumn("lang", F.lit(target_language))
    if model is None:
        return df.withColumn("lang", F.lit(default))
    det = LG.detect(df.select(F.col("page_id"), F.col(text)).where(F.length(strip(text)) > min_chars),
                    model, "page_id", text, prefix=prefix)
    lang = F.col("d.lang") if threshold is None else LG.label_with_threshold(F.col("d.lang"), F.col("d.confidence"))
    return (df.join(det.alias("d"), "page_id", "left")
            .withColumn("lang", F.coalesce(F.nullif(lang, F.lit(LG.UNKNOWN)), F.lit(default))).drop("score", "confidence"))


def _record(df: DataFrame, mode: str, include_links: bool, calculate_quality: bool,
            extra: list[Column] = ()) -> DataFrame:
    ok = F.col("reason") == "success"
    prov = C.provenance("reason")
    return df.select(
        "url", "text", F.col("http_status").alias("status"), "reason",
        F.when(ok, C.status_message(F.col("http_status"), F.length("text"))).otherwise(F.col("message")).alias("message"),
        F.when(ok, F.col("lang")).otherwise(F.lit("unknown")).alias("lang"),
        F.lit(mode).alias("mode"), F.col("url").alias("final_url"), F.lit(VERSION).alias("version"),
        F.lit(False).alias("converted"), F.lit(None).cast("string").alias("original_format"),
        F.lit(None).cast("double").alias("file_size_mb"), F.lit(None).cast("string").alias("proxy_used"),
        (F.when(ok, F.coalesce("links", F.array().cast(LINK_TYPE))).otherwise(F.array().cast(LINK_TYPE))
         if include_links else F.lit(None).cast(LINK_TYPE)).alias("links"),
        (F.when(ok, F.col("quality_metrics")) if calculate_quality else F.lit(None).cast(QUALITY_TYPE)).alias("quality_metrics"),
        F.lit(None).cast("double").alias("extraction_time"),
        prov["extraction_timestamp"].alias("extraction_timestamp"), prov["extraction_origin"].alias("extraction_origin"),
        *extra)


def _materialise(df: DataFrame, name: str = "page_results") -> DataFrame:
    """Checkpoint the per-page results (shared folder): downstream steps read
    them more than once, and the DOM pass must not run twice."""
    from ..session import materialise
    return materialise(df, name)


def _join_requests(reqs: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Requests ⟕ page results on URL; invalid, unmatched or empty -> error rows."""
    r = normalise_requests(reqs)
    # of several fetches of one URL the latest page stands for it
    columns = page_rows.columns
    page_rows = page_rows.groupBy("_purl").agg(F.max_by(F.struct(*columns), "page_id").alias("_p")).select("_p.*")
    j = r.join(page_rows, r["url"] == page_rows["_purl"], "left")
    has = F.col("_purl").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "")
    reason = F.when(F.col("reject_reason").isNull() & has, "success").otherwise("extraction_error")
    msg = (F.when(F.col("reject_reason").isNotNull(), F.concat(F.lit("Extraction failed: "), F.col("reject_reason")))
           .when(F.col("_purl").isNull(), F.lit("Extraction failed: no fetched page for this URL"))
           .otherwise(F.lit("Extraction failed: No text content could be extracted")))
    return j.select("*", reason.alias("reason"),
                    F.when(reason == "success", F.col("status")).otherwise(F.lit(500)).alias("http_status"),
                    msg.alias("message")).withColumn("text", F.when(F.col("reason") == "success", F.col("text")).otherwise(F.lit("")))


def simple_mode(requests: DataFrame, pages: DataFrame, lang_model: DataFrame | None = None,
                output_format: str = "markdown", target_language: str = "auto", preference: str = "none",
                include_links: bool = True, calculate_quality: bool = True) -> DataFrame:
    """§3.1: requests ⟕ pages -> main text (B1, DOM pass) -> language (C9,
    confidence > 0.5 else 'unknown') -> links (D1-D4, on HTML) -> quality
    (C1-C3) -> message and provenance (C21, C22)."""
    p = pages.select("page_id", "url", "html")
    if include_links:
        p = LK.with_links(p)
    d = DM.dom_pass(p, output_format, preference, keep=("url",) + (("links",) if include_links else ()))
    rows = d.select("page_id", F.col("url").alias("_purl"), F.col("main_text").alias("text"),
                    *(["links"] if include_links else []))
    rows = _materialise(rows)
    # Language depends only on the page text: detect it per page (on the
    # materialised page rows) before the request join.
    rows = _lang(rows, "text", lang_model, target_language, None, 0, "unknown", 0.5)
    j = _join_requests(requests.where(F.col("method") == "simple") if "method" in requests.columns else requests, rows)
    if calculate_quality:
        j = Q.with_quality(j, "text", "quality_metrics")
    return _record(j, "simple", include_links, calculate_quality)


def _page_main_text(nodes: Column) -> Column:
    return DM.main_text(DM.content_blocks(nodes))


def ultra_parts(html: str, parsed: str, embedded_json: Column, body: Column) -> tuple[Column, Column]:
    """B9 but the iframe strategy: the cascades of the strategies before and after it.
    Strategies that need live JavaScript objects (React fibre, Vue, shadow DOM) yield empty text."""
    n = F.col(parsed)
    placeholder = body.contains("JavaScript wird benötigt") | body.contains("Loading...")
    before = cascade_or_longest([
        ("embedded_json_extraction", embedded_json),
        ("svg_interactive_extraction", H.svg_text(html, parsed)),
        ("main_content_targeting", DM.targeted_text(n)),
        ("educational_content_extraction", DM.educational_text(n)),
        ("react_fiber_extraction", F.lit("")), ("vue_component_extraction", F.lit("")),
        ("shadow_dom_extraction", F.lit(""))], 500)
    after = cascade_or_longest([
        ("dynamic_content_polling", F.when(placeholder, F.lit("")).otherwise(body)),
        ("javascript_state_extraction", H.state_text(html)),
        ("aggressive_text_mining", H.mined_text(html, parsed))], 500)
    return before, after


def ultra_cascade(before: Column, iframe: Column, after: Column) -> Column:
    """B9 from its parts (:func:`ultra_parts`) and the iframe text: ``struct<text, strategy>`` of the
    first strategy over 500 chars, else the longest. The best of a run of strategies stands for it."""
    r = cascade_or_longest([("before", before["text"]), ("iframe_content_extraction", iframe), ("after", after["text"])], 500)
    return N.let(r, lambda x: F.struct(x["text"].alias("text"), F.when(x["strategy"] == "before", before["strategy"])
                                       .when(x["strategy"] == "after", after["strategy"]).otherwise(x["strategy"]).alias("strategy")))


def browser_mode(requests: DataFrame, pages: DataFrame, lang_model: DataFrame | None = None,
                 include_links: bool = True, calculate_quality: bool = True) -> DataFrame:
    """§3.2 over recorded pages: SPA score (C6) and ultra-complex score
    select the extractor -- embedded JSON first for kmap.eu hosts (B13,
    over 500 chars), the 11-strategy cascade for ultra-complex pages (B9),
    else the 4-strategy cascade with main text first (B7), the fallback
    reads for pages that stay empty (B8) -- then the error-page test (C4),
    links on the HTML, quality, and language on the first 1000 chars (more
    than 10 chars, default 'en'). ``extraction_method``, ``is_spa``,
    ``is_ultra_complex``, ``is_error_page`` and ``error_type`` are kept as
    columns (the reference only logs them).

    A page is tokenised once: its scores, texts, links and frames are read from
    the same nodes, and a page goes through the extractor that its scores select."""
    p = pages.select("page_id", "url", "html", N.nodes("html").alias("_nodes"))
    p = p.select("*", H.body_text("html", "_nodes").alias("body"), C.spa_score("html", parsed="_nodes")["is_spa"].alias("is_spa"),
                 C.ultra_complex_score("html", "url", parsed="_nodes")["is_ultra_complex"].alias("is_ultra_complex"))
    kmap = F.coalesce(F.lower(F.col("url")).contains("kmap.eu"), F.lit(False))
    special = kmap | F.col("is_ultra_complex")
    p = p.withColumn("embedded_json_extraction", F.when(special, H.embedded_json_text("html")))
    json = F.col("embedded_json_extraction")
    by_json = kmap & (F.length(json) > 500)
    if include_links:
        p = LK.with_links(p, parsed="_nodes")
    before, after = ultra_parts("html", "_nodes", json, F.col("body"))
    fallback = H.cascade_50("html", "_nodes")["text"]  # B8

    def or_fallback(text, other):
        return N.let(text, lambda t: F.when(strip(t) == "", other).otherwise(t))

    standard = H.cascade_500("html", _page_main_text, "_nodes")["text"]
    d = _materialise(p.select(
        "page_id", "url", "body", "is_spa", "is_ultra_complex", "embedded_json_extraction",
        F.when(special & ~by_json, before).alias("before"), F.when(special & ~by_json, after).alias("after"),
        F.when(special, fallback).alias("fallback"), F.when(~special, or_fallback(standard, fallback)).alias("standard"),
        DM.page_title(F.col("_nodes")).alias("title"), C.error_dom_label("html", "_nodes").alias("dom_error"),
        DM.frame_sources(F.col("_nodes")).alias("frame_sources"), *(["links"] if include_links else [])), "page_parts")
    d = H.with_iframe_text(d)
    ultra = ultra_cascade(F.col("before"), F.col("iframe_content_extraction"), F.col("after"))["text"]
    text = F.when(by_json, json).when(special, or_fallback(ultra, F.col("fallback"))).otherwise(F.col("standard"))
    method = (F.when(by_json, "embedded_json_extraction").when(F.col("is_ultra_complex"), "ultra_complex_spa")
              .when(F.col("is_spa"), "spa_optimized").otherwise("standard_optimized"))
    rows = (d.select("page_id", F.col("url").alias("_purl"), text.alias("text"), method.alias("extraction_method"),
                     "is_spa", "is_ultra_complex", "title", "dom_error", *(["links"] if include_links else []))
            .withColumn("_e", C.error_page_parts("title", "text", "dom_error")).drop("title", "dom_error"))
    rows = _lang(_materialise(rows), "text", lang_model, "auto", 1000, 10, "en", None)
    j = _join_requests(requests.where(F.col("method") == "browser") if "method" in requests.columns else requests, rows)
    if calculate_quality:
        j = Q.with_quality(j, "text", "quality_metrics")
    return _record(j, "browser", include_links, calculate_quality,
                   extra=[F.col("extraction_method"), F.col("is_spa"), F.col("is_ultra_complex"),
                          F.col("_e.is_error_page").alias("is_error_page"), F.col("_e.error_type").alias("error_type")])
