"""Catalog entries for classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import classify as C
from ..operators import html_text as H
from ..operators.dom import page_title
from ..operators.nodes import nodes
from ..sources import requests as R
from ..sources.seeded import seeded, with_clause
from . import duck as D
from .catalog import register
from .q_html import BODY_CTE, _d_readable, _d_selector

SP = with_clause("seeded_pages")
CASCADE_CTE = f"""{BODY_CTE},
cc AS (SELECT page_id, url, html, body, {_d_selector('body')} AS sel, {_d_readable('body')} AS rd,
              {D.strip(D.text_content('body'))} AS fu FROM b),
cas AS (SELECT page_id, url, html, body,
               CASE WHEN length(sel) > 500 THEN sel WHEN length(rd) > 500 THEN rd ELSE fu END AS content FROM cc)"""


def _labelled(x: str, pairs) -> str:
    return "(CASE " + " ".join(f"WHEN instr({x}, {D.lit(n)}) > 0 THEN {D.lit(lab)}" for n, lab in pairs) + " ELSE NULL END)"


def _d_sel(sel: str) -> str:
    return D.class_selector(sel[1:]) if sel[0] == "." else D.id_selector(sel[1:])


_DOM = "(CASE " + " ".join(
    f"WHEN regexp_matches(html, {D.lit('(?s)' + _d_sel(s))}) THEN {D.lit('dom_error_' + s.strip('.#'))}"
    for s in L.ERROR_SELECTORS) + " ELSE NULL END)"
_C = "lower(coalesce(content, ''))"
_ETYPE = f"""coalesce(
  {_labelled(f"lower({D.title_text('html')})", [(n, f"error_title_{n}") for n in L.ERROR_TITLES])},
  CASE WHEN coalesce(content, '') <> '' THEN {_labelled(_C, [(n, "http_error_" + n.replace(" ", "_")) for n in L.HTTP_ERRORS])} END,
  CASE WHEN coalesce(content, '') <> '' THEN {_labelled(_C, [(n, "security_challenge_" + n.replace(" ", "_")) for n in L.SECURITY_INDICATORS])} END,
  CASE WHEN coalesce(content, '') <> '' AND length({D.strip("coalesce(content, '')")}) < {L.SHORT_CONTENT_MAX}
       THEN {_labelled(_C, [(n, f"short_error_{n}") for n in L.SHORT_CONTENT_ERRORS])} END,
  {_DOM})"""


@register("error_page", SP + f""", {CASCADE_CTE},
e AS (SELECT page_id, {_ETYPE} AS error_type FROM cas)
SELECT page_id, error_type IS NOT NULL AS is_error_page, error_type FROM e""")
def q_error_page(spark, sf):
    """C4: error-page test on title, extracted content and DOM markers."""
    # all that reads the html stands below its readers, so none of it is copied into each of them
    p = seeded(spark, sf, "seeded_pages").select("page_id", page_title(nodes("html")).alias("title"), H.cascade_500("html")["text"].alias("content"),
                                                 C.error_dom_label("html").alias("dom_label"))
    return p.select("page_id", C.error_page_parts("title", "content", "dom_label").alias("e")).select(
        "page_id", "e.is_error_page", "e.error_type")


def _d_anyc(x, ns):
    return "(" + " OR ".join(f"contains({x}, {D.lit(n)})" for n in ns) + ")"


_H = "lower(coalesce(html, ''))"
_FW = [(n, _d_anyc(_H, ns)) for n, ns in L.SPA_FRAMEWORKS]
_STRUCT, _LOAD = _d_anyc(_H, L.SPA_STRUCTURE), _d_anyc(_H, L.SPA_LOADING)
_SCORE = " + ".join([f"(CASE WHEN {c} THEN 2 ELSE 0 END)" for _, c in _FW] +
                    [f"(CASE WHEN {_STRUCT} THEN 1 ELSE 0 END)", f"(CASE WHEN {_LOAD} THEN 1 ELSE 0 END)"])


@register("spa_indicators", SP + f"""
SELECT page_id,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN {D.lit(n)} END" for n, c in _FW)}], lambda x: x IS NOT NULL), '|') AS frameworks,
  CAST({_SCORE} AS BIGINT) AS score, ({_SCORE}) >= 2 AS is_spa,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN {D.lit(n + ' framework detected')} END" for n, c in _FW)},
     CASE WHEN {_STRUCT} THEN 'SPA structure indicators found' END,
     CASE WHEN {_LOAD} THEN 'Dynamic loading indicators found' END], lambda x: x IS NOT NULL), '|') AS characteristics
FROM seeded_pages""")
def q_spa_indicators(spark, sf):
    """SPA framework and structure indicators in raw HTML."""
    p = seeded(spark, sf, "seeded_pages").select("page_id", C.spa_indicators("html").alias("s"))
    return p.select("page_id", F.array_join("s.frameworks", "|").alias("frameworks"), "s.score", "s.is_spa",
                    F.array_join("s.characteristics", "|").alias("characteristics"))


def _m(p):
    return f"regexp_matches(html, {D.lit('(?s)' + p)})"


_REACT = f"({_m(D.attr_selector('data-reactroot'))} OR {_m(D.id_selector('root'))})"
_VUE = _m(D.attr_selector("data-v-"))
_ANG = f"({_m(D.attr_selector('ng-app'))} OR regexp_matches(html, {D.lit(r'(?i)<app-root\b')}))"
_DYN = "(" + " OR ".join([_m(D.attr_selector("data-testid")), _m(D.attr_selector("data-cy")),
                          _m(D.class_selector("loading")), _m(D.class_selector("spinner"))]) + ")"
_APP = "(" + " OR ".join([_m(D.id_selector("app")), _m(D.id_selector("root")), _m(D.class_selector("app"))]) + ")"
_S6 = f"(CASE WHEN {_REACT} THEN 2 ELSE 0 END + CASE WHEN {_VUE} THEN 2 ELSE 0 END + CASE WHEN {_ANG} THEN 2 ELSE 0 END + 1 + CASE WHEN {_DYN} THEN 1 ELSE 0 END + CASE WHEN {_APP} THEN 1 ELSE 0 END)"


@register("spa_score", SP + f"SELECT page_id, CAST({_S6} AS BIGINT) AS score, {_S6} >= 2 AS is_spa FROM seeded_pages")
def q_spa_score(spark, sf):
    """Static DOM SPA score (History API present, as in any browser)."""
    p = seeded(spark, sf, "seeded_pages").select("page_id", C.spa_score("html").alias("s"))
    return p.select("page_id", "s.score", "s.is_spa")


_BT = D.text_content("body")
_PH = "(" + " OR ".join(f"contains(bt, {D.lit(p)})" for p in L.PLACEHOLDER_TEXTS) + ")"
_DOMN = "(" + " OR ".join(f"contains(host, {D.lit(d)})" for d in L.COMPLEX_DOMAINS) + ")"
_S7 = (f"(CASE WHEN {_PH} THEN 3 ELSE 0 END + CASE WHEN starts_with(lower(url), 'https:') THEN 1 ELSE 0 END "
       f"+ CASE WHEN length({D.strip('bt')}) > 0 AND length({D.strip('bt')}) < 500 THEN 2 ELSE 0 END "
       f"+ CASE WHEN {_DOMN} THEN 1 ELSE 0 END)")


@register("ultra_complex", SP + f""", {BODY_CTE},
t AS (SELECT page_id, url, {_BT} AS bt, {D.hostname('url')} AS host FROM b)
SELECT page_id, CAST({_S7} AS BIGINT) AS score, {_S7} >= 4 AS is_ultra_complex FROM t""")
def q_ultra_complex(spark, sf):
    """Ultra-complex SPA score from placeholders, body size, scheme and host."""
    p = seeded(spark, sf, "seeded_pages").select("page_id", C.ultra_complex_score("html", "url").alias("s"))
    return p.select("page_id", "s.score", "s.is_ultra_complex")


_KW = " + ".join(f"CASE WHEN contains(low, {D.lit(k)}) THEN 1 ELSE 0 END" for k in L.EDU_KEYWORDS)


@register("educational_present", SP + f""", {BODY_CTE},
t AS (SELECT page_id, lower({_BT}) AS low, CAST(len(regexp_extract_all(html, {D.lit(r'(?i)<svg\b')}, 0)) AS BIGINT) AS svg FROM b)
SELECT page_id, CAST({_KW} AS BIGINT) AS keyword_count, svg AS svg_count, ({_KW}) >= 2 OR svg >= 5 AS has_educational_content FROM t""")
def q_educational_present(spark, sf):
    """Educational keywords in the body or many SVG elements."""
    p = seeded(spark, sf, "seeded_pages").select("page_id", C.educational_present("html").alias("s"))
    return p.select("page_id", "s.keyword_count", "s.svg_count", "s.has_educational_content")


@register("retryable", with_clause("fetch_log") + f"""
SELECT event_id, status, status IN ({", ".join(map(str, L.RETRYABLE_STATUS))}) AS is_retryable FROM fetch_log""")
def q_retryable(spark, sf):
    """C20: retryable status codes over the request log."""
    f = seeded(spark, sf, "fetch_log")
    return f.select("event_id", "status", C.is_retryable("status").alias("is_retryable"))


def _d_proxy_norm():
    kept = (f"list_transform(list_filter(proxies, lambda x: x IS NOT NULL AND {D.strip('x')} <> '' "
            f"AND lower({D.strip('x')}) NOT IN {D.in_list(L.NO_PROXY_VALUES)}), lambda x: {D.strip('x')})")
    return f"CASE WHEN len({kept}) > 0 THEN {kept} END"


_PERR = (f"list_filter(list_transform(pn, lambda x: CASE "
         f"WHEN NOT contains(x, ':') THEN concat('Invalid proxy format: ', x, '. Expected ''host:port''') "
         f"WHEN {D.strip('split_part(x, chr(58), 1)')} = '' OR {D.strip('substr(x, instr(x, chr(58)) + 1)')} = '' "
         f"THEN concat('Invalid proxy format: ', x, '. Host and port cannot be empty') "
         f"WHEN NOT regexp_matches(substr(x, instr(x, chr(58)) + 1), {D.lit(R.PORT)}) "
         f"THEN concat('Invalid proxy format: ', x, '. Port must be numeric') END), lambda e: e IS NOT NULL)[1]")


def _d_bound(name, lohi):
    lo, hi = lohi
    return f"CASE WHEN {name} IS NOT NULL AND ({name} < {lo} OR {name} > {hi}) THEN {D.lit(f'{name} must be between {lo} and {hi}')} END"


@register("request_normalise", with_clause("requests") + f""",
n AS (SELECT *, {_d_proxy_norm()} AS pn FROM requests)
SELECT request_id, array_to_string(pn, '|') AS proxies_norm,
  coalesce({_d_bound('max_file_size_mb', L.MAX_FILE_MB)}, {_d_bound('conversion_timeout', L.CONVERSION_TIMEOUT_S)},
           {_d_bound('timeout', L.REQUEST_TIMEOUT_S)}, {_PERR}) AS reject_reason
FROM n""")
def q_request_normalise(spark, sf):
    """A3: proxy-list normalisation and bounds, invalid rows get a reason."""
    r = R.normalise_requests(seeded(spark, sf, "requests"))
    return r.select("request_id", F.array_join("proxies_norm", "|").alias("proxies_norm"), "reject_reason")


_MSG = ("CASE WHEN status = 404 THEN concat('HTTP 404 detected, but ', CAST(length(t) AS VARCHAR), ' characters successfully extracted. This may be intentional anti-crawling behavior.') "
        "WHEN status >= 400 THEN concat('HTTP ', CAST(status AS VARCHAR), ' detected, but ', CAST(length(t) AS VARCHAR), ' characters successfully extracted. Content appears valid despite error status.') "
        "WHEN status = 200 THEN 'Text extracted successfully' "
        "ELSE concat('HTTP ', CAST(status AS VARCHAR), ' - Text extracted successfully (', CAST(length(t) AS VARCHAR), ' characters)') END")


@register("request_results", with_clause("seeded_pages", "requests") + f""", {BODY_CTE},
pt AS (SELECT url AS purl, {_d_selector('body')} AS t FROM b),
j AS (SELECT r.*, pt.purl, pt.t, pt.purl IS NOT NULL AND coalesce(pt.t, '') <> '' AS ok FROM requests r LEFT JOIN pt ON r.url = pt.purl)
SELECT request_id, url, purl IS NOT NULL AS matched, CASE WHEN ok THEN status ELSE 500 END AS http_status,
  CASE WHEN ok THEN 'success' ELSE 'extraction_error' END AS reason,
  CAST(CASE WHEN ok THEN length(t) ELSE 0 END AS BIGINT) AS text_length,
  CASE WHEN ok THEN {_MSG} WHEN purl IS NULL THEN 'Extraction failed: no fetched page for this URL'
       ELSE 'Extraction failed: No text content could be extracted' END AS message,
  CASE WHEN ok THEN 'realtime_crawl' ELSE 'realtime_crawl_error' END AS extraction_origin
FROM j""")
def q_request_results(spark, sf):
    """Requests left-joined to fetched pages; unmatched or empty
    pages become error records; status message and origin label."""
    pages = seeded(spark, sf, "seeded_pages")
    res = R.resolve_requests(seeded(spark, sf, "requests"), pages, H.selector_text("html"))
    return res.select("request_id", "url", "matched", "http_status", "reason",
                      F.length("text").cast("bigint").alias("text_length"), "message",
                      C.provenance("reason")["extraction_origin"].alias("extraction_origin"))
