"""Page classification: error pages, SPA signals, educational content,
retryable errors, status messages and provenance (C4-C8, C20-C22).

All native column expressions. Runtime-only browser facts (``window.React``,
History API, service workers) are optional boolean input columns; the
defaults are what any current browser reports.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import col, expr_cache, strip
from ..functions.urls import hostname
from .dom import body_text, page_title
from .nodes import any_match, candidates, is_a, let, nodes


def _labelled(c: Column, pairs) -> Column:
    """Label of the first (needle, label) pair whose needle ``c`` contains."""
    out = None
    for n, lab in reversed(pairs):
        out = F.when(F.instr(c, n) > 0, F.lit(lab)) if out is None else \
            F.when(F.instr(c, n) > 0, F.lit(lab)).otherwise(out)
    return out


@expr_cache
def error_dom_label(html, parsed=None) -> Column:
    """C4 DOM stage alone: ``dom_error_x`` for the first error selector present."""
    def first(n):
        label = F.lit(None).cast("string")
        for sel in reversed(L.ERROR_SELECTORS):
            name = "dom_error_" + sel.replace(".", "").replace("#", "")
            label = F.when(F.exists(n, is_a(sel)), F.lit(name)).otherwise(label)
        return label
    return let(candidates(nodes(html, parsed), L.ERROR_SELECTORS), first)


def error_page_parts(title, content, dom_label) -> Column:
    """C4 from its parts (document title, extracted content, DOM label), so
    it can run after HTML has been dropped: ``struct<is_error_page, error_type>``;
    title -> content phrases -> security phrases -> short content -> DOM,
    first match wins."""
    def of_content(raw, c):
        return F.when(raw != "", F.coalesce(
            _labelled(c, [(n, "http_error_" + n.replace(" ", "_")) for n in L.HTTP_ERRORS]),
            _labelled(c, [(n, "security_challenge_" + n.replace(" ", "_")) for n in L.SECURITY_INDICATORS]),
            F.when(F.length(strip(raw)) < L.SHORT_CONTENT_MAX, _labelled(c, [(n, f"short_error_{n}") for n in L.SHORT_CONTENT_ERRORS]))))

    etype = F.coalesce(
        let(F.lower(F.coalesce(col(title), F.lit(""))), lambda t: _labelled(t, [(n, f"error_title_{n}") for n in L.ERROR_TITLES])),
        # lower-cased once, not once for every phrase
        let(F.coalesce(col(content), F.lit("")), lambda raw: let(F.lower(raw), lambda c: of_content(raw, c))),
        col(dom_label))
    return let(etype, lambda e: F.struct(e.isNotNull().alias("is_error_page"), e.alias("error_type")))


@expr_cache
def error_page(html, content) -> Column:
    """C4: ``struct<is_error_page, error_type>`` from the page HTML and its
    extracted content."""
    return error_page_parts(page_title(nodes(html)), content, error_dom_label(html))


def spa_indicators(html) -> Column:
    """``struct<frameworks array, score, is_spa, characteristics array>``
    from substring tests on the lower-cased HTML."""
    h = F.lower(F.coalesce(col(html), F.lit("")))

    def anyc(ns):
        out = F.lit(False)
        for n in ns:
            out = out | h.contains(n)
        return out
    fw = [(name, anyc(ns)) for name, ns in L.SPA_FRAMEWORKS]
    structure, loading = anyc(L.SPA_STRUCTURE), anyc(L.SPA_LOADING)
    score = sum((F.when(c, 2).otherwise(0) for _, c in fw), F.lit(0)) \
        + F.when(structure, 1).otherwise(0) + F.when(loading, 1).otherwise(0)
    # concat_ws skips NULLs and stays in generated code (a lambda would be
    # interpreted and re-lower-case the whole page for every test).
    def listed(items):
        joined = F.concat_ws("\u0001", *items)
        return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\u0001"))
    frameworks = listed([F.when(c, F.lit(n)) for n, c in fw])
    chars = listed([F.when(c, F.lit(f"{n} framework detected")) for n, c in fw]
                   + [F.when(structure, F.lit("SPA structure indicators found")),
                      F.when(loading, F.lit("Dynamic loading indicators found"))])
    return F.struct(frameworks.alias("frameworks"), score.cast("bigint").alias("score"),
                    (score >= 2).alias("is_spa"), chars.alias("characteristics"))


def _has(n: Column, *selectors: str) -> Column:
    return F.exists(n, lambda x: any_match(x, selectors))


@expr_cache
def spa_score(html, window_react=None, window_vue=None, window_angular=None,
              window_ember=None, window_svelte=None, history_api=None, parsed=None) -> Column:
    """C6 (static DOM form): framework markers +2 each, History API +1,
    test ids / loading markers +1, app root +1; ``is_spa = score >= 2``."""
    b = lambda c, d=False: F.coalesce(c, F.lit(d)) if c is not None else F.lit(d)

    def total(n):
        parts = [(b(window_react) | _has(n, "[data-reactroot]", "#root"), 2), (b(window_vue) | _has(n, "[data-v-]"), 2),
                 (b(window_angular) | _has(n, "[ng-app]", "app-root"), 2), (b(window_ember), 2), (b(window_svelte), 2),
                 (b(history_api, True), 1), (_has(n, "[data-testid]", "[data-cy]", ".loading", ".spinner"), 1),
                 (_has(n, "#app", "#root", ".app"), 1)]
        return sum((F.when(c, w).otherwise(0) for c, w in parts), F.lit(0)).cast("bigint")

    return let(let(candidates(nodes(html, parsed), ["app-root"]), total), lambda score: F.struct(score.alias("score"), (score >= 2).alias("is_spa")))


@expr_cache
def ultra_complex_score(html, url, react_devtools=None, window_react=None, vue_router=None,
                        state_manager=None, parsed=None) -> Column:
    """Placeholder text +3, complex React +2, Vue router +2, service
    worker (secure context) +1, state manager +2, 0 < body text < 500 +2,
    complex host +1; ``is_ultra_complex = score >= 4``."""
    body = body_text(nodes(html, parsed))
    b = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    placeholder = F.lit(False)
    for p in L.PLACEHOLDER_TEXTS:
        placeholder = placeholder | body.contains(p)
    n = F.length(strip(body))
    host = hostname(url)
    domain = F.lit(False)
    for d in L.COMPLEX_DOMAINS:
        domain = domain | host.contains(d)
    react = b(window_react) & (b(react_devtools) | let(nodes(html, parsed), lambda n: _has(n, "[data-reactroot]")))
    parts = [(placeholder, 3), (react, 2), (b(vue_router), 2),
             (F.lower(col(url)).startswith("https:"), 1), (b(state_manager), 2),
             ((n > 0) & (n < 500), 2), (domain, 1)]
    score = sum((F.when(c, w).otherwise(0) for c, w in parts), F.lit(0)).cast("bigint")
    return F.struct(score.alias("score"), (score >= 4).alias("is_ultra_complex"))


@expr_cache
def educational_present(html) -> Column:
    """At least 2 of 5 keywords in the lower-cased body text, or at least 5 svg."""
    low = F.lower(body_text(nodes(html)))
    kw = sum((F.when(low.contains(k), 1).otherwise(0) for k in L.EDU_KEYWORDS), F.lit(0)).cast("bigint")
    svg = let(nodes(html), lambda n: F.size(F.filter(n, is_a("svg")))).cast("bigint")
    return F.struct(kw.alias("keyword_count"), svg.alias("svg_count"),
                    ((kw >= 2) | (svg >= 5)).alias("has_educational_content"))


def is_retryable(status, message=None) -> Column:
    """C20: status 500/502/503/504/408/429, or a transient phrase in the message."""
    out = col(status).isin(L.RETRYABLE_STATUS)
    if message is not None:
        m = F.lower(F.coalesce(col(message), F.lit("")))
        for p in L.RETRYABLE_PATTERNS:
            out = out | m.contains(p)
    return F.coalesce(out, F.lit(False))


def status_message(status, text_length) -> Column:
    """Message for an extraction by HTTP status and extracted length."""
    s, n = col(status), col(text_length).cast("string")
    return (F.when(s == 404, F.concat(F.lit("HTTP 404 detected, but "), n,
                                      F.lit(" characters successfully extracted. This may be intentional anti-crawling behavior.")))
            .when(s >= 400, F.concat(F.lit("HTTP "), s.cast("string"), F.lit(" detected, but "), n,
                                     F.lit(" characters successfully extracted. Content appears valid despite error status.")))
            .when(s == 200, F.lit("Text extracted successfully"))
            .otherwise(F.concat(F.lit("HTTP "), s.cast("string"), F.lit(" - Text extracted successfully ("), n,
                                F.lit(" characters)"))))


def provenance(reason, fallback=None) -> Column:
    """``struct<extraction_timestamp, extraction_origin>``; the
    timestamp is the query's UTC start time, ISO-8601 with microseconds."""
    fb = F.lit(False) if fallback is None else F.coalesce(col(fallback), F.lit(False))
    origin = (F.when(col(reason) == "success",
                     F.when(fb, "realtime_crawl_fallback").otherwise("realtime_crawl"))
              .otherwise("realtime_crawl_error"))
    ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.struct(ts.alias("extraction_timestamp"), origin.alias("extraction_origin"))
