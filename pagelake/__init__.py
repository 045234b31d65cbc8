"""pagelake: turn tables of fetched web pages, documents and request logs
into clean, labelled text with Spark DataFrames.

Every public operator takes DataFrames and returns DataFrames. Relational
work is expressed with native Spark columns, joins and windows so Catalyst
can prune, push down and code-generate it; only DOM walking, byte decoding
and keyed sequential decisions run Python, inside Arrow-batched tasks.

The names below are loaded lazily (``from pagelake import simple_mode``).
"""

__version__ = "0.1.0"

_API = {
    # end-to-end plans
    "simple_mode": "pagelake.plans.extraction", "browser_mode": "pagelake.plans.extraction",
    # sources
    "read_table": "pagelake.sources.tables", "page_stream": "pagelake.sources.tables",
    "normalise_requests": "pagelake.sources.requests", "resolve_requests": "pagelake.sources.requests",
    "decode_body": "pagelake.sources.bodies", "is_binary": "pagelake.sources.bodies",
    "write_results": "pagelake.sources.bodies", "read_files": "pagelake.operators.files",
    # text
    "body_text": "pagelake.operators.html_text", "visible_text": "pagelake.operators.html_text",
    "selector_text": "pagelake.operators.html_text", "readable_text": "pagelake.operators.html_text",
    "cascade_500": "pagelake.operators.html_text", "markdown_to_text": "pagelake.operators.html_text",
    "embedded_json_text": "pagelake.operators.html_text", "iframe_text": "pagelake.operators.html_text",
    "dom_pass": "pagelake.operators.dom", "main_text_dedup": "pagelake.operators.dom",
    "cascade": "pagelake.functions.cascade", "cascade_or_longest": "pagelake.functions.cascade",
    # links, quality, classification, language
    "with_links": "pagelake.operators.links", "rank_links": "pagelake.operators.links",
    "link_stats": "pagelake.operators.links", "explode_links": "pagelake.operators.links",
    "with_quality": "pagelake.operators.quality", "error_page": "pagelake.operators.classify",
    "spa_indicators": "pagelake.operators.classify", "spa_score": "pagelake.operators.classify",
    "train_language_model": ("pagelake.operators.lang", "train"), "detect_language": ("pagelake.operators.lang", "detect"),
    # time-ordered
    "window_weight": "pagelake.operators.timeline", "violations": "pagelake.operators.timeline",
    "admission": "pagelake.operators.timeline", "hash_stability": "pagelake.operators.timeline",
    "quiet_period": "pagelake.operators.timeline", "backoff_outcome": "pagelake.operators.timeline",
    "mode_parity": "pagelake.operators.compare",
}


def __getattr__(name):
    target = _API.get(name)
    if target is None:
        raise AttributeError(name)
    import importlib
    module, attr = target if isinstance(target, tuple) else (target, name)
    return getattr(importlib.import_module(module), attr)


__all__ = sorted(_API)
