"""Catalog entries for the remaining native HTML extractors."""

from __future__ import annotations

from ..functions import lexicons as L
from ..operators import html_text as H
from ..sources.seeded import seeded, with_clause
from ..sources.tables import read_table
from . import duck as D
from .catalog import register
from .q_html import BODY_CTE

SP = with_clause("seeded_pages")

_SVG_PART = r"(?is)<(?:text|tspan|title|desc)\b[^>]*>(.*?)</(?:text|tspan|title|desc)\s*>"
_SVGT = (f"list_transform(flatten(list_transform(regexp_extract_all(body, {D.lit(r'(?is)<svg\b.*?</svg\s*>')}, 0), "
         f"lambda s: regexp_extract_all(s, {D.lit(_SVG_PART)}, 1))), lambda p: {D.strip(D.text_content('p'))})")


@register("svg_text", SP + f""", {BODY_CTE}
SELECT page_id, {D.strip(f"array_to_string(list_filter({_SVGT}, lambda t: length(t) > 2), ' ')")} AS svg_text FROM b""")
def q_svg_text(spark, sf):
    """B12 (SVG part): text of svg text/tspan/title/desc elements."""
    return seeded(spark, sf, "seeded_pages").select("page_id", H.svg_text("html").alias("svg_text"))


def _d_clean(s: str) -> str:
    for p in (r"<!--//--><!\[CDATA\[//>", r"//--><!\]\]>", r"<!--", r"-->"):
        s = f"regexp_replace({s}, {D.lit(p)}, '', 'g')"
    return D.strip(f"regexp_extract({s}, {D.lit(r'(?s)(\{.*\})')}, 1)")


def _d_line(label: str, v: str) -> str:
    return f"CASE WHEN coalesce({v}, '') <> '' THEN concat({D.lit(label)}, {v}, chr(10), chr(10)) END"


_J = "j"
_DESC = D.collapse_ws(f"regexp_replace(json_extract_string({_J}, '$.description'), '<[^>]*>', ' ', 'g')")
_ATT = f"from_json(json_extract({_J}, '$.attachments'), '[{{\"name\":\"VARCHAR\",\"tag\":\"VARCHAR\"}}]')"
_ATTL = (f"array_to_string(list_transform(list_filter({_ATT}, lambda a: coalesce(a.name, '') <> ''), "
         f"lambda a: concat('- ', a.name, CASE WHEN coalesce(a.tag, '') <> '' THEN concat(' (', a.tag, ')') ELSE '' END, chr(10))), '')")


def _js(k):
    return f"json_extract_string({_J}, '$.{k}')"


_TOPIC = D.strip("concat_ws('', " + ", ".join([
    f"CASE WHEN coalesce({_js('description')}, '') <> '' THEN concat('Beschreibung:', chr(10), {_DESC}, chr(10), chr(10)) END",
    _d_line("Zusammenfassung: ", _js("summary")),
    _d_line("Schlüsselwörter: ", _js("keywords")),
    f"CASE WHEN coalesce({_js('subject')}, '') <> '' AND coalesce({_js('topic')}, '') <> '' THEN concat('Fach: ', {_js('subject')}, ' - Thema: ', {_js('topic')}, chr(10), chr(10)) END",
    _d_line("Bildungsstufe: ", _js("educationalLevel")),
    _d_line("Altersbereich: ", _js("typicalAgeRange")),
    f"CASE WHEN json_extract({_J}, '$.attachments') IS NOT NULL AND json_type(json_extract({_J}, '$.attachments')) = 'ARRAY' AND json_array_length(json_extract({_J}, '$.attachments')) > 0 THEN concat('Anhänge und Ressourcen:', chr(10), {_ATTL}, chr(10)) END",
]) + ")")
_SCRIPTS = "flatten([" + ", ".join(f"regexp_extract_all(html, {D.lit(p)}, 1)" for p in H.EMBEDDED_PATTERNS) + "])"


@register("embedded_json_text", SP + f""",
s AS (SELECT page_id, list_filter(list_transform({_SCRIPTS}, lambda x: {_d_clean('x')}), lambda j: j <> '' AND json_valid(j)) AS js FROM seeded_pages),
t AS (SELECT page_id, list_filter(list_transform(js, lambda {_J}: {_TOPIC}), lambda x: x <> '') AS ts FROM s)
SELECT page_id, coalesce(ts[1], '') AS embedded_text FROM t""")
def q_embedded_json_text(spark, sf):
    """Labelled lesson text from embedded topic JSON scripts."""
    return seeded(spark, sf, "seeded_pages").select("page_id", H.embedded_json_text("html").alias("embedded_text"))


_QS = "array_to_string(regexp_extract_all(o, '\"([^\"]*)\"', 1), ' ')"
_MINED = f"""array_to_string(list_transform(flatten([
    list_transform(list_filter(flatten(list_transform(regexp_extract_all(html, {D.lit(r'(?is)<script\b[^>]*>(.*?)</script\s*>')}, 1),
        lambda s: regexp_extract_all(s, {D.lit(H._SMALL_JSON)}, 0))), lambda o: json_valid(o)), lambda o: {_QS}),
    list_filter(list_transform(regexp_extract_all(html, {D.lit(r'(?is)<[a-z][^>]*?\sdata-[a-z0-9_.:-]+\s*=\s*"([^"]*)"')}, 1),
        lambda v: {D.decode('v')}), lambda v: length(v) > 10),
    list_filter(regexp_extract_all(body, {D.lit(r'(?s)<!--(.*?)-->')}, 1), lambda c: length(c) > 20 AND NOT contains(c, '<!--'))
  ]), lambda p: concat(p, ' ')), '')"""


@register("mined_text", SP + f""", {BODY_CTE}
SELECT page_id, {_MINED} AS mined_text FROM b""")
def q_mined_text(spark, sf):
    """Strings from small JSON objects in scripts, data attributes and comments."""
    return seeded(spark, sf, "seeded_pages").select("page_id", H.mined_text("html").alias("mined_text"))


@register("state_text", SP + f"""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, {D.lit(H._STATE)}, 1),
  lambda o: concat({_QS}, ' ')), '') AS state_text FROM seeded_pages""")
def q_state_text(spark, sf):
    """B15 (static form): strings of window state objects in scripts."""
    return seeded(spark, sf, "seeded_pages").select("page_id", H.state_text("html").alias("state_text"))


@register("iframe_text", SP + f""", {BODY_CTE},
fr AS (SELECT page_id, url, unnest(regexp_extract_all(html, {D.lit(r'(?is)<iframe\b[^>]*?\ssrc\s*=\s*"([^"]*)"')}, 1)) AS src,
              generate_subscripts(regexp_extract_all(html, {D.lit(r'(?is)<iframe\b[^>]*?\ssrc\s*=\s*"([^"]*)"')}, 1), 1) AS ipos
       FROM seeded_pages),
tg AS (SELECT page_id, ipos, {D.resolve('url', D.strip(D.decode('src')))} AS target FROM fr),
tx AS (SELECT url AS target, {D.text_content('body')} AS ttext FROM b),
j AS (SELECT tg.page_id, tg.ipos, tx.ttext FROM tg LEFT JOIN tx ON tg.target = tx.target AND length(tx.ttext) > 50),
a AS (SELECT page_id, string_agg(concat(ttext, ' '), '' ORDER BY ipos) FILTER (ttext IS NOT NULL) AS iframe_text FROM j GROUP BY page_id)
SELECT p.page_id, coalesce(a.iframe_text, '') AS iframe_text FROM seeded_pages p LEFT JOIN a ON p.page_id = a.page_id""")
def q_iframe_text(spark, sf):
    """Body text of framed pages appended per page (left join on URL)."""
    return H.iframe_text(seeded(spark, sf, "seeded_pages"))


_PHOK = " AND ".join(f"NOT contains(t, {D.lit(p)})" for p in L.SNAPSHOT_PLACEHOLDERS)


@register("best_snapshot", f"""
WITH p0 AS (SELECT conv_id, turn, coalesce(text, '') AS t,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations),
p AS (SELECT *, CASE WHEN {_PHOK} THEN length(t) ELSE -1 END AS cand FROM p0 WHERE rank <= 20),
p2 AS (SELECT *, max(cand) OVER (PARTITION BY conv_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_len FROM p),
st AS (SELECT conv_id, min(rank) AS stop_rank FROM p2 WHERE best_len > 1000 GROUP BY conv_id),
q AS (SELECT p2.* FROM p2 LEFT JOIN st ON p2.conv_id = st.conv_id WHERE st.stop_rank IS NULL OR p2.rank <= st.stop_rank),
r AS (SELECT conv_id, arg_max(t, (cand, -rank)) AS bt, max(cand) AS bl, arg_max(rank, (cand, -rank)) AS bp, max(rank) AS polls_used FROM q GROUP BY conv_id)
SELECT conv_id, CASE WHEN bl >= 0 THEN bt ELSE '' END AS best_text, CASE WHEN bl >= 0 THEN bp END AS best_poll, polls_used FROM r""")
def q_best_snapshot(spark, sf):
    """Best placeholder-free snapshot per conversation, turns as polls
    (stop after the first poll whose best exceeds 1000 chars, at most 20)."""
    conv = read_table(spark, sf, "conversations")
    return H.best_snapshot(conv, "conv_id", "turn", "text")


_MD_STEPS = [(r"(?m)^#+\s*", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"),
             (r"_([^_]+)_", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?s)```[^`]*```", ""), (r"`([^`]+)`", r"\1"),
             (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\n\s*\n", "\n\n")]


def _d_md(x: str) -> str:
    for p, r in _MD_STEPS:
        x = f"regexp_replace({x}, {D.lit(p)}, {D.lit(r)}, 'g')"
    return D.strip(x)


@register("markdown_text", with_clause("seeded_documents") + f"""
SELECT doc_id, {_d_md('text')} AS plain_text FROM seeded_documents""")
def q_markdown_text(spark, sf):
    """Markdown to plain text over all documents."""
    d = seeded(spark, sf, "seeded_documents")
    return d.select("doc_id", H.markdown_to_text("text").alias("plain_text"))
