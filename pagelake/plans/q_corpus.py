"""Catalog entries for run comparison (J1, G6, G7), language (C9, C10) and
corpus statistics (X1-X4, X6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import hostname
from ..operators import compare as CP
from ..operators import corpus as X
from ..operators import html_text as H
from ..operators import lang as LG
from ..operators import links as LK
from ..sources import requests as R
from ..sources.seeded import seeded, with_clause
from ..sources.tables import read_table
from . import duck as D
from .catalog import register
from .q_classify import CASCADE_CTE
from .q_html import _d_selector
from .q_links import LINKS_CTE


def _runs(spark, sf):
    pages = seeded(spark, sf, "seeded_pages")
    simple = R.resolve_requests(seeded(spark, sf, "requests"), pages, H.selector_text("html")).select(
        "url", (F.col("reason") == "success").alias("success"), F.length("text").alias("text_length"))
    browser = pages.select("url", H.cascade_500("html")["text"].alias("t")).select(
        "url", (F.length("t") > 0).alias("success"), F.length("t").alias("text_length"))
    return simple, browser


RUNS_CTE = f"""{CASCADE_CTE},
pt AS (SELECT url AS purl, {_d_selector('body')} AS t FROM b),
sj AS (SELECT r.url, pt.purl IS NOT NULL AND coalesce(pt.t, '') <> '' AS ok, pt.t FROM requests r LEFT JOIN pt ON r.url = pt.purl),
simple AS (SELECT url, ok AS success, CASE WHEN ok THEN length(t) ELSE 0 END AS text_length FROM sj),
browser AS (SELECT url, length(content) > 0 AS success, length(content) AS text_length FROM cas),
par AS (SELECT coalesce(s.url, b2.url) AS url, coalesce(s.success, false) AS so, coalesce(s.text_length, 0) AS sl,
               coalesce(b2.success, false) AS bo, coalesce(b2.text_length, 0) AS bl
        FROM simple s FULL OUTER JOIN browser b2 ON s.url = b2.url),
parity AS (SELECT url, so AS simple_success, CAST(sl AS BIGINT) AS simple_length, bo AS browser_success, CAST(bl AS BIGINT) AS browser_length,
  CASE WHEN so AND bo THEN bl >= sl * CAST(0.8 AS DOUBLE) WHEN so THEN false ELSE true END AS parity_achieved,
  CASE WHEN so AND bo THEN concat('Both modes successful|', CASE WHEN bl >= sl * CAST(0.8 AS DOUBLE) THEN 'Content parity good: ' ELSE 'Content parity concern: ' END,
                                  'Browser ', CAST(bl AS VARCHAR), ' vs Simple ', CAST(sl AS VARCHAR))
       WHEN so THEN 'Browser mode failed while simple mode succeeded - PARITY ISSUE'
       WHEN bo THEN 'Browser mode succeeded while simple mode failed - Browser advantage'
       ELSE 'Both modes failed' END AS notes FROM par)"""
RUNS_WITH = with_clause("seeded_pages", "requests")


@register("mode_parity", RUNS_WITH + f", {RUNS_CTE}\nSELECT * FROM parity")
def q_mode_parity(spark, sf):
    """Simple run (requests joined to pages) vs browser run (cascade) per URL."""
    return CP.mode_parity(*_runs(spark, sf))


@register("parity_summary", RUNS_WITH + f""", {RUNS_CTE}
SELECT count(*) AS total, CAST(count_if(parity_achieved) AS BIGINT) AS parity,
  round_even(count_if(parity_achieved) * 100.0 / count(*), 1) AS parity_pct FROM parity""")
def q_parity_summary(spark, sf):
    """Total URLs, parity count and percentage."""
    return CP.run_summary(CP.mode_parity(*_runs(spark, sf)))


@register("success_rate", RUNS_WITH + f""", {RUNS_CTE},
u AS (SELECT 'simple' AS mode, success FROM simple UNION ALL SELECT 'browser' AS mode, success FROM browser)
SELECT mode, count(*) AS runs, CAST(count_if(success) AS BIGINT) AS successes, round_even(count_if(success) / count(*), 4) AS success_rate
FROM u GROUP BY mode""")
def q_success_rate(spark, sf):
    """Success rate per mode."""
    s, b = _runs(spark, sf)
    u = s.select(F.lit("simple").alias("mode"), "success").unionByName(b.select(F.lit("browser").alias("mode"), "success"))
    return CP.success_rate(u)


_LANG_SQL = f"""WITH d AS (SELECT doc_id, lang, lower({D.strip("coalesce(text, '')")}) AS t FROM documents),
tok AS (SELECT doc_id, lang, unnest({D.tokens('t')}) AS word FROM d),
counts AS (SELECT lang, word, count(*) AS c FROM tok WHERE lang IS NOT NULL GROUP BY lang, word),
vv AS (SELECT count(DISTINCT word) AS v FROM counts),
nd AS (SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL),
pri AS (SELECT lang, CAST(round(ln(count(*) / (SELECT n FROM nd)) * 1000) AS BIGINT) AS prior FROM documents WHERE lang IS NOT NULL GROUP BY lang),
tot AS (SELECT lang, sum(c) AS nn FROM counts GROUP BY lang),
model AS (SELECT c.lang, c.word, CAST(round(ln((c.c + 1) / (tot.nn + (SELECT v FROM vv))) * 1000) AS BIGINT) AS logp,
                 CAST(round(ln(1.0 / (tot.nn + (SELECT v FROM vv))) * 1000) AS BIGINT) AS unseen, pri.prior
          FROM counts c JOIN tot ON c.lang = tot.lang JOIN pri ON c.lang = pri.lang),
w AS (SELECT doc_id, word, count(*) AS n FROM tok GROUP BY doc_id, word),
nt AS (SELECT doc_id, sum(n) AS ntok FROM w GROUP BY doc_id),
s AS (SELECT w.doc_id, m.lang, sum(w.n * (m.logp - m.unseen)) AS delta FROM w JOIN model m ON w.word = m.word GROUP BY w.doc_id, m.lang),
ls AS (SELECT DISTINCT lang, unseen, prior FROM model),
sc AS (SELECT s.doc_id, s.lang, s.delta + nt.ntok * ls.unseen + ls.prior AS score FROM s JOIN ls ON s.lang = ls.lang JOIN nt ON s.doc_id = nt.doc_id),
z AS (SELECT doc_id, lang, score, max(score) OVER (PARTITION BY doc_id) AS best FROM sc),
z2 AS (SELECT doc_id, sum(exp((score - best) / 1000.0)) AS zz, max(score) AS score, arg_min(lang, (-score, lang)) AS lang FROM z GROUP BY doc_id),
pred AS (SELECT doc_id, lang, round_even(1.0 / zz, 4) AS confidence, CAST(score AS BIGINT) AS score FROM z2)"""


def _language(spark, sf):
    docs = read_table(spark, sf, "documents")
    model = LG.train(docs.select("text", "lang"))
    return LG.detect(docs.select("doc_id", "text"), model, "doc_id", "text")


@register("language", _LANG_SQL + "\nSELECT d.doc_id, coalesce(pred.lang, 'unknown') AS lang, coalesce(confidence, 0.0) AS confidence, score FROM d LEFT JOIN pred ON d.doc_id = pred.doc_id")
def q_language(spark, sf):
    """Naive-Bayes language per document, trained on the labelled documents."""
    return _language(spark, sf)


@register("language_filter", _LANG_SQL + "\nSELECT doc_id, CASE WHEN confidence > 0.5 THEN lang ELSE 'unknown' END AS lang FROM pred WHERE lang = 'de'")
def q_language_filter(spark, sf):
    """C9 threshold rule and C10 target-language filter (target 'de')."""
    p = _language(spark, sf)
    p = LG.target_filter(p, "lang", "de")
    return p.select("doc_id", LG.label_with_threshold(F.col("lang"), F.col("confidence")).alias("lang"))


@register("duplicates", f"""
WITH h AS (SELECT doc_id, sha256(lower(regexp_replace(coalesce(text, ''), {D.lit(r'\s+')}, ' ', 'g'))) AS content_hash FROM documents)
SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS dup_of,
  count(*) OVER (PARTITION BY content_hash) AS n_copies FROM h""")
def q_duplicates(spark, sf):
    """Normalised SHA-256 duplicate groups over all documents."""
    return X.duplicates(read_table(spark, sf, "documents"))


_TOK = D.tokens("coalesce(text, '')")
_SYL = f"list_transform({_TOK}, lambda w: greatest(len(regexp_extract_all(lower(w), {D.lit(X.VOWELS)}, 0)), 1))"


@register("readability", f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, {_TOK} AS ws, {_SYL} AS syl FROM documents),
b AS (SELECT doc_id, len(ws) AS n, greatest(len(regexp_extract_all(t, '[.!?]+', 0)), 1) AS se,
             len(list_filter(string_split_regex(t, {D.lit(r'\n\s*\n')}), lambda x: {D.strip('x')} <> '')) AS pa,
             coalesce(list_sum(syl), 0) AS ns, len(list_filter(syl, lambda x: x >= 3)) AS poly,
             len(list_filter(syl, lambda x: x = 1)) AS mono, len(list_filter(ws, lambda w: length(w) > 6)) AS lw FROM a)
SELECT doc_id, CAST(n AS BIGINT) AS words, CAST(CASE WHEN n > 0 THEN se ELSE 0 END AS BIGINT) AS sentences, CAST(pa AS BIGINT) AS paragraphs,
  CASE WHEN n > 0 THEN floor(CAST(n AS DOUBLE) / se * 10000.0 + 0.5) / 10000.0 END AS avg_sentence_len,
  CASE WHEN n > 0 THEN floor((CAST(180.0 AS DOUBLE) - CAST(n AS DOUBLE) / se - CAST(58.5 AS DOUBLE) * (CAST(ns AS DOUBLE) / n)) * 10000.0 + 0.5) / 10000.0 END AS flesch_de,
  CASE WHEN n > 0 THEN floor((CAST(0.1935 AS DOUBLE) * (poly * CAST(100.0 AS DOUBLE) / n) + CAST(0.1672 AS DOUBLE) * (CAST(n AS DOUBLE) / se)
    + CAST(0.1297 AS DOUBLE) * (lw * CAST(100.0 AS DOUBLE) / n) - CAST(0.0327 AS DOUBLE) * (mono * CAST(100.0 AS DOUBLE) / n) - CAST(0.875 AS DOUBLE)) * 10000.0 + 0.5) / 10000.0 END AS wiener_sachtext
FROM b""")
def q_readability(spark, sf):
    """Counts and readability formulas per document."""
    d = X.with_readability(read_table(spark, sf, "documents").select("doc_id", "text"), "text", "r")
    return d.select("doc_id", "r.*")


@register("lexical_stats", f"""
WITH t AS (SELECT doc_id, unnest({D.tokens("lower(coalesce(text, ''))")}) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY doc_id, w),
g AS (SELECT doc_id, count(*) AS types, sum(c) AS tokens, sum(c * log2(c)) AS cl FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(types, 0) AS types, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round_even(types / tokens, 6) AS ttr,
  round_even(types / sqrt(tokens), 6) AS guiraud_r, round_even(log2(tokens) - cl / tokens, 6) AS entropy_bits
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""")
def q_lexical_stats(spark, sf):
    """Type-token ratio, Guiraud's R and token entropy per document."""
    return X.lexical_stats(read_table(spark, sf, "documents"))


_LINES = f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {D.strip('x')} <> '')"


@register("text_structure", with_clause("seeded_documents") + f""",
a AS (SELECT doc_id, coalesce(text, '') AS t, {_LINES} AS ls FROM seeded_documents)
SELECT doc_id, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^#{{1,6}}\\s'))) AS BIGINT) AS headings,
  CAST(len(list_filter(string_split_regex(t, {D.lit(r'\n\s*\n')}), lambda x: {D.strip('x')} <> '')) AS BIGINT) AS paragraphs,
  CASE WHEN length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) > 0 THEN round_even(length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')), 6) ELSE 0.0 END AS caps_ratio,
  CASE WHEN length(t) > 0 THEN round_even(length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(t), 6) ELSE 0.0 END AS special_ratio,
  CASE WHEN len(ls) > 0 THEN round_even(1 - len(list_distinct(list_transform(ls, lambda x: {D.strip('x')}))) / len(ls), 6) ELSE 0.0 END AS repetition_ratio
FROM a""")
def q_text_structure(spark, sf):
    """Headings, paragraphs, caps, special-character and repetition ratios."""
    d = seeded(spark, sf, "seeded_documents").select("doc_id", X.structure("text").alias("s"))
    return d.select("doc_id", "s.*")


@register("link_graph", with_clause("seeded_pages") + f""", {LINKS_CTE},
e0 AS (SELECT {D.hostname('p.url')} AS src_host, {D.hostname('lk.url')} AS dst_host FROM lk JOIN seeded_pages p ON lk.page_id = p.page_id),
e AS (SELECT src_host, dst_host, count(*) AS n FROM e0 WHERE dst_host <> '' AND dst_host <> src_host GROUP BY src_host, dst_host),
o AS (SELECT src_host AS host, sum(n) AS out_links, count(*) AS out_hosts FROM e GROUP BY src_host),
i AS (SELECT dst_host AS host, sum(n) AS in_links, count(*) AS in_hosts FROM e GROUP BY dst_host)
SELECT coalesce(o.host, i.host) AS host, CAST(coalesce(out_links, 0) AS BIGINT) AS out_links, CAST(coalesce(out_hosts, 0) AS BIGINT) AS out_hosts,
  CAST(coalesce(in_links, 0) AS BIGINT) AS in_links, CAST(coalesce(in_hosts, 0) AS BIGINT) AS in_hosts
FROM o FULL OUTER JOIN i ON o.host = i.host""")
def q_link_graph(spark, sf):
    """Host link graph over all pages, in/out degree per host."""
    p = LK.with_links(seeded(spark, sf, "seeded_pages").select("page_id", "url", "html"))
    long = LK.explode_links(p.select("page_id", hostname("url").alias("src_host"), "links"), keep=("page_id", "src_host"))
    return X.link_graph(long.select("src_host", hostname("url").alias("dst_host")))


_SETS = f"list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), {D.lit(X.SENTENCE_SPLIT)}), lambda x: {D.strip('x')} <> ''), lambda x: list_distinct({D.tokens('lower(x)')}))"


@register("coherence", f"""
WITH a AS (SELECT doc_id, {_SETS} AS sets FROM documents),
p AS (SELECT doc_id, len(sets) AS n,
             list_transform(range(1, len(sets)), lambda i: CASE WHEN len(list_distinct(list_concat(sets[i], sets[i + 1]))) > 0
                 THEN len(list_intersect(sets[i], sets[i + 1])) / len(list_distinct(list_concat(sets[i], sets[i + 1]))) ELSE 0.0 END) AS js
      FROM a),
c AS (SELECT doc_id, n, CASE WHEN n >= 2 THEN floor(list_reduce(list_prepend(0.0, js), lambda acc, x: acc + x) / (n - 1) * 10000.0 + 0.5) / 10000.0 END AS score FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS sentences, score, CAST(CASE WHEN score IS NOT NULL THEN least(5, 1 + floor(score * 5)) END AS BIGINT) AS likert FROM c""")
def q_coherence(spark, sf):
    """Adjacent-sentence overlap coherence and a 1-5 scale per document."""
    d = X.with_coherence(read_table(spark, sf, "documents").select("doc_id", "text"), "text", "c")
    return d.select("doc_id", "c.*")
