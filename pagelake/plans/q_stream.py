"""Catalog entries for the streaming jobs (S1-S3, X1, J2). Each runs the stream
over all available input with an ``availableNow`` trigger into a parquet
sink and returns the sink table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table
from ..streaming import jobs as S
from . import duck as D
from .catalog import register
from .q_html import BODY_CTE, _d_selector
from .q_links import LINKS_CTE
from .q_quality import D_CATEGORY, d_quality_cols
from .q_timeline import ADMISSION_SQL, RATE

# S1 reads the raw pages table; the shared CTEs name it seeded_pages.
_S1_SQL = f"""WITH seeded_pages AS (SELECT page_id, url, html FROM pages), {BODY_CTE}, {LINKS_CTE},
t AS (SELECT page_id, {D.hostname('url')} AS host, {_d_selector('body')} AS text FROM b),
q AS (SELECT page_id, host, {d_quality_cols('text')} FROM t),
ls AS (SELECT page_id, count(*) AS tl, count_if(is_internal) AS il FROM lk GROUP BY page_id)
SELECT q.page_id, host, n AS character_length, {D_CATEGORY} AS content_category,
  CAST(coalesce(tl, 0) AS BIGINT) AS total_links, CAST(coalesce(il, 0) AS BIGINT) AS internal_links
FROM q LEFT JOIN ls ON q.page_id = ls.page_id"""

# S3 in append mode emits a session once the final watermark (max event
# time - 1 hour) has passed its end (last mutation + 2 hours).
_S3_SQL = """WITH t AS (SELECT user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL
                      OR t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 7200000000 THEN 1 ELSE 0 END AS nw FROM t),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g),
ss AS (SELECT user_id, min(t) AS start_us, max(t) + 7200000000 AS quiet_at_us, count(*) AS mutations FROM s GROUP BY user_id, sid)
SELECT user_id, start_us, quiet_at_us, mutations FROM ss
WHERE quiet_at_us <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)"""


@register("stream_extraction", _S1_SQL)
def q_stream_extraction(spark, sf):
    """Page arrivals -> extraction rows (append mode)."""
    pages = S.stream_table(spark, sf, "pages", S.PAGES_SCHEMA)
    return S.run_once(S.extraction_rows(pages), "extraction")


@register("stream_admission", ADMISSION_SQL)
def q_stream_admission(spark, sf):
    """Per-host admission with state (10 per 2 h)."""
    ev = S.stream_table(spark, sf, "events", S.EVENTS_SCHEMA).select(*S.fetch_log_cols())
    return S.run_once(S.admission_stream(ev, [RATE]), "admission")


@register("stream_quiet_sessions", _S3_SQL)
def q_stream_quiet_sessions(spark, sf):
    """S3: quiet periods per user as 2-hour-gap sessions (watermark 1 hour)."""
    ev = S.stream_table(spark, sf, "events", S.EVENTS_SCHEMA).select("user_id", "ts")
    return S.run_once(S.quiet_sessions(ev, "user_id", "ts", "2 hours", "1 hour"), "quiet")


# All documents are within 1,000 days of arrival time of each other, so one row stays per content.
@register("stream_duplicates", f"""
SELECT DISTINCT sha256(lower(regexp_replace(coalesce(text, ''), {D.lit(r'\s+')}, ' ', 'g'))) AS content_hash FROM documents""")
def q_stream_duplicates(spark, sf):
    """Contents of a stream of documents, each once (arrival time: one second per doc_id from 2024 on)."""
    docs = S.stream_table(spark, sf, "documents", S.DOCUMENTS_SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("doc_id") + 1_704_067_200))
    return S.run_once(S.first_copies(docs, within="1000 days"), "copies").select("content_hash")


# The lexicon: the first word and the first two words of every benchmark item, in three categories.
@register("stream_keyword_hits", f"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), {D.lit(r"[\p{L}\p{N}_]+")}) AS ws FROM benchmark),
lex AS (SELECT DISTINCT concat('c', CAST(item_id % 3 AS VARCHAR)) AS category, unnest([ws[1], concat(ws[1], ' ', ws[2])]) AS keyword FROM w WHERE len(ws) > 1),
low AS (SELECT doc_id, lower({D.strip("coalesce(text, '')")}) AS t FROM documents),
tok AS (SELECT doc_id, unnest(regexp_extract_all(t, {D.lit(r"[\p{L}\p{N}_]+")})) AS keyword FROM low),
h AS (SELECT doc_id, category, count(*) AS hits FROM tok JOIN lex USING (keyword) GROUP BY doc_id, category
      UNION ALL
      SELECT doc_id, category, CAST(sum((length(t) - length(replace(t, keyword, ''))) // length(keyword)) AS BIGINT)
      FROM low JOIN lex ON contains(keyword, ' ') AND contains(t, keyword) GROUP BY doc_id, category)
SELECT doc_id AS id, category, CAST(sum(hits) AS BIGINT) AS hits, CAST(1 AS BIGINT) AS version FROM h GROUP BY doc_id, category""")
def q_stream_keyword_hits(spark, sf):
    """Arriving documents joined with the newest version of a lexicon table
    (published here: first word and first two words of every benchmark item)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexicons/{uuid.uuid4().hex[:8]}"
    ws = tokens(F.lower("text"))
    words = read_table(spark, sf, "benchmark").select(F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), ws.alias("ws")).where(F.size("ws") > 1)
    S.publish_lexicon(words.select("category", F.explode(F.array(F.col("ws")[0], F.concat_ws(" ", F.col("ws")[0], F.col("ws")[1]))).alias("keyword")), path, 1)
    docs = S.stream_table(spark, sf, "documents", S.DOCUMENTS_SCHEMA)
    return S.keyword_hits_stream(docs.select(F.col("doc_id").alias("id"), "text"), path)
