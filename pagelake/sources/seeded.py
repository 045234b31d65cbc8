"""Seeded views over the driver tables.

The raw tables hold none of the patterns the classifiers look for (no
lexicon keyword, error phrase, SPA marker, iframe, svg or embedded JSON), so
these deterministic views add them. Each statement runs unchanged in Spark
and in DuckDB, which lets the same view feed a Spark query and its SQL
oracle. They derive from the given tables, so their size grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

# Fixed fixture definitions (shared with the SQL oracles).
SEEDED_SQL = {
    "seeded_pages": """
SELECT p.page_id, p.url,
  replace(CASE WHEN p.page_id % 10 = 2 THEN replace(p.html, '<title>', '<title>404 Not Found ') ELSE p.html END,
    '<body>', concat('<body>', CASE p.page_id % 10
    WHEN 1 THEN '<div id="root" data-reactroot="">JavaScript wird benötigt! Loading...</div>'
    WHEN 3 THEN concat('<a href="mailto:a@example.org">Mail</a><a href="tel:+491">Tel</a><a href="/f/report.pdf">Report</a><a href="/i/x.png">Pic</a><a href="https://github.com/x">Code</a><a href="#top">Top</a><a href="javascript:void(0)">JS</a><a href="/contact">Contact us</a><a href="/contact">Contact again</a><a href="/x1" class="btn">Go</a><a href="/x2" title="Titled"></a><a href="https://sub.', regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1), '/s">Sub</a>')
    WHEN 4 THEN '<svg><title>Raum</title><text>Koordinaten Achse</text></svg>'
    WHEN 5 THEN '<script id="embedded-topic" type="json">{"description":"<p>Eine Lektion</p>","summary":"Kurz","keywords":"a, b","subject":"Mathe","topic":"Achse","attachments":[{"name":"Blatt","tag":"pdf"},{"name":"Heft"}]}</script>'
    WHEN 6 THEN concat('<iframe src="', p.url, '/frame/', CAST(p.page_id AS STRING), '"></iframe>')
    WHEN 7 THEN '<article>Lernen und Übungen in der Vorlesung. 5 ECTS pro Semester. Learning outcome.</article>'
    WHEN 8 THEN '<div data-content="hidden learning material"></div><!-- cached description of this lesson -->'
    WHEN 9 THEN '<p>Checking your browser. Ray ID 42.</p>'
    ELSE '' END)) AS html
FROM pages p
UNION ALL
SELECT -1 - page_id, concat(url, '/frame/', CAST(page_id AS STRING)),
  concat('<html><body><p>A framed page with a lesson of its own, number ', CAST(page_id AS STRING), '.</p><p>', CASE WHEN page_id % 20 = 6 THEN '' ELSE url END, '</p></body></html>')
FROM pages WHERE page_id % 10 = 6""",
    "seeded_documents": """
SELECT doc_id, lang, CASE doc_id % 8
  WHEN 1 THEN concat(text, ' Lernen, Übungen und Kompetenzziele: 5 ECTS, Semester.')
  WHEN 2 THEN concat(text, ' Contact, duration, fee and schedule. Lecture.')
  WHEN 3 THEN concat(text, ' error error temporarily unavailable')
  WHEN 5 THEN concat(text, chr(10), '# Head', chr(10), '**bold** and _it_ [link](http://x.org) `code`', chr(10), '- item', chr(10), '1. one')
  ELSE text END AS text
FROM documents
UNION ALL
SELECT -1 - doc_id, lang, CASE doc_id % 8
  WHEN 0 THEN 'Fehler 404: Seite nicht gefunden. Try again.'
  WHEN 4 THEN '   '
  ELSE concat('# Head', chr(10), '**bold** and _it_ [link](http://x.org) `code`', chr(10), '- item', chr(10), '1. one') END
FROM documents WHERE doc_id % 8 IN (0, 4, 5)""",
    "fetch_log": """
SELECT event_id, ts, concat('h', CAST(user_id % 20 AS STRING), '.example.org') AS host, 1 + event_id % 3 AS weight,
  concat('https://h', CAST(user_id % 20 AS STRING), '.example.org/p/', CAST(user_id AS STRING)) AS url,
  CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'click' THEN 429 ELSE 200 END AS status
FROM events""",
    "snapshots": """
SELECT user_id AS url_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS poll,
  CASE WHEN event_type IN ('view','click','signup') THEN 'A' ELSE 'B' END AS content
FROM events""",
    "file_urls": """
SELECT page_id, concat(url, CASE page_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.csv' WHEN 4 THEN '.htm' WHEN 5 THEN '' WHEN 6 THEN '.zip' WHEN 7 THEN '.PPTX' ELSE '.txt' END) AS url,
  CASE page_id % 5 WHEN 0 THEN 'application/pdf; charset=binary' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'text/html; charset=utf-8' WHEN 3 THEN 'application/octet-stream' ELSE '' END AS content_type,
  (page_id * 1048583) % 120000000 AS size_bytes
FROM pages""",
}

# Our own derived views (same rule: deterministic, from the driver tables,
# valid in Spark and DuckDB).
SEEDED_SQL.update({
    "video_urls": """
SELECT page_id, url FROM pages
UNION ALL
SELECT -1 - page_id, CASE page_id % 6
  WHEN 0 THEN concat('https://www.youtube.com/watch?v=', CAST(page_id AS STRING))
  WHEN 1 THEN concat('https://youtu.be/v', CAST(page_id AS STRING))
  WHEN 2 THEN concat('HTTPS://M.YOUTUBE.COM/watch?v=', CAST(page_id AS STRING), '&t=1')
  WHEN 3 THEN concat('https://music.youtube.de/embed/', CAST(page_id AS STRING))
  ELSE concat('https://notyoutube.com/watch?v=', CAST(page_id AS STRING)) END
FROM pages""",
    "requests": """
SELECT page_id AS request_id,
  CASE WHEN page_id % 11 = 0 THEN concat(url, '/missing') ELSE url END AS url,
  CASE WHEN page_id % 2 = 0 THEN 'simple' ELSE 'browser' END AS method,
  CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 302 ELSE 200 END AS status,
  CAST(page_id % 130 AS INT) AS max_file_size_mb,
  CAST(5 + page_id % 400 AS INT) AS conversion_timeout,
  CAST(page_id % 150 AS INT) AS timeout,
  CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN split('none, ', ',') WHEN 2 THEN split(' 10.0.0.1:8080 ,NULL', ',')
    WHEN 3 THEN split('proxy.example.org:3128,false,h2:81', ',') WHEN 4 THEN split('bad-proxy', ',')
    WHEN 5 THEN split('h:port', ',') WHEN 6 THEN split(':80', ',') ELSE split('string,0', ',') END AS proxies
FROM pages""",
})

_BASE = {"video_urls": ("pages",), "requests": ("pages",), "seeded_pages": ("pages",), "seeded_documents": ("documents",),
         "fetch_log": ("events",), "snapshots": ("events",), "file_urls": ("pages",)}


def seeded(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A seeded view as a DataFrame, derived from the driver tables in ``sf_dir``.

    The tables are passed to ``spark.sql`` as DataFrame parameters, so no
    session-wide temp view named ``pages``/``events``/``documents`` is
    created or replaced.
    """
    sql = SEEDED_SQL[name].replace("{", "{{").replace("}", "}}")
    sql = re.sub(r"\b(FROM|JOIN)\s+(pages|events|documents)\b", lambda m: f"{m.group(1)} {{{m.group(2)}}}", sql)
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in _BASE[name]})


def seeded_with(spark: SparkSession, sf_dir: str, *names: str) -> dict:
    """Several seeded views, also registered as temp views by name."""
    out = {}
    for n in names:
        out[n] = seeded(spark, sf_dir, n)
        out[n].createOrReplaceTempView(n)
    return out


def with_clause(*names: str) -> str:
    """``WITH`` prefix that defines the named seeded views for a SQL oracle."""
    parts = [f"{n} AS ({SEEDED_SQL[n].strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
