"""Catalog entries for YouTube URLs and file triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import files as FI
from ..sources.seeded import seeded, with_clause
from . import duck as D
from .catalog import register

_NET = "lower(regexp_extract(lower(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_BYHOST = "(" + " OR ".join(f"{_NET} = {D.lit(d)} OR ends_with({_NET}, {D.lit('.' + d)})" for d in L.YOUTUBE_DOMAINS) + ")"
_BYPAT = "(" + " OR ".join(f"regexp_matches(coalesce(url, ''), {D.lit('(?i)' + p)})" for p in L.YOUTUBE_PATTERNS) + ")"
_VID = "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce(url, ''), {D.lit('(?i)' + p)}, 1), '')" for p in L.YOUTUBE_PATTERNS) + ")"


@register("youtube_urls", with_clause("video_urls") + f"""
SELECT page_id, url, {_BYHOST} AS by_host, {_BYPAT} AS by_pattern, {_VID} AS video_id FROM video_urls""")
def q_youtube_urls(spark, sf):
    """YouTube URL tests by host and by pattern, with video id."""
    v = seeded(spark, sf, "video_urls")
    return v.select("page_id", "url", FI.youtube_by_host("url").alias("by_host"),
                    FI.youtube_by_pattern("url").alias("by_pattern"), FI.youtube_video_id("url").alias("video_id"))


def _d_fmt_url(u: str) -> str:
    return "(CASE " + " ".join(f"WHEN contains({u}, {D.lit(e)}) THEN {D.lit(f)}" for e, f in L.URL_FORMATS) + " ELSE 'unknown' END)"


def _d_fmt_strict(path: str) -> str:
    return "(CASE " + " ".join(f"WHEN ends_with({path}, {D.lit(e)}) THEN {D.lit(f)}" for e, f in L.URL_FORMATS) + " ELSE 'unknown' END)"


_CT = "lower(trim(split(coalesce(content_type, ''), ';')[1]))"
_MIME = "(CASE " + " ".join(f"WHEN {_CT} = {D.lit(k)} THEN {D.lit(v)}" for k, v in L.MIME_FORMATS.items()) + " END)"
_OFFICE = "(" + " OR ".join(f"contains(lower(coalesce(content_type, '')), {D.lit(m)})" for m in L.OFFICE_MIME_TYPES) + ")"
_PATH = "regexp_extract(lower(coalesce(url, '')), '^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"


@register("file_format", with_clause("file_urls") + f"""
SELECT page_id, url, {_d_fmt_url("lower(coalesce(url, ''))")} AS format_by_url,
  {_d_fmt_strict(_PATH)} AS format_by_suffix, {_MIME} AS format_by_mime, {_OFFICE} AS is_office_mime
FROM file_urls""")
def q_file_format(spark, sf):
    """Format from URL substring (and strict suffix), from MIME type,
    and the office MIME test."""
    f = seeded(spark, sf, "file_urls")
    return f.select("page_id", "url", FI.format_from_url("url").alias("format_by_url"),
                    FI.format_from_url("url", strict=True).alias("format_by_suffix"),
                    FI.format_from_mime("content_type").alias("format_by_mime"),
                    FI.is_office_mime("content_type").alias("is_office_mime"))


_UPATH = "regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_NAME = f"split({_UPATH}, '/')[-1]"
_EXT = f"(CASE WHEN contains({_NAME}, '.') THEN lower(split({_NAME}, '.')[-1]) ELSE 'unknown' END)"
_CONV = f"({{}} IN {D.in_list(list(L.CONVERTIBLE_FORMATS))})"
_CONVURL = "(" + " OR ".join(f"contains(lower(coalesce(url, '')), {D.lit(s)})" for s in L.CONVERTIBLE_URL_SUFFIXES) + ")"


@register("convertible", with_clause("file_urls") + f""",
x AS (SELECT page_id, url, {_EXT} AS ext, coalesce({_MIME}, '') AS given FROM file_urls),
y AS (SELECT *, CASE WHEN given <> '' AND given <> 'unknown' THEN given ELSE lower(regexp_extract(ext, '([^./]*)$', 1)) END AS cand FROM x)
SELECT page_id, ext, {_CONV.format("regexp_replace(lower(ext), '^[.]', '')")} AS convertible_by_extension,
  {_CONVURL} AS convertible_by_url,
  CASE WHEN cand = '' OR cand = 'unknown' OR NOT {_CONV.format("cand")} THEN NULL ELSE cand END AS resolved_format,
  CASE WHEN cand = '' THEN 'Unable to determine file format for conversion'
       WHEN NOT {_CONV.format("cand")} THEN concat('Unsupported format: ', cand) END AS format_error
FROM y""")
def q_convertible(spark, sf):
    """Convertible by extension and by URL; format resolution
    (given MIME format, else file suffix) with the unsupported-format error."""
    f = seeded(spark, sf, "file_urls")
    x = f.select("page_id", "url", FI.url_extension("url").alias("ext"),
                 F.coalesce(FI.format_from_mime("content_type"), F.lit("")).alias("given"))
    r = FI.resolve_format("given", F.concat(F.lit("f."), F.col("ext")))
    return x.select("page_id", "ext", FI.convertible_by_extension("ext").alias("convertible_by_extension"),
                    FI.convertible_by_url("url").alias("convertible_by_url"),
                    r["format"].alias("resolved_format"), r["error"].alias("format_error"))


@register("size_guard", with_clause("file_urls") + """
SELECT page_id, size_bytes, round_even(size_bytes / 1048576.0, 3) AS file_size_mb, 50 AS limit_mb,
  size_bytes / 1048576.0 > 50 AS too_large FROM file_urls""")
def q_size_guard(spark, sf):
    """Size in MB (half-even, 3 places) against the clamped 50 MB limit."""
    f = seeded(spark, sf, "file_urls")
    g = FI.size_guard("size_bytes", 50)
    return f.select("page_id", "size_bytes", g["file_size_mb"].alias("file_size_mb"),
                    g["limit_mb"].alias("limit_mb"), g["too_large"].alias("too_large"))


@register("body_decode")
def q_body_decode(spark, sf):
    """Raw bodies derived from every page (UTF-8, UTF-16LE with
    NUL bytes, ISO-8859-1), the native binary test, decoding, and the
    magic-byte format guess. Python runs only in Arrow-batched UDFs."""
    from ..sources import bodies as B
    from ..sources.tables import read_table
    p = read_table(spark, sf, "pages")
    enc = (F.when(F.col("page_id") % 3 == 0, F.encode("html", "UTF-8"))
           .when(F.col("page_id") % 3 == 1, F.encode("html", "UTF-16LE"))
           .otherwise(F.encode("html", "ISO-8859-1")))
    b = p.select("page_id", enc.alias("body"))
    return b.select("page_id", B.is_binary("body").alias("is_binary"),
                    F.length(B.decode_body("body")).cast("bigint").alias("text_length"),
                    FI.guess_format("body").alias("format_guess"),
                    F.length(FI.decode_text_file("body")).cast("bigint").alias("text_file_length"))


_FORMATS_VALUES = "(VALUES " + ", ".join(f"({D.lit(k)}, {D.lit(v)})" for k, v in L.CONVERTIBLE_FORMATS.items()) + ") AS t(format, description)"


@register("format_lookup", with_clause("file_urls") + f""",
fmt AS (SELECT * FROM {_FORMATS_VALUES}),
x AS (SELECT page_id, {_EXT} AS ext FROM file_urls)
SELECT x.page_id, x.ext, fmt.description, fmt.description IS NOT NULL AS supported
FROM x LEFT JOIN fmt ON regexp_replace(lower(x.ext), '^[.]', '') = fmt.format""")
def q_format_lookup(spark, sf):
    """File extensions left-joined to the supported-format table
    (broadcast); ``supported`` false where the anti join keeps the row."""
    f = seeded(spark, sf, "file_urls").select("page_id", FI.url_extension("url").alias("ext"))
    described, _ = FI.format_lookup(f, FI.supported_formats(spark))
    return described.select("page_id", "ext", "description", F.col("description").isNotNull().alias("supported"))
