"""File triage: formats from URL, MIME and magic bytes, convertibility,
size guard, YouTube URL tests (C11-C19, A2, A6).

Decoding PDFs or Office files is not built (per-row codecs); everything
around it is native columns, plus one small Arrow UDF for zip member
listing and text decoding.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions.text import col


def youtube_by_host(url) -> Column:
    """C11: lower-cased netloc equals or is a subdomain of a YouTube domain."""
    n = F.lower(F.regexp_extract(F.lower(col(url)), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    out = F.lit(False)
    for d in L.YOUTUBE_DOMAINS:
        out = out | (n == d) | n.endswith("." + d)
    return out


def youtube_by_pattern(url) -> Column:
    """Any of the watch/short/embed patterns, case-insensitive."""
    u = F.coalesce(col(url), F.lit(""))
    out = F.lit(False)
    for p in L.YOUTUBE_PATTERNS:
        out = out | u.rlike("(?i)" + p)
    return out


def youtube_video_id(url) -> Column:
    u = F.coalesce(col(url), F.lit(""))
    ids = [F.nullif(F.regexp_extract(u, "(?i)" + p, 1), F.lit("")) for p in L.YOUTUBE_PATTERNS]
    return F.coalesce(*ids)


def format_from_url(url, strict: bool = False) -> Column:
    """First extension (in table order) found anywhere in the lower-cased
    URL, so '.docx' gives 'doc'; ``strict`` tests the path suffix instead."""
    u = F.lower(F.coalesce(col(url), F.lit("")))
    if strict:
        path = F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
        out = F.lit("unknown")
        for ext, fmt in reversed(L.URL_FORMATS):
            out = F.when(path.endswith(ext), F.lit(fmt)).otherwise(out)
        return out
    out = F.lit("unknown")
    for ext, fmt in reversed(L.URL_FORMATS):
        out = F.when(u.contains(ext), F.lit(fmt)).otherwise(out)
    return out


def format_from_mime(content_type) -> Column:
    """C14: MIME type without parameters, looked up in the 12-entry map."""
    ct = F.lower(F.trim(F.split(F.coalesce(col(content_type), F.lit("")), ";")[0]))
    m = F.create_map(*[F.lit(x) for kv in L.MIME_FORMATS.items() for x in kv])
    return F.try_element_at(m, ct)


def is_office_mime(content_type) -> Column:
    """Any of 19 substrings in the lower-cased content type."""
    ct = F.lower(F.coalesce(col(content_type), F.lit("")))
    out = F.lit(False)
    for m in L.OFFICE_MIME_TYPES:
        out = out | ct.contains(m)
    return out


def url_extension(url) -> Column:
    """Extension of the last path segment (A2): lower-cased, or 'unknown'."""
    u = F.coalesce(col(url), F.lit(""))
    path = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit("unknown"))


def convertible_by_extension(ext) -> Column:
    """Extension (without dot, any case) in the 42-format table."""
    e = F.regexp_replace(F.lower(F.coalesce(col(ext), F.lit(""))), r"^\.", "")
    return e.isin(list(L.CONVERTIBLE_FORMATS))


def convertible_by_url(url) -> Column:
    """C18 (basic): one of 15 extensions found anywhere in the lower-cased URL."""
    u = F.lower(F.coalesce(col(url), F.lit("")))
    out = F.lit(False)
    for s in L.CONVERTIBLE_URL_SUFFIXES:
        out = out | u.contains(s)
    return out


def clamp(c, lo_hi) -> Column:
    lo, hi = lo_hi
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def size_guard(size_bytes, max_mb=50) -> Column:
    """``struct<file_size_mb, limit_mb, too_large>``; MB rounded half-even
    to 3 places, limit clamped to 1..100."""
    mb = col(size_bytes) / F.lit(1048576.0)
    lim = clamp(F.lit(max_mb) if not isinstance(max_mb, Column) else max_mb, L.MAX_FILE_MB)
    return F.struct(F.bround(mb, 3).alias("file_size_mb"), lim.alias("limit_mb"), (mb > lim).alias("too_large"))


def resolve_format(given, file_name, magic=None) -> Column:
    """C17: given format (unless empty/'unknown') -> file-name suffix ->
    magic-byte guess; ``struct<format, error>`` with an error for
    undetermined or unsupported formats."""
    g = F.regexp_replace(F.lower(F.coalesce(col(given), F.lit(""))), r"^\.+", "")
    suffix = F.lower(F.regexp_extract(F.coalesce(col(file_name), F.lit("")), r"\.([^./]*)$", 1))
    cand = F.when((g != "") & (g != "unknown"), g).otherwise(suffix)
    if magic is not None:
        cand = F.when((cand == "") | (cand == "unknown"), F.coalesce(col(magic), F.lit(""))).otherwise(cand)
    err = (F.when((cand == "") | cand.isNull(), F.lit("Unable to determine file format for conversion"))
           .when(~convertible_by_extension(cand), F.concat(F.lit("Unsupported format: "), cand)))
    return F.struct(F.when(err.isNull(), cand).alias("format"), err.alias("error"))


def supported_formats(spark) -> DataFrame:
    """Format table (C18/J4): ``(format, description)``, a fixed 42-row table."""
    return spark.createDataFrame(list(L.CONVERTIBLE_FORMATS.items()), "format string, description string")


# ---- binary inputs (A2, A4, A6, C16) ----
def magic_prefix(content) -> Column:
    """C16 native part: '%PDF', '{\\rtf', 'PK' (zip, needs the member list)."""
    c = col(content)
    return (F.when(F.substring(c, 1, 4) == F.lit(bytearray(b"%PDF")), "pdf")
            .when(F.substring(c, 1, 5) == F.lit(bytearray(b"{\\rtf")), "rtf")
            .when(F.substring(c, 1, 2) == F.lit(bytearray(b"PK")), "zip"))


def _guess_one(b) -> str | None:
    if b is None or len(b) == 0:
        return None
    if b.startswith(b"%PDF"):
        return "pdf"
    if b.startswith(b"{\\rtf"):
        return "rtf"
    if b.startswith(b"PK"):
        try:
            with zipfile.ZipFile(io.BytesIO(b)) as z:
                names = z.namelist()
        except zipfile.BadZipFile:
            return None
        for prefix, fmt in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
            if any(n.startswith(prefix) for n in names):
                return fmt
    try:
        bytes(b[:1024]).decode("utf-8")
        return "txt"
    except UnicodeDecodeError:
        return None


@F.pandas_udf(T.StringType())
def _guess_format_udf(content: pd.Series) -> pd.Series:
    return content.map(_guess_one)


def guess_format(content) -> Column:
    """Magic bytes, zip member prefixes, else UTF-8 text of the first
    1024 bytes -> 'txt', else NULL. Arrow-batched."""
    from ..session import ensure_shipped
    ensure_shipped()
    return _guess_format_udf(col(content))


def _decode_text(b) -> str | None:
    if b is None:
        return None
    for enc in ("utf-8", "latin1", "cp1252"):
        try:
            return bytes(b).decode(enc).strip()
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(T.StringType())
def _decode_text_udf(content: pd.Series) -> pd.Series:
    return content.map(_decode_text)


def decode_text_file(content) -> Column:
    """txt/csv bytes decoded utf-8 -> latin1 -> cp1252, stripped."""
    from ..session import ensure_shipped
    ensure_shipped()
    return _decode_text_udf(col(content))


def read_files(spark, path: str, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """A2: file source ``(path, name, extension, length, content)``. The size
    filter runs on ``length`` before ``content`` is used, so oversized files
    are skipped without decoding."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), url_extension(name).alias("extension"), "length", "content")


def format_lookup(files: DataFrame, formats: DataFrame, ext: str = "ext") -> tuple[DataFrame, DataFrame]:
    """``files`` left-joined to the format table (a fixed, 42-row table,
    broadcast); returns ``(described, unsupported)`` where ``unsupported``
    is the left anti join."""
    f = F.broadcast(formats.withColumnRenamed("format", "_fmt"))
    key = F.regexp_replace(F.lower(F.col(ext)), r"^\.", "")
    keyed = files.withColumn("_key", key)
    described = keyed.join(f, keyed["_key"] == f["_fmt"], "left").drop("_key", "_fmt")
    unsupported = keyed.join(f, keyed["_key"] == f["_fmt"], "left_anti").drop("_key")
    return described, unsupported
