"""Raw HTTP bodies and the result sink (A4, A5).

Binary test, UTF-8 validation and the Latin-1 fallback are native columns; only
gzip bodies reach Python, to be inflated.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col

#: Most bytes that a gzip body may inflate to by default; the text of a larger one
#: is NULL and :func:`is_oversized` marks it.
GUNZIP_MAX_BYTES = 256 << 20


def _is_gzip(body: Column) -> Column:
    return F.substring(body, 1, 2) == F.lit(bytearray(b"\x1f\x8b"))


def is_binary(body) -> Column:
    """A4: gzip magic ``1f8b`` or a NUL byte within the first 1024 bytes."""
    head = F.substring(col(body), 1, 1024)
    nul = F.hex(head).rlike("^(?:[0-9A-F]{2})*?00")
    return _is_gzip(col(body)) | nul


def _inflate(body: bytes | None, limit: int) -> tuple[bytes | None, bool]:
    """All gzip members of a body (None if it is broken or too large), and whether it is too large."""
    if body is None:
        return None, False
    out, rest = bytearray(), bytes(body)
    try:
        while rest:
            z = zlib.decompressobj(wbits=31)
            out += z.decompress(rest, limit - len(out) + 1)
            if len(out) > limit:
                return None, True
            if not z.eof:
                return None, False
            rest = z.unused_data.lstrip(b"\0")
    except zlib.error:
        return None, False
    return bytes(out), False


@F.pandas_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("oversized", T.BooleanType())]))
def _inflate_udf(body: pd.Series, limit: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_inflate(b, int(most)) for b, most in zip(body, limit, strict=True)], columns=["body", "oversized"])


def _inflated(body: Column, max_bytes: int) -> Column:
    from ..session import ensure_shipped
    ensure_shipped()
    return _inflate_udf(F.when(_is_gzip(body), body), F.lit(max_bytes))


def decode_body(body, max_bytes: int = GUNZIP_MAX_BYTES) -> Column:
    """A4: bytes -> text. Text bodies are UTF-8 with replacement characters;
    binary ones are inflated if they are gzip, and read as UTF-8 if valid, else as
    Latin-1. A broken gzip body counts as text; one that inflates to over
    ``max_bytes`` has no text (NULL, see :func:`is_oversized`)."""
    b = col(body)

    def utf8_or_latin1(x: Column) -> Column:
        return F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")).otherwise(F.decode(x, "ISO-8859-1"))

    inflated = _inflated(b, max_bytes)
    return (F.when(inflated["oversized"], F.lit(None).cast("string"))
            .when(_is_gzip(b) & inflated["body"].isNotNull(), utf8_or_latin1(inflated["body"]))
            .when(is_binary(b) & ~_is_gzip(b), utf8_or_latin1(b))
            .otherwise(F.make_valid_utf8(b.cast("string"))))


def is_oversized(body, max_bytes: int = GUNZIP_MAX_BYTES) -> Column:
    """Whether a gzip body inflates to over ``max_bytes``."""
    return F.coalesce(_inflated(col(body), max_bytes)["oversized"], F.lit(False))


def write_results(df: DataFrame, path: str, partition_by: str | None = "host_bucket",
                  buckets: int = 64, fmt: str = "parquet") -> None:
    """A5: one flat record per page. With ``partition_by='host_bucket'`` the
    rows are partitioned by a hash bucket of the host, so a skewed host
    cannot create one huge directory listing per host value."""
    out = df
    if partition_by == "host_bucket" and "host" in df.columns:
        out = df.withColumn("host_bucket", F.pmod(F.xxhash64("host"), F.lit(buckets)))
    w = out.write.mode("overwrite")
    if partition_by and partition_by in out.columns:
        w = w.partitionBy(partition_by)
    if fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
