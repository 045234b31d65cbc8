"""Request normalisation (A3) and request-to-page resolution.

Invalid requests become rows with a ``reject_reason`` instead of raising,
so one bad request never fails a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import col, strip

PORT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def normalise_proxies(proxies) -> Column:
    """A3: drop no-proxy markers ('', string, none, null, false, 0; trimmed,
    any case) and NULLs, trim the rest; NULL when nothing is left."""
    kept = F.filter(col(proxies), lambda x: x.isNotNull() & (strip(x) != "")
                    & ~F.lower(strip(x)).isin(L.NO_PROXY_VALUES))
    kept = F.transform(kept, lambda x: strip(x))
    return F.when(F.size(kept) > 0, kept)


def proxy_error(proxies) -> Column:
    """A3: first validation error of a normalised proxy list, else NULL."""
    def err(x):
        host = F.substring_index(x, ":", 1)
        port = F.substring(x, F.instr(x, ":") + 1, 1 << 30)
        return (F.when(~x.contains(":"), F.concat(F.lit("Invalid proxy format: "), x, F.lit(". Expected 'host:port'")))
                .when((strip(host) == "") | (strip(port) == ""),
                      F.concat(F.lit("Invalid proxy format: "), x, F.lit(". Host and port cannot be empty")))
                .when(~port.rlike(PORT), F.concat(F.lit("Invalid proxy format: "), x, F.lit(". Port must be numeric"))))
    return F.get(F.filter(F.transform(col(proxies), err), lambda e: e.isNotNull()), 0)


def _bound(df: DataFrame, name: str, lo_hi) -> Column:
    lo, hi = lo_hi
    if name not in df.columns:
        return F.lit(None).cast("string")
    c = F.col(name)
    return F.when(c.isNotNull() & ((c < lo) | (c > hi)), F.lit(f"{name} must be between {lo} and {hi}"))


def normalise_requests(requests: DataFrame) -> DataFrame:
    """A3: defaults, bounds and proxy list; adds ``proxies_norm`` and ``reject_reason``."""
    df = requests
    if "proxies" not in df.columns:
        df = df.withColumn("proxies", F.lit(None).cast("array<string>"))
    elif df.schema["proxies"].dataType.simpleString() == "string":
        # A single proxy string is a one-element list.
        df = df.withColumn("proxies", F.when(F.col("proxies").isNotNull(), F.array(F.col("proxies"))))
    df = df.withColumn("proxies_norm", normalise_proxies("proxies"))
    reason = F.coalesce(_bound(df, "max_file_size_mb", L.MAX_FILE_MB),
                        _bound(df, "conversion_timeout", L.CONVERSION_TIMEOUT_S),
                        _bound(df, "timeout", L.REQUEST_TIMEOUT_S),
                        proxy_error("proxies_norm"))
    return df.withColumn("reject_reason", reason)


def resolve_requests(requests: DataFrame, pages: DataFrame, text: Column) -> DataFrame:
    """Each request gets its page's extracted ``text`` by a left join on
    URL; requests without a page, or whose text is empty, become error rows
    (status 500, ``extraction_error``). ``text`` is evaluated on ``pages``
    before the join, so HTML is never shuffled."""
    from ..operators.classify import status_message
    t = pages.select(F.col("url").alias("_url"), text.alias("_text"))
    j = requests.join(t, requests["url"] == t["_url"], "left")
    ok = F.col("_url").isNotNull() & (F.coalesce(F.col("_text"), F.lit("")) != "")
    msg = (F.when(F.col("_url").isNull(), F.lit("Extraction failed: no fetched page for this URL"))
           .otherwise(F.lit("Extraction failed: No text content could be extracted")))
    return j.select(
        *[c for c in requests.columns],
        F.col("_url").isNotNull().alias("matched"),
        F.when(ok, F.col("status")).otherwise(F.lit(500)).alias("http_status"),
        F.when(ok, F.lit("success")).otherwise(F.lit("extraction_error")).alias("reason"),
        F.when(ok, F.col("_text")).otherwise(F.lit("")).alias("text"),
        F.when(ok, status_message(F.col("status"), F.length("_text"))).otherwise(msg).alias("message"))
