"""URL helpers: netloc, hostname, resolution.

``parse_url`` returns NULL for URLs with a space or ``[``, so these helpers
use anchored regexes that behave like ``urllib.parse`` on such input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, expr_cache

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
ABS = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
NETLOC = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


@expr_cache
def netloc(u) -> Column:
    """``urlparse(u).netloc.lower()`` (keeps port and user-info)."""
    return F.lower(F.regexp_extract(col(u), NETLOC, 1))


@expr_cache
def hostname(u) -> Column:
    """``urlparse(u).hostname or ''``: no user-info, no port, lower-cased."""
    n = netloc(u)
    n = F.regexp_replace(n, r"^.*@", "")
    n = F.regexp_replace(n, r":[0-9]*$", "")
    return F.regexp_replace(n, r"^\[|\]$", "")


def remove_dot_segments(p) -> Column:
    """``.`` and ``..`` segments folded over the path from left to right, however
    many there are: ``..`` takes the last segment off (also the empty one before
    the first slash, as urllib does), ``.`` adds nothing."""
    p = col(p)
    segments = F.split(p, "/")
    nothing = F.lit("\u0001")  # no segment at all, unlike one empty segment
    folded = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.lit(""),
        lambda path, x: F.when(x == "..", F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(nothing))
        .when(x == ".", path).when(path == nothing, x).otherwise(F.concat(path, F.lit("/"), x)),
        lambda path: F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, "\u0001", "")), "^//", "/"))
    closed = F.when(F.element_at(segments, -1).isin(".", "..") & (folded != "/"), F.concat(folded, F.lit("/"))).otherwise(folded)
    # most paths have no dot segment: those keep out of the interpreted fold
    return F.when(p.rlike(r"/\.\.?(?:/|$)"), closed).otherwise(p)


@expr_cache
def resolve(base, href) -> Column:
    """``urllib.parse.urljoin(base, href)`` for absolute, ``//host``, ``/path``,
    ``?query``, ``#frag`` and relative paths with dot segments."""
    b, h = col(base), col(href)
    h = F.when(h.startswith("///"), F.substr(h, F.lit(3))).otherwise(h)  # no host: a path
    scheme = F.regexp_extract(b, SCHEME, 1)
    origin = F.regexp_extract(b, ORIGIN, 1)
    path = F.regexp_extract(b, PATH, 1)
    rest = F.regexp_extract(h, r"(?s)[?#].*$", 0)
    directory = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (F.when(h.rlike(ABS), h)
            .when(h.startswith("//") & ~h.rlike("^//(?:[/?#]|$)"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, remove_dot_segments(F.regexp_extract(h, r"^[^?#]*", 0)), rest))
            .when(h.startswith("?"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), h))
            .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), h))
            .when(h == "", b)
            .otherwise(F.concat(origin, remove_dot_segments(F.regexp_replace(
                F.concat(directory, F.regexp_extract(h, r"^[^?#]*", 0)), "/{2,}", "/")), rest)))


def is_internal(link, base) -> Column:
    """Same netloc, empty netloc (mailto:, tel:), or a subdomain of the base."""
    ln, bn = netloc(link), netloc(base)
    return (ln == bn) | (ln == "") | ln.endswith(F.concat(F.lit("."), bn))
