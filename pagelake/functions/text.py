"""Native helpers over plain-text columns (HTML is read as nodes, see operators/nodes.py).

Everything here builds Catalyst expressions (``regexp_replace``,
``regexp_extract``, ``replace``), so it runs inside whole-stage codegen.
Patterns are written to mean the same in Java regex and RE2, so the same
logic can be checked by value against DuckDB.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def expr_cache(fn):
    """Memoise a Column builder per SparkContext when its arguments are
    hashable (column names, literals). Unresolved Column expressions can be
    reused by many DataFrames; building large trees costs many Python-to-JVM
    calls, so queries that share an expression build it once."""
    cache = {}

    @functools.wraps(fn)
    def wrap(*args, **kw):
        sc = SparkContext._active_spark_context
        try:
            key = ((sc.applicationId, sc.startTime) if sc is not None else None, args,
                   tuple(sorted(kw.items())))
            hash(key)
        except TypeError:
            return fn(*args, **kw)
        if key not in cache:
            cache[key] = fn(*args, **kw)
        return cache[key]
    return wrap

def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: all Unicode white space (Spark ``trim`` removes spaces only).
    One jump to the end and back to the last other character, no search at every place."""
    return F.regexp_extract(col(c), r"(?Us)^[\s\x1c-\x1f]*+(.*[^\s\x1c-\x1f])", 1)


def collapse_ws(c) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]+", " "))


def tokens(c) -> Column:
    """Word tokens as Python's Unicode ``\\w+`` sees them (letters, digits, _)."""
    return F.regexp_extract_all(col(c), F.lit(r"[\p{L}\p{N}_]+"), 0)


def count_substr(c, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle`` (left to right, like ``re.findall``)."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def first_match(c, needles, fmt: str = "{}") -> Column:
    """Label of the first needle (in list order) that ``c`` contains, else NULL."""
    out = None
    for n in reversed(list(needles)):
        label = F.lit(fmt.format(n))
        out = F.when(F.instr(col(c), n) > 0, label) if out is None else \
            F.when(F.instr(col(c), n) > 0, label).otherwise(out)
    return out
