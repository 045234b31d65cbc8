"""Cascade builders (B7-B9, user hook for strategy lists).

A strategy list becomes one native expression: a chain of candidates, each
bound to a lambda variable and evaluated only if none before it was taken.
Keep every candidate native (a Python UDF cannot stand in a lambda; bind its
result first).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def let(value: Column, rule) -> Column:
    """``rule(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def _chosen(text: Column, name: Column) -> Column:
    return F.struct(text.alias("text"), name.alias("strategy"))


def cascade(candidates: list[tuple[str, Column]], threshold: int,
            fallback: Column | None = None, fallback_name: str = "fallback") -> Column:
    """First candidate whose stripped text is longer than ``threshold``,
    returned stripped, as ``struct<text, strategy>``; else ``fallback``
    (stripped; default the last candidate) named ``fallback_name``."""
    def rest(i, last):
        if i == len(candidates):
            return _chosen(last if fallback is None else strip(fallback), F.lit(fallback_name))
        name, c = candidates[i]
        return let(strip(F.coalesce(c, F.lit(""))),
                   lambda t: F.when(F.length(t) > threshold, _chosen(t, F.lit(name))).otherwise(rest(i + 1, t)))
    return rest(0, F.lit(""))


def cascade_or_longest(candidates: list[tuple[str, Column]], threshold: int) -> Column:
    """First candidate longer than ``threshold`` (unstripped length), else the
    longest one; ties keep the earlier. ``strategy`` is 'none' when all are
    empty."""
    def rest(i, best):
        if i == len(candidates):
            return best
        name, c = candidates[i]
        return let(F.coalesce(c, F.lit("")),
                   lambda t: F.when(F.length(t) > threshold, _chosen(t, F.lit(name))).otherwise(
                       let(F.when(F.length(t) > F.length(best["text"]), _chosen(t, F.lit(name))).otherwise(best),
                           lambda b: rest(i + 1, b))))
    return rest(0, _chosen(F.lit(""), F.lit("none")))
