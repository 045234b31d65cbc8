"""Keyword hits, content category and quality struct.

Single-word keywords are matched on word tokens (Python's Unicode ``\\b``
equals ``[\\p{L}\\p{N}_]+`` tokenisation), phrases by non-overlapping
substring counts. For a fixed lexicon the test is an ``IN`` list inside a
lambda, so no join is needed; :func:`keyword_hits_joined` is the join form for
user-supplied lexicons of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import col, count_substr, expr_cache, strip, tokens


def keyword_count(lower_text: Column, keywords, toks: Column | None = None) -> Column:
    """Hits of one lexicon in lower-cased, stripped text. Pass ``toks``
    (a materialised token column) when several lexicons share one text:
    a lambda re-evaluates its array argument, so an inline tokenisation
    would run once per lexicon."""
    words = [k for k in keywords if len(k.split()) == 1]
    phrases = [k for k in keywords if len(k.split()) > 1]
    toks = tokens(lower_text) if toks is None else toks
    n = F.size(F.filter(toks, lambda x: x.isin(words))).cast("bigint")
    for p in phrases:
        n = n + count_substr(lower_text, p)
    return n


def quality_metrics(text, lexicons=None) -> Column:
    """C3 counts: ``struct<character_length, e, c, m>`` (see :func:`classify`).
    Use :func:`with_quality` on DataFrames: it materialises the stripped,
    lower-cased text once instead of once per keyword test."""
    lex = lexicons or L.LEXICONS
    s = strip(F.coalesce(col(text), F.lit("")))
    return _counts(F.length(s).cast("bigint"), F.lower(s), lex)


def _counts(n: Column, low: Column, lex, toks: Column | None = None) -> Column:
    return F.struct(n.alias("character_length"), keyword_count(low, lex["error_page"], toks).alias("e"),
                    keyword_count(low, lex["educational_content"], toks).alias("c"),
                    keyword_count(low, lex["educational_metadata"], toks).alias("m"))


def classify(q: Column) -> Column:
    """C2 on the counts of :func:`quality_metrics` (error bias below 800
    chars; arg-max with ties content > metadata > error; none -> other)."""
    e, c, m, n = q["e"], q["c"], q["m"], q["character_length"]
    total = e + c + m
    best = F.greatest(c, m, e)
    cat = (F.when((e > 0) & (n < L.ERROR_PAGE_MAX_CHARS), "error_page")
           .when(best == 0, "other")
           .when(c == best, "educational_content")
           .when(m == best, "educational_metadata")
           .otherwise("error_page"))
    num = F.when((e > 0) & (n < L.ERROR_PAGE_MAX_CHARS), e).otherwise(best)
    conf = F.when(cat == "other", F.lit(0.0)).otherwise(
        F.bround(F.least(F.lit(1.0), num / F.greatest(total, F.lit(1))), 3))
    return F.struct(n.alias("character_length"), cat.alias("content_category"), conf.alias("confidence"),
                    F.struct(e.alias("error_page"), c.alias("educational_content"),
                             m.alias("educational_metadata")).alias("matched_keywords"))


def with_quality(df: DataFrame, text: str = "text", out: str = "quality_metrics") -> DataFrame:
    """Add the C3 struct; counts are computed once, then classified."""
    return (df.withColumn("_qs", _stripped(text))
            .withColumn("_ql", F.lower("_qs")).withColumn("_qt", tokens(F.col("_ql")))
            .withColumn("_qc", _named_counts("_qs", "_ql", "_qt"))
            .withColumn(out, _classified("_qc")).drop("_qc", "_qs", "_ql", "_qt"))


@expr_cache
def _stripped(text: str) -> Column:
    return strip(F.coalesce(F.col(text), F.lit("")))


@expr_cache
def _named_counts(name: str, low: str, toks: str) -> Column:
    return _counts(F.length(name).cast("bigint"), F.col(low), L.LEXICONS, F.col(toks))


@expr_cache
def _classified(name: str) -> Column:
    return classify(F.col(name))


def lexicon_frame(spark, lexicons=None) -> DataFrame:
    """The lexicon as a small DataFrame ``(category, keyword, is_phrase)``."""
    lex = lexicons or L.LEXICONS
    rows = [(cat, k, len(k.split()) > 1) for cat, ks in lex.items() for k in ks]
    return spark.createDataFrame(rows, "category string, keyword string, is_phrase boolean")


#: White space, as a character class's inside.
SPACES = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def keyword_hits_joined(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """J2/G3 join form: hits per (key, category) of ``lexicon(category, keyword)``,
    which may have any size. The same counts as :func:`keyword_count`: words are
    whole tokens, phrases (keywords that hold white space) are substrings counted
    without overlap. Keywords are trimmed; empty, NULL and repeated ones count
    once or not at all; a text without hits has no row.

    Nothing of the lexicon is collected but the distinct lengths of the phrases'
    first words and the longest phrase. Words are an equi-join on tokens. A phrase
    can only start where as many characters as its first word has stand before
    white space, so for each such length these places of a text are cut out, as
    long as the longest phrase, and joined on first word, white space and the
    character after it; the cut then has to start with the phrase. Before that, the
    three characters around a word's end have to be those of some phrase, which
    most words' are not. The lexicon is written first, as Spark knows the size of a
    table: it broadcasts one that is small, so that no text or word is shuffled,
    and shuffles otherwise (AQE splits frequent words). Only phrases that can
    overlap themselves and have two hits in a text are counted again in that text."""
    from ..session import materialise
    lex = materialise(lexicon.select("category", strip("keyword").alias("keyword")).where(F.col("keyword") != "").distinct()
                      .withColumn("_first", F.length(F.regexp_extract("keyword", f"^([^{SPACES}]+)[{SPACES}]", 1))), "lexicon")
    low = docs.select(key, F.lower(strip(F.coalesce(F.col(text), F.lit("")))).alias("_t"))
    words = (low.select(key, F.explode(tokens("_t")).alias("keyword"))
             .join(lex.where("_first = 0").select("category", "keyword"), "keyword")
             .groupBy(key, "category").agg(F.count("*").alias("hits")))
    phrases = lex.where("_first > 0")
    shape = phrases.agg(F.array_sort(F.collect_set("_first")).alias("firsts"), F.max(F.length("keyword")).alias("longest")).first()
    found = [words]
    if shape["firsts"]:
        most, longest = shape["firsts"][-1], shape["longest"]
        # one cut per word that white space follows: its end, as long as any first word, and what comes after it
        ends = F.regexp_extract_all("_t", F.lit(rf"(?s)(?<![^{SPACES}])[^{SPACES}]*?(?=([^{SPACES}]{{1,{most}}}[{SPACES}].{{0,{longest}}}))[^{SPACES}]+"), 1)
        firsts = F.array(*map(F.lit, shape["firsts"]))
        around = phrases.select(F.substring("keyword", F.col("_first"), F.lit(3)).alias("around")).distinct()
        words_ends = (low.select(key, F.explode(ends).alias("c")).withColumn("around", F.regexp_extract("c", f"(?s)[^{SPACES}][{SPACES}].", 0))
                      .join(around, "around", "left_semi").withColumn("at", F.length(F.regexp_extract("c", f"^[^{SPACES}]+", 0))))
        places = (words_ends.select(key, "c", "at", F.explode(F.filter(firsts, lambda n: n <= F.col("at"))).alias("n"))
                  .select(key, F.substring("c", F.col("at") - F.col("n") + 1, F.col("n") + 2).alias("start"),
                          F.substring("c", F.col("at") - F.col("n") + 1, F.lit(longest)).alias("cut")))
        starts = phrases.withColumn("start", F.substring("keyword", F.lit(1), F.col("_first") + 2))
        # read twice, and its few self-overlapping phrases are a table of their own, whose size is known: no reason to shuffle texts
        once = materialise(places.join(starts, "start").where(F.startswith("cut", "keyword"))
                           .groupBy(key, "category", "keyword").agg(F.count("*").alias("hits")), "phrase_hits")
        k = F.col("keyword")
        overlaps = (F.col("hits") > 1) & F.exists(F.sequence(F.lit(1), F.length(k) - 1), lambda i: F.left(k, i) == F.right(k, i))
        again = (materialise(once.where(overlaps), "overlapping_hits").join(low, key)
                 .select(key, "category", ((F.length("_t") - F.length(F.replace("_t", k, F.lit("")))) / F.length(k)).cast("bigint").alias("hits")))
        found += [once.where(~overlaps).select(key, "category", "hits"), again]
    return reduce(DataFrame.unionByName, found).groupBy(key, "category").agg(F.sum("hits").cast("bigint").alias("hits"))
