"""Corpus-level text statistics described by the reference's documents
(X1-X6). Formulas follow the published literature; for X5 the reference
publishes no weights, so its score is our stated choice (see
:func:`with_coherence`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, expr_cache, strip, tokens
from .nodes import let

VOWELS = "[aeiouyäöüàâéèêëîïôûùœæáíóú]+"


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: plain IEEE steps, so every engine gives
    the same double (decimal-string rounding and binary rounding differ on
    values that print as an exact half)."""
    k = float(10 ** digits)
    return F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)


def content_hash(text) -> Column:
    """SHA-256 of lower-cased text with whitespace runs collapsed."""
    return F.sha2(F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " ")), 256)


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its hash, the first document with that hash and the
    number of copies. The group step is a partial aggregate (a hash held by
    a third of all rows still sends one row per task); the join back on the
    hash is left to AQE's skew-join split."""
    h = docs.select(key, content_hash(text).alias("content_hash"))
    g = h.groupBy("content_hash").agg(F.min(key).alias("dup_of"), F.count("*").alias("n_copies"))
    return h.join(g, "content_hash")


def _readability_struct(words: Column, syl: Column, t: Column) -> Column:
    n = F.size(words)
    sents = F.greatest(F.size(F.regexp_extract_all(t, F.lit(r"[.!?]+"), 0)), F.lit(1))
    paras = F.size(F.filter(F.split(t, r"\n\s*\n"), lambda x: strip(x) != ""))
    nsyl = F.aggregate(syl, F.lit(0), lambda a, x: a + x)
    poly = F.size(F.filter(syl, lambda x: x >= 3))
    mono = F.size(F.filter(syl, lambda x: x == 1))
    longw = F.size(F.filter(words, lambda w: F.length(w) > 6))
    asl = n / sents
    asw = nsyl / n
    flesch = F.lit(180.0) - asl - F.lit(58.5) * asw
    wstf = (F.lit(0.1935) * (poly * 100.0 / n) + F.lit(0.1672) * asl + F.lit(0.1297) * (longw * 100.0 / n)
            - F.lit(0.0327) * (mono * 100.0 / n) - F.lit(0.875))
    ok = n > 0
    return F.struct(n.cast("bigint").alias("words"), F.when(ok, sents).otherwise(0).cast("bigint").alias("sentences"),
                    paras.cast("bigint").alias("paragraphs"),
                    F.when(ok, round_half_up(asl, 4)).alias("avg_sentence_len"),
                    F.when(ok, round_half_up(flesch, 4)).alias("flesch_de"),
                    F.when(ok, round_half_up(wstf, 4)).alias("wiener_sachtext"))


def _syllables(t: Column) -> Column:
    # One regex pass over the whole text: every vowel group becomes the
    # marker 'Q' (absent from lower-cased text). Token boundaries do not
    # move, so the i-th marked token is the i-th word and its syllable
    # count is a plain character count, with no regex per word.
    marked = tokens(F.regexp_replace(F.lower(t), VOWELS, "Q"))
    return F.transform(marked, lambda w: F.greatest(F.length(w) - F.length(F.replace(w, F.lit("Q"), F.lit(""))), F.lit(1)))


@expr_cache
def readability(text) -> Column:
    """Words, sentences, paragraphs, average sentence length, German
    Flesch (Amstad) and first Wiener Sachtextformel; in-row, no shuffle.
    On DataFrames prefer :func:`with_readability`, which tokenises once."""
    t = F.coalesce(col(text), F.lit(""))
    return _readability_struct(tokens(t), _syllables(t), t)


def with_readability(df: DataFrame, text: str = "text", out: str = "readability") -> DataFrame:
    """X2 with the word and syllable arrays materialised as columns (each is
    read by several lambdas, which would otherwise re-tokenise the text)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (df.withColumn("_rt", t).withColumn("_rw", tokens(F.col("_rt"))).withColumn("_rs", _syllables(F.col("_rt")))
            .withColumn(out, _readability_struct(F.col("_rw"), F.col("_rs"), F.col("_rt")))
            .drop("_rt", "_rw", "_rs"))


def lexical_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Type-token ratio, Guiraud's R and Shannon entropy (bits) of every
    document, in its row: the sorted tokens' runs are the types, so nothing is
    exploded or shuffled. Without a token the ratios are NULL."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.coalesce(F.get(at, j + 1), F.size(s)) - i))

    toks = tokens(F.lower(F.coalesce(F.col(text), F.lit(""))))
    counts = let(F.array_sort(toks), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<int>")))
    d = docs.select(key, let(counts, lambda c: F.struct(
        F.size(c).cast("bigint").alias("types"), F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + x).alias("tokens"),
        F.aggregate(c, F.lit(0.0), lambda n, x: n + x * F.log2(x)).alias("cl"))).alias("s")).select(key, "s.*")
    some = F.col("tokens") > 0
    return d.select(key, "types", "tokens",
                    F.when(some, F.bround(F.col("types") / F.col("tokens"), 6)).alias("ttr"),
                    F.when(some, F.bround(F.col("types") / F.sqrt("tokens"), 6)).alias("guiraud_r"),
                    F.when(some, F.bround(F.log2("tokens") - F.col("cl") / F.col("tokens"), 6)).alias("entropy_bits"))


@expr_cache
def structure(text) -> Column:
    """Markdown headings, paragraphs, caps ratio, special-character
    ratio and repeated-line ratio."""
    t = F.coalesce(col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: strip(x) != "")
    nl = F.size(lines)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    special = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    return F.struct(
        F.size(F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s"))).cast("bigint").alias("headings"),
        F.size(F.filter(F.split(t, r"\n\s*\n"), lambda x: strip(x) != "")).cast("bigint").alias("paragraphs"),
        F.when(letters > 0, F.bround(upper / letters, 6)).otherwise(F.lit(0.0)).alias("caps_ratio"),
        F.when(F.length(t) > 0, F.bround(special / F.length(t), 6)).otherwise(F.lit(0.0)).alias("special_ratio"),
        F.when(nl > 0, F.bround(1 - F.size(F.array_distinct(F.transform(lines, lambda x: strip(x)))) / nl, 6))
        .otherwise(F.lit(0.0)).alias("repetition_ratio"))


SENTENCE_SPLIT = r"[.!?]+\s*"


def with_coherence(df: DataFrame, text: str = "text", out: str = "coherence") -> DataFrame:
    """X5 (our choice of weights): sentence-overlap coherence = mean Jaccard
    overlap of the lower-cased word sets of adjacent sentences (pairs whose
    union is empty count 0), rounded half-up to 4 places; NULL below two
    sentences. ``likert`` maps it to 1..5 as ``min(5, 1 + floor(5 * c))``.
    In-row: the sentence word sets are a materialised column read by the
    pair lambda."""
    t = F.coalesce(F.col(text), F.lit(""))
    sents = F.filter(F.split(t, SENTENCE_SPLIT), lambda x: strip(x) != "")
    d = df.withColumn("_sets", F.transform(sents, lambda x: F.array_distinct(tokens(F.lower(x)))))
    n = F.size("_sets")

    def jac(i):
        a, b = F.element_at("_sets", i), F.element_at("_sets", i + 1)
        u = F.size(F.array_union(a, b))
        return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), jac)
    mean = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / (n - 1)
    c = F.when(n >= 2, round_half_up(mean, 4))
    return (d.withColumn(out, F.struct(n.cast("bigint").alias("sentences"), c.alias("score"),
                                       F.when(c.isNotNull(), F.least(F.lit(5), F.lit(1) + F.floor(c * 5)))
                                       .cast("bigint").alias("likert")))
            .drop("_sets"))


def link_graph(links_long: DataFrame, src_host: str = "src_host", dst_host: str = "dst_host") -> DataFrame:
    """Host graph from exploded links: per host, outgoing and incoming
    link counts and distinct neighbour hosts (self-links excluded)."""
    e = (links_long.where((F.col(dst_host) != "") & (F.col(dst_host) != F.col(src_host)))
         .groupBy(src_host, dst_host).agg(F.count("*").alias("n")))
    out = e.groupBy(F.col(src_host).alias("host")).agg(F.sum("n").alias("out_links"), F.count("*").alias("out_hosts"))
    inn = e.groupBy(F.col(dst_host).alias("host")).agg(F.sum("n").alias("in_links"), F.count("*").alias("in_hosts"))
    return out.join(inn, "host", "full_outer").select(
        "host", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("out_links", "out_hosts", "in_links", "in_hosts")])
