"""Keyword hits by joins, for lexicons of any size."""

from __future__ import annotations

import random
import re

from pagelake.operators import quality as Q


def slow(docs, lexicon):
    out = {}
    for key, text in docs:
        low = (text or "").strip().lower()
        words = re.findall(r"\w+", low)
        for cat, k in {(c, k.strip()) for c, k in lexicon if k and k.strip()}:
            n = low.count(k) if re.search(r"\s", k) else words.count(k)
            if n:
                out[key, cat] = out.get((key, cat), 0) + n
    return out


def fast(spark, docs, lexicon):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lx = spark.createDataFrame(lexicon, "category string, keyword string")
    return {(r.doc_id, r.category): r.hits for r in Q.keyword_hits_joined(d, lx).collect()}


def test_joined_hits_equal_a_search_per_keyword(spark):
    rng = random.Random(4)
    words = ["a", "b", "aa", "ab", "über", "x1", "a-b", "c"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", ", "]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "A A A a a"), (103, "a b a b a")]
    lexicon = [(rng.choice("pqr"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for _ in range(80)]
    lexicon += [("p", "a a"), ("p", "a a"), ("q", "a b a"), ("q", ""), ("q", None), ("r", " b "), ("r", "aa  ab"), ("r", "a\nb")]
    assert fast(spark, docs, lexicon) == slow(docs, lexicon)


def test_lexicons_without_words_or_phrases_or_rows(spark):
    docs = [(1, "not found here, not found"), (2, "found")]
    assert fast(spark, docs, [("e", "not found")]) == {(1, "e"): 2}
    assert fast(spark, docs, [("e", "found")]) == {(1, "e"): 2, (2, "e"): 1}
    assert fast(spark, docs, []) == {}
    assert fast(spark, [], [("e", "not found"), ("e", "found")]) == {}


def test_two_hundred_thousand_phrases(spark):
    from pyspark.sql import functions as F
    n = F.col("id").cast("string")
    lexicon = spark.range(200_000).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("category"),
                                          F.concat(F.lit("word"), (F.col("id") % 1000).cast("string"), F.lit(" of "), n).alias("keyword"))
    docs = spark.createDataFrame([(1, "word7 of 1007 and word7 of 100x, word8 of 1007; WORD1 OF 1 word1 of 1"), (2, "nothing")], "doc_id long, text string")
    got = {(r.category, r.hits) for r in Q.keyword_hits_joined(docs, lexicon).collect()}
    expected = {}
    for i in range(200_000):
        c = "word7 of 1007 and word7 of 100x, word8 of 1007; word1 of 1 word1 of 1".count(f"word{i % 1000} of {i}")
        if c:
            expected[f"c{i % 3}"] = expected.get(f"c{i % 3}", 0) + c
    assert got == set(expected.items())


def test_a_small_lexicon_shuffles_no_words(spark):
    docs = spark.createDataFrame([(i, "page not found, try again " * 3) for i in range(50)], "doc_id long, text string")
    hits = Q.keyword_hits_joined(docs, Q.lexicon_frame(spark))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert hits.count() == 50
