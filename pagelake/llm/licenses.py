"""License scan by diagonal voting (operator 8), in DataFrame functions only.

All rolling word k-grams of the texts are hashed and joined to the k-grams of
license templates. A hit votes for its diagonal (place in the text minus place
in the template). For the base phrases a diagonal with all votes is a place
where the phrase stands word by word. For the longer templates neighbouring
diagonals (``GAP``) are merged into spans, and a span is verified: at least
``COVER`` of the template's k-grams are in it, and it is at most ``STRETCH``
times as long as the template.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.

Defined cases: NULL and empty texts have no words and no labels (empty
strings, score 0, NULL places); texts shorter than a k-gram have no labels;
repeated rows and NULL ids keep one row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, shared_table, text_key

K = 2
GAP = 2
COVER = 0.8
STRETCH = 1.5
BROADCAST_BYTES = 16 << 20

# The phrases and labels of the base scan.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Templates of the method's own labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
]

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """The words of a text column, as an array."""
    cut = F.split(lower_ascii(text), SEPARATOR)
    lead = F.when(F.element_at(cut, 1) == "", 1).otherwise(0)
    trail = F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)
    return F.slice(cut, 1 + lead, F.greatest(F.size(cut) - lead - trail, F.lit(0)))


def _templates(spark: SparkSession) -> DataFrame:
    rows = []
    for tid, (base, label, phrase) in enumerate([(True, a, b) for a, b in BASE.items()] + [(False, a, b) for a, b in TEMPLATES]):
        w = phrase.split()
        rows += [(tid, base, label, len(w), i, w[i], w[i + 1]) for i in range(len(w) - K + 1)]
    t = spark.createDataFrame(rows, "tid int, base boolean, label string, m int, tpos int, a string, b string")
    return t.withColumn("h", F.xxhash64("a", "b"))


def hits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``k1``, ``k2`` (the text), template columns, ``pos``: k-grams of texts in templates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = text_key(text)
    named = docs.select(k1.alias("k1"), k2.alias("k2"), words(text).alias("w"))
    n = F.size("w") - (K - 1)
    pairs = F.arrays_zip(F.slice("w", 1, n).alias("a"), F.slice("w", 2, n).alias("b"))
    grams = named.where(n > 0).select("k1", "k2", F.posexplode(pairs).alias("pos", "g"))
    grams = grams.select("k1", "k2", "pos", F.col("g.a").alias("ga"), F.col("g.b").alias("gb")).withColumn("h", F.xxhash64("ga", "gb"))
    found = grams.join(F.broadcast(_templates(docs.sparkSession)), "h")  # the templates are a fixed, small set
    return found.where("ga = a AND gb = b").select("k1", "k2", "tid", "base", "label", "m", "tpos", "pos")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score`` (share of the best template that was found) of each text."""
    votes = hits(docs, text_col).groupBy("k1", "k2", "tid", "base", "label", "m", (F.col("pos") - F.col("tpos")).alias("diagonal")) \
        .agg(F.collect_set("tpos").alias("at"))  # at most the template's k-grams
    votes = shared_table(votes, "license-votes")
    base = votes.where("base").where(F.size("at") == F.col("m") - (K - 1)) \
                .select("k1", "k2", "label", F.lit(True).alias("base"), F.col("diagonal").alias("place"), F.lit(1.0).alias("cover"))
    order = Window.partitionBy("k1", "k2", "tid").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= GAP, 0).otherwise(1)
    runs = votes.where("NOT base").withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
    spans = runs.groupBy("k1", "k2", "tid", "label", "m", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("got"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("start"), F.max(F.col("diagonal") + F.array_max("at") + K).alias("stop"))
    cover = F.col("got") / (F.col("m") - (K - 1))
    spans = spans.where((cover >= COVER) & (F.col("stop") - F.col("start") <= STRETCH * F.col("m"))) \
                 .select("k1", "k2", "label", F.lit(False).alias("base"), F.lit(None).cast("int").alias("place"), cover.alias("cover"))
    named = base.unionByName(spans).groupBy("k1", "k2").agg(
        F.count("place").alias("n_base"), F.min("place").cast("long").alias("first_word"), F.max("place").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"))
    named = broadcast_if_small(shared_table(named, "license-labels"), BROADCAST_BYTES)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = text_key(text)
    rows = docs.select(F.col(id_col), k1.alias("k1"), k2.alias("k2"), F.size(words(text)).cast("long").alias("n_words"))
    return rows.join(named, ["k1", "k2"], "left").select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


ORACLE = r"""
WITH t AS (SELECT * FROM (VALUES
    (0, true, 'cc-by', 'cc by'), (1, true, 'gpl', 'general public license'), (2, true, 'reserved', 'all rights reserved'),
    (3, false, 'apache-2.0', 'licensed under the apache license version 2 0'),
    (4, false, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
    (5, false, 'cc-by-nc', 'licensed under cc by nc 4 0'), (6, false, 'cc-by-sa', 'licensed under cc by sa 4 0'),
    (7, false, 'gpl-3.0', 'this work is licensed under the gnu general public license version 3'),
    (8, false, 'mit', 'released under the mit license'),
    (9, false, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
    (10, false, 'mpl-2.0', 'subject to the terms of the mozilla public license v 2 0')) x(tid, base, label, phrase)),
tw AS (SELECT tid, base, label, string_split(phrase, ' ') AS w FROM t),
tg AS (SELECT tid, base, label, len(w) AS m, i - 1 AS tpos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tw)),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT rid, tid, base, label, m, pos - tpos AS diagonal, list(DISTINCT tpos) AS tps FROM g JOIN tg USING (a, b) GROUP BY ALL),
b AS (SELECT rid, label, true AS base, diagonal AS place, 1.0::DOUBLE AS cover FROM v WHERE base AND len(tps) = m - 1),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS span FROM
      (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS fresh FROM v WHERE NOT base)),
s AS (SELECT rid, label, m, len(list_distinct(flatten(list(tps)))) AS got, min(diagonal + list_min(tps)) AS start, max(diagonal + list_max(tps) + 2) AS stop
      FROM r GROUP BY rid, tid, label, m, span),
a AS (SELECT * FROM b UNION ALL
      SELECT rid, label, false, NULL, got / (m - 1) FROM s WHERE got / (m - 1) >= 0.8 AND stop - start <= 1.5 * m),
n AS (SELECT rid, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM a GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN n USING (rid)
"""
