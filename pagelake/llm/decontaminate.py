"""Benchmark decontamination (operator 7), in DataFrame functions only.

A text is contaminated by a benchmark item if a window of the text, as many
words long as the item (the whole text, if it is shorter), has a weighted
shingle similarity of at least ``SIMILARITY`` with it: the Jaccard similarity of
their multisets of ``SHINGLE``-word shingles, each weighted by how often it
occurs. An item of fewer words has one shingle, all of it.

1. Hits. All shingle hashes of the texts are joined to the items' shingles.
2. Windows. A window of ``W`` shingles and an item of ``S`` are similar only if
   ``SIMILARITY`` / (1 + ``SIMILARITY``) of ``S + W`` shingles are shared, so at least so
   many places of the window are hits. Of the windows of a text and an item that
   have them, the first one with the largest shared multiset (by 64-bit hashes) goes
   on. Only windows that start with a hit, or end the text, need be looked at: any other
   one loses nothing if it starts a word later.
3. Verification by the exact weighted similarity, on words.

Nothing else decides: a SimHash radius would drop windows that pass the similarity,
since an item whose head or tail is cut differs in a ninth of its words.

Words are lower-case runs of letters and digits. Defined cases: NULL or empty
texts and items without a word are never contaminated or contaminating;
repeated items count once per item_id, with NULL item_ids none; repeated rows and
NULL doc_ids keep one row each; without benchmark items all texts are clean;
other columns are untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_table, text_key

SHINGLE = 5
SIMILARITY = 0.8
BROADCAST_BYTES = 16 << 20


def words(text):
    cut = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    lead = F.when(F.element_at(cut, 1) == "", 1).otherwise(0)
    trail = F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)
    return F.slice(cut, 1 + lead, F.greatest(F.size(cut) - lead - trail, F.lit(0)))


def _shingles(w, k):
    return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))


def _let(value, rule):
    """``rule(value)`` with ``value`` computed once per row: lambdas would otherwise
    compute an array that they refer to for each of its elements."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def _similarity(w, item, k):
    """Jaccard similarity of the multisets of k-word shingles of two word arrays."""
    def often(s, x):
        return F.size(F.filter(x, lambda y: y == s))

    def ratio(a, b):
        both = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, s: n + F.least(often(s, a), often(s, b)))
        return _let(both, lambda n: n / (F.size(a) + F.size(b) - n))

    return _let(_shingles(w, k), lambda a: _let(_shingles(item, k), lambda b: ratio(a, b)))


def _grams(named: DataFrame, k: int) -> DataFrame:
    """``k1``, ``k2``, ``n`` (words of the text), ``pos`` and ``h`` of all k-word shingles."""
    n = F.size("w") - (k - 1)
    parts = F.arrays_zip(*(F.slice("w", 1 + i, n).alias(f"w{i}") for i in range(k)))
    rows = named.where(n > 0).select("k1", "k2", F.size("w").alias("n"), F.posexplode(parts).alias("pos", "g"))
    return rows.select("k1", "k2", "n", "pos", F.xxhash64(*(F.col(f"g.w{i}") for i in range(k))).alias("h"))


def _best_window(hits, n, m, k, shared, item_hashes):
    """``shared`` (size of the shared multiset) and ``back`` (minus the start) of the best
    window of ``m`` words with ``shared`` or more hits, or NULL. ``hits``: ``pos`` and ``h``
    in order, ``n``: words of the text, ``item_hashes``: one for each of the item's shingles."""
    last, reach = F.greatest(F.lit(0), n - m), m - k

    def often(h, x):
        return F.size(F.filter(x, lambda y: y == h))

    def both(h):
        once = F.size(F.array_distinct(item_hashes)) == F.size(item_hashes)
        each = F.aggregate(F.array_distinct(h), F.lit(0), lambda c, x: c + F.least(often(x, h), often(x, item_hashes)))
        return F.when(once, F.size(F.array_distinct(h))).otherwise(each)

    def windows(p):
        def at(x, i):
            enough = (x["pos"] <= last) & (F.get(p, i + shared - 1)["pos"] <= x["pos"] + reach)
            inside = F.transform(F.filter(F.slice(p, i + 1, reach + 1), lambda y: y["pos"] <= x["pos"] + reach), lambda y: y["h"])
            return F.when(enough, F.struct(_let(inside, both).alias("shared"), (-x["pos"]).alias("back")))

        end = F.transform(F.filter(p, lambda y: y["pos"] >= last), lambda y: y["h"])
        final = F.when(F.get(p, F.size(p) - shared)["pos"] >= last, F.struct(_let(end, both).alias("shared"), (-last).alias("back")))
        return F.array_max(F.concat(F.transform(p, at), F.array(final)))

    return _let(hits, windows)


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``k1``, ``k2`` (the text), ``start`` and ``size`` of the window, ``item`` and
    ``similarity`` of the most similar window of each text and item that contaminates it."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()) \
                     .select(F.col(item_id).alias("item"), words(F.col(item_text).cast("string")).alias("iw")).where("size(iw) > 0").distinct() \
                     .withColumns({"m": F.size("iw"), "k": F.least(F.size("iw"), F.lit(SHINGLE)), "no": F.monotonically_increasing_id()})
    items = shared_table(items, "items")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = text_key(text)
    raw = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("t"))
    named = raw.select("k1", "k2", words(F.col("t")).alias("w"))
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most SHINGLE numbers
    if not sizes:
        return docs.sparkSession.createDataFrame([], "k1 bigint, k2 bigint, start int, size int, item bigint, similarity double")
    found = []
    for k in sorted(sizes):
        grams = _grams(items.where(F.col("k") == k).select(F.col("no").alias("k1"), F.lit(0).alias("k2"), F.col("iw").alias("w")), k)
        grams = shared_table(grams.select("h", F.col("k1").alias("no"), F.col("n").alias("m")), "item-shingles")
        hits = _grams(named, k).join(broadcast_if_small(grams.distinct(), BROADCAST_BYTES), "h")
        hits = hits.groupBy("k1", "k2", "no").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sort_array(F.collect_set(F.struct("pos", "h"))).alias("hits"))  # one text
        both = F.least("n", "m") + F.col("m") - 2 * (k - 1)  # shingles of window and item
        hits = hits.withColumn("least", F.ceil(both * F.lit(SIMILARITY / (1 + SIMILARITY)) - F.lit(1e-9)).cast("int")).where(F.size("hits") >= F.col("least"))
        hashes = shared_table(grams.groupBy("no").agg(F.collect_list("h").alias("ih")), "item-hashes")  # one item
        near = hits.join(broadcast_if_small(hashes, BROADCAST_BYTES), "no")
        best = _best_window(F.col("hits"), F.col("n"), F.col("m"), k, F.col("least"), F.col("ih"))
        near = near.select("k1", "k2", "no", "least", best.alias("best")).where(F.col("best.shared") >= F.col("least"))
        found.append(near.select("k1", "k2", F.struct("no", (-F.col("best.back")).alias("start")).alias("x")))
    windows = reduce(DataFrame.unionByName, found).groupBy("k1", "k2").agg(F.collect_list("x").alias("windows"))  # at most one for each item
    windows = broadcast_if_small(shared_table(windows, "item-windows"), BROADCAST_BYTES)
    # one copy of each text with a window goes on
    texts = raw.join(windows, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("t").alias("t"), F.first("windows").alias("windows"))
    cut = texts.select("k1", "k2", words(F.col("t")).alias("w"), "windows").select("k1", "k2", "w", F.explode("windows").alias("x")) \
               .select("k1", "k2", "w", "x.no", "x.start").join(broadcast_if_small(items, BROADCAST_BYTES), "no") \
               .withColumn("ww", F.slice("w", F.col("start") + 1, F.col("m")))
    near = cut.select("k1", "k2", "start", F.size("ww").alias("size"), "item", _similarity(F.col("ww"), F.col("iw"), F.col("k")).alias("similarity"))
    return near.where(F.col("similarity") >= SIMILARITY)


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``contaminated``, ``n_items``, ``best_item`` (smallest id of the
    highest similarity) and ``similarity`` (0 if clean) of each text."""
    found = matches(docs, benchmark, text_col).groupBy("k1", "k2").agg(
        F.size(F.collect_set("item")).cast("long").alias("n_items"), F.min(F.struct((-F.col("similarity")).alias("s"), F.col("item"))).alias("best"))
    found = broadcast_if_small(shared_table(found, "contaminated"), BROADCAST_BYTES)
    k1, k2 = text_key(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col), k1.alias("k1"), k2.alias("k2")).join(found, ["k1", "k2"], "left")
    return rows.select(id_col, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                       F.col("best.item").alias("best_item"), F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no benchmark item contaminates."""
    found = broadcast_if_small(shared_table(matches(docs, benchmark, text_col).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(), "contaminated"), BROADCAST_BYTES)
    k1, k2 = text_key(F.col(text_col).cast("string"))
    return docs.join(found, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")
