"""Language detection and target-language filter.

A multinomial naive Bayes over word tokens, trained on a labelled text
table with Spark jobs: counts per (lang, word) by ``groupBy``, log
probabilities as integer milli-nats (exact, engine-independent sums),
scoring by a join of the documents' words with the model and a
``groupBy(doc, lang)`` sum. The model grows with the vocabulary; a bounded part of
it, its common words, is broadcast, and only the other words are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, tokens

UNKNOWN = "unknown"
#: Most words of a model that are broadcast, whatever its size.
COMMON_WORDS = 500_000


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """Model rows ``(lang, word, logp, unseen, prior)`` in integer milli-nats,
    add-one smoothing over the vocabulary."""
    docs = labelled.where(F.col(label).isNotNull())
    t = F.lower(strip(F.coalesce(F.col(text), F.lit(""))))
    counts = (docs.select(label, F.explode_outer(tokens(t)).alias("word")).where(F.col("word").isNotNull())
              .groupBy(label, "word").agg(F.count("*").alias("c")))
    # Counts feed the vocabulary size, the per-language totals and the model:
    # checkpoint them once (shared folder) instead of tokenising three times.
    from ..session import materialise
    counts = materialise(counts, "lang_counts")
    vocab = counts.select(F.countDistinct("word")).scalar()
    ndocs = docs.select(F.count("*")).scalar()
    totals = counts.groupBy(label).agg(F.sum("c").alias("N"))
    priors = docs.groupBy(label).agg(
        F.round(F.ln(F.count("*") / ndocs) * 1000).cast("bigint").alias("prior"))
    # One row per language: small, bounded by the label set.
    lt = totals.join(priors, label).withColumn("V", vocab)
    m = counts.join(F.broadcast(lt), label)
    return m.select(
        F.col(label).alias("lang"), "word",
        F.round(F.ln((F.col("c") + 1) / (F.col("N") + F.col("V"))) * 1000).cast("bigint").alias("logp"),
        F.round(F.ln(F.lit(1.0) / (F.col("N") + F.col("V"))) * 1000).cast("bigint").alias("unseen"),
        "prior")


def detect(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text",
           prefix: int | None = None) -> DataFrame:
    """``(key, lang, confidence, score)``; confidence is the softmax
    posterior of the best language among languages that share a word with
    the document; ties go to the smaller language code. Documents without a
    known word are ``unknown`` with confidence 0.

    Common words -- each with at least one in ``COMMON_WORDS`` of the model's
    occurrences, so there are at most that many -- are broadcast with their model rows, and
    their sums leave a task as one row per document and language. Only the
    other words' occurrences are shuffled to the model, and none of these words
    is frequent enough to be skewed. One more shuffle adds up the (doc, lang) sums; the
    per-language array (bounded by the label set) yields the arg-max and the
    softmax in the document's row.
    """
    t = F.lower(strip(F.coalesce(F.col(text), F.lit(""))))
    if prefix:
        t = F.left(t, F.lit(prefix))
    toks = docs.select(key, tokens(t).alias("_toks"))
    words = (toks.select(key, F.size("_toks").alias("ntok"), F.explode_outer("_toks").alias("word"))
             .where(F.col("word").isNotNull()))
    # The model and the list of common words are tables in the shared folder: read several times, computed once.
    from ..session import materialise
    m = materialise(model, "lang_model")
    seen = F.sum(F.exp((F.col("logp") - F.col("unseen")) / 1000.0))   # occurrences, smoothed
    common = materialise(m.groupBy("word").agg(seen.alias("seen"))
                         .where(F.col("seen") * COMMON_WORDS >= m.select(seen).scalar()).select("word"), "lang_common")
    by_common = words.join(F.broadcast(m.join(F.broadcast(common), "word")), "word")
    by_rest = (words.join(F.broadcast(common), "word", "left_anti")
               .join(m.join(F.broadcast(common), "word", "left_anti"), "word"))
    s = (by_common.unionByName(by_rest).groupBy(key, "lang")
         .agg((F.sum(F.col("logp") - F.col("unseen"))
               # constant within the group (per document / per language): max, not first
               + F.max("ntok") * F.max("unseen") + F.max("prior")).alias("score")))
    per = s.groupBy(key).agg(F.collect_list(F.struct((-F.col("score")).alias("neg"), "lang", "score")).alias("_c"))
    best = F.array_min("_c")
    z = F.aggregate("_c", F.lit(0.0), lambda acc, x: acc + F.exp((x["score"] - best["score"]) / 1000.0))
    found = per.select(key, best["lang"].alias("lang"), F.bround(1.0 / z, 4).alias("confidence"), best["score"].alias("score"))
    return docs.select(key).join(found, key, "left").select(
        key, F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "score")


def label_with_threshold(lang: Column, confidence: Column, min_confidence: float = 0.5,
                         default: str = "unknown") -> Column:
    """Simple-mode rule: the language, or ``default`` at confidence <= 0.5."""
    return F.when(confidence > min_confidence, lang).otherwise(F.lit(default))


def target_filter(df: DataFrame, lang_col: str, target: str = "auto") -> DataFrame:
    """Keep rows in the target language; 'auto' keeps everything."""
    return df if target == "auto" else df.where(F.col(lang_col) == target)
