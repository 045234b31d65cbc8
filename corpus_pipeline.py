"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that go on,
with the columns of ``docs``; the last one returns token ids. ``run`` writes each
stage's result to the shared folder and reads it back for the next stage.

Every stage works on whatever its predecessor kept. NULL and empty texts, repeated
rows, empty tables and further columns are treated as the stages' operators
say: such a text is not toxic, is near-duplicate of other wordless texts, has
nothing to cut, is not contaminated, and has no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import byte_bpe, decontaminate, simhash, suffix_dedup, toxicity
from pagelake.llm.common import read, shared_table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject (score below 0.5)."""
    model = toxicity.learn(docs.where(~toxicity.held_out("doc_id")), read(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, below=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 3 bits): its smallest doc_id."""
    return simhash.keep_one(docs, shingle_words=3, distance=3)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur twice; ``n_chars`` follows the text."""
    cut = suffix_dedup.remove_text(docs, suffix_dedup.repeated_spans(docs, length=200))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item (5-word shingles, similarity 0.8)."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, the ids and their digests; decoded bytes are checked by digest."""
    return byte_bpe.digests(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", encode),
]

#: Automata, fingerprints and merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
