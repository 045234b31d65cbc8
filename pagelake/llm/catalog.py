"""Queries of this subpackage: each applies one operator, with production
parameters, to the whole of its table."""

from __future__ import annotations

from . import (byte_bpe, chat_format, decontaminate, language_cnn, licenses, merkle, pivot_topk, prefix_trie, simhash, suffix_dedup, token_files,
               toxicity, wrapper)
from .common import read


def _conversations(operator):
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "conversations"))


def _documents(operator):
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pivot_topk": lambda spark, sf_dir: pivot_topk.nearest(read(spark, sf_dir, "embeddings")),
    "op2_token_files": _documents(token_files.digests),
    "op3_toxicity": lambda spark, sf_dir: toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
    "op4_byte_bpe": _documents(byte_bpe.digests),
    "op5_wrapper": lambda spark, sf_dir: wrapper.main_texts(read(spark, sf_dir, "pages")),
    "op6_language_cnn": _documents(language_cnn.predictions),
    "op7_decontaminate": lambda spark, sf_dir: decontaminate.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op8_licenses": _documents(licenses.scan),
    "op9_suffix_dedup": _documents(suffix_dedup.digests),
    "op10_simhash": _documents(simhash.classes),
    "op11_merkle": _documents(merkle.digests),
    "op12_chat_format": _conversations(chat_format.digests),
    "op13_prefix_trie": _conversations(prefix_trie.nodes),
}

ORACLES: dict[str, str] = {"op1_pivot_topk": pivot_topk.ORACLE, "op8_licenses": licenses.ORACLE, "op12_chat_format": chat_format.ORACLE}
