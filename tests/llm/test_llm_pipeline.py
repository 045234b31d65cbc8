import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import test_llm_duplicates as brute
from helpers import edge, rows

from pagelake.llm import byte_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(31)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in ("orn", "eni", "tis", "wha", "eas", "oul", "ing")]
    line = lambda n: " ".join(r.choice(vocabulary, n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    passage = line(70)
    texts = [line(60) for _ in range(8)] + [f"{line(40)} {passage} {line(30)}" for _ in range(3)] + [f"{line(50)} {item} {line(20)}", f"{line(40)} idiot {line(3)} moron scum"]
    return edge(spark, [*texts, texts[0], texts[1] + " tail"])


def test_stages_keep_columns_and_decide_as_brute_force(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_bpe"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rows(now, "doc_id", "text")
        now = stage(spark, now, SF).cache()
        if name == "byte_bpe":
            bpe = byte_bpe.Bpe(byte_bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)
            assert sorted(((i, bytes(x)) for i, x in rows(now, "doc_id", "ids")), key=str) == sorted(((i, bpe.encode_batch([t or ""])[0]) for i, t in before), key=str)
            continue
        assert now.columns == docs.columns
        after = rows(now, "doc_id", "text")
        if name == "toxicity":
            assert {i for i, _ in before} - {i for i, _ in after} == {12} and len(before) == len(after) + 1
        elif name == "simhash_near_dedup":
            ids = brute.classes([brute.fingerprint(t) for _, t in before], [i for i, _ in before])
            assert sorted(i for i, _ in after) == sorted(set(ids))
        elif name == "suffix_array_dedup":
            data, marks = brute.covered([t for _, t in before])
            got = dict(after)
            for (i, t), d, m in zip(before, data, marks, strict=True):
                assert (got[i] or "").encode() == bytes(x for x, f in zip(d, m, strict=True) if not f)
            assert all(n == len(t) for t, n in rows(now.where("text is not null"), "text", "n_chars"))
        else:
            items = rows(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
            dirty = brute.contaminated([t for _, t in before], items)
            assert sorted(i for i, _ in after) == sorted(i for (i, _), d in zip(before, dirty, strict=True) if not d[0])
            assert 11 not in {i for i, _ in after}


def test_stages_take_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_pipeline_runs_and_is_registered(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
    out = found["pipeline"](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.5 * n < out.count() <= n and {"doc_id", "n_tokens"} <= set(out.columns)
