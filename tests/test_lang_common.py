"""Language detection: common words are broadcast, the others are joined."""

from __future__ import annotations

import math
import random
import re

import pytest

from pagelake.operators import lang as LG


def slow(docs, model):
    langs = {lang: (unseen, prior) for lang, _, _, unseen, prior in model}
    logp = {(lang, word): p for lang, word, p, _, _ in model}
    out = {}
    for key, text in docs:
        words = re.findall(r"\w+", (text or "").strip().lower())
        score = {lang: sum(logp.get((lang, w), unseen) for w in words) + prior for lang, (unseen, prior) in langs.items()
                 if any((lang, w) in logp for w in words)}
        best = min(((-s, lang) for lang, s in score.items()), default=(None, "unknown"))
        posterior = 1 / sum(math.exp((s + best[0]) / 1000) for s in score.values()) if score else 0.0
        out[key] = (best[1], round(posterior, 3))
    return out


@pytest.mark.parametrize("common", [1, 8, 500_000])
def test_common_and_other_words_give_one_score(spark, monkeypatch, common):
    monkeypatch.setattr(LG, "COMMON_WORDS", common)
    rng = random.Random(7)
    vocabulary = {lang: [f"w{i}" for i in range(start, start + 40)] for lang, start in (("a", 0), ("b", 20), ("c", 35))}
    text = lambda lang: " ".join(vocabulary[lang][min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randint(1, 40)))
    train = [(text(lang), lang) for lang in "abc" for _ in range(20)]
    docs = [(i, text(rng.choice("abc"))) for i in range(60)] + [(90, None), (91, ""), (92, "none of these"), (93, "W1 " * 50 + "w1")]
    model = LG.train(spark.createDataFrame(train, "text string, lang string"))
    rows = [(r.lang, r.word, r.logp, r.unseen, r.prior) for r in model.collect()]
    got = LG.detect(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    expected = slow(docs, rows)
    assert len(got) == len(docs)
    for r in got:
        assert r.lang == expected[r.doc_id][0] and abs(r.confidence - expected[r.doc_id][1]) < 0.002
