import numpy as np
from helpers import documents, edge, rows

from pagelake.llm import language_cnn, toxicity
from pagelake.llm.common import read

SF = "/root/testdata/sf0.01"


def test_fold_lookalikes_and_digits():
    same = [toxicity.fold(t) for t in ("IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "id​iot", "|diot")]
    assert set(same) == {"idiot"}
    assert toxicity.fold("l0ser") == toxicity.fold("LOSER") == toxicity.fold("1o$er")


def test_entries_need_word_starts_and_exceptions_spare():
    m = toxicity.Model(prefixes={"iow": 2.0}, words={"trash": 3.0})
    a = m.automaton()
    assert [h[:2] for h in m.hits(toxicity.fold("Trash, trashy; xtrash loweia xlow"), a)] == [(0, 5), (22, 25)]
    assert m.hits(toxicity.fold("a trash can and the TRASH BIN"), a) == []
    assert len(m.hits(toxicity.fold("a trash can is trash"), a)) == 1


def test_score_is_normalised_by_length():
    m = toxicity.default_model()
    few, many = m.scores(m.features(["idiot here", "idiot " + "word " * 2000], m.automaton()))
    assert few > many > m.scores(m.features([""], m.automaton()))[0]


def test_learned_entries_explain_toxic_texts():
    r = np.random.default_rng(1)
    words = [f"w{i}x" for i in range(300)]
    clean = [" ".join(r.choice(words, 40)) for _ in range(300)]
    bad = ["grumbold", "snarvi"]
    toxic = [f"{c} {bad[i % 2]}{'xyz'[i % 3] if i % 2 else ''}" for i, c in enumerate(clean[:60])]
    prefixes, found = toxicity._entries(toxic, clean[60:])
    assert toxicity.fold("grumbold") in found and any(p.startswith("snarv") for p in prefixes)
    model = toxicity.Model(prefixes, found)
    x = model.features(toxic + clean[60:], model.automaton())
    model.curve = toxicity._curve(x, np.array([1.0] * 60 + [0.0] * 240))
    s = model.scores(x)
    assert (s[:60] > 0.5).all() and (s[60:] < 0.5).all()


def test_toxicity_edge_rows(spark):
    docs = edge(spark, ["you idiot moron scum", "a kind text"])
    model = toxicity.default_model()
    got = rows(toxicity.score(docs, model), "doc_id", "score")
    assert len(got) == docs.count() and all(0 <= s <= 1 for _, s in got)
    by = dict(g for g in got if g[0] is not None)
    assert by[0] > 0.5 > by[1] and by[2] == by[3]
    kept = toxicity.keep(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (0, 1)], "doc_id bigint, toxic int")
    assert toxicity.scores(docs, labels).count() == docs.count()
    assert toxicity.scores(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_toxicity_held_out_accuracy(spark):
    """Trained on sf0.01's few labels; documents of the other folds are held out."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    found = toxicity.scores(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    assert ((found["score"] >= 0.5).astype(int) == found["toxic"]).mean() >= 0.93
    assert (found["predicted"] == (found["score"] >= 0.5)).all()


def test_windows_cover_whole_texts():
    data = bytes(range(1, 251)) * 5
    w = language_cnn.windows(data)
    assert w.tobytes().rstrip(b"\0") == data and w.shape == (5, language_cnn.WINDOW)
    assert language_cnn.windows(b"").shape == (1, language_cnn.WINDOW)


def test_tables_equal_the_convolution():
    r = np.random.default_rng(2)
    w = r.integers(1, 256, (6, language_cnn.WINDOW)).astype(np.uint8)
    net = language_cnn.train(w, np.array([0, 1, 2, 0, 1, 2]), ["a", "b", "c"], epochs=1)
    got = net.log_probabilities(w, net.tables())
    emb, pooled = net.embedding[w], []
    for k, f, b in zip(language_cnn.WIDTHS, net.filters, net.biases, strict=True):
        ans = np.stack([emb[:, i:i + k].reshape(6, -1) @ f for i in range(language_cnn.WINDOW - k + 1)], axis=1)
        pooled.append(np.maximum(ans.max(axis=1) + b, 0))
    z = np.hstack(pooled) @ net.out + net.out_bias
    want = z - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - z.max(axis=1, keepdims=True)
    assert np.abs(got - want).max() < 1e-3


def test_language_accuracy_and_edge_rows(spark):
    docs = read(spark, SF, "documents")
    net = language_cnn.learn(docs.where(~language_cnn.held_out("doc_id")))
    found = language_cnn.predict(docs, net).join(docs.select("doc_id", "lang", language_cnn.held_out("doc_id").alias("out")), "doc_id").where("out AND lang IS NOT NULL").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() >= 0.97
    odd = edge(spark, ["12 34 -- !", "the heron and the thing is that", "\U0001f600"])
    got = rows(language_cnn.predict(odd, net), "doc_id", "lang_pred", "score")
    assert len(got) == odd.count()
    by = {g[0]: g[1:] for g in got if g[0] is not None}
    assert by[0] == by[2] == by[3] == by[4] == ("und", 0.0) and by[1][0] == "en" and 0 < by[1][1] <= 1
    assert language_cnn.predict(odd.limit(0), net).count() == 0
    nothing = documents(spark, ["some text"]).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert language_cnn.learn(nothing) is None
    assert rows(language_cnn.predict(nothing, None), "lang_pred") == [("und",)]
