"""Language identification with a byte convolutional network (operator 6).

A text's lower-cased UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Each
byte is embedded; filters of several widths slide over a window, the largest
answer of each filter enters a softmax layer. The windows' log-probabilities,
weighted by their bytes, are averaged over the whole text.

``learn`` trains the network with numpy on windows of at most
``TEXTS_PER_LANGUAGE`` distinct labelled texts per language, spread over the
whole of each text; that bound makes the cost of training constant.
``predict`` reads every window of every text. There, a filter's answer at a
place is a sum of table entries: one table of all byte pairs per two bytes of
width, so no matrix is multiplied.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0;
rows are independent, so repeated rows and NULL ids keep their row; without
any labelled text all are ``und``; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, map_arrow, text_key, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
TEXTS_PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 4
EPOCHS = 8
#: Windows that are scored together.
BLOCK = 512


def windows(data: bytes) -> np.ndarray:
    """All windows of ``data``; the last one is filled with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: list[np.ndarray]  # one (width * EMBEDDING, FILTERS) per width
    biases: list[np.ndarray]
    out: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, the tables of its byte pairs and, if odd, of its last byte."""
        found = []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            at = [self.embedding @ f[k * EMBEDDING:(k + 1) * EMBEDDING] for k in range(width)]
            parts = [(at[k][:, None, :] + at[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, width - 1, 2)]
            found.append([p.astype(np.float32) for p in parts + ([at[-1]] if width % 2 else [])])
        return found

    def log_probabilities(self, w: np.ndarray, tables) -> np.ndarray:
        """Of each window (rows of bytes)."""
        pooled = []
        pairs = w[:, :-1].astype(np.int32) * 256 + w[:, 1:]
        for width, parts, bias in zip(WIDTHS, tables, self.biases, strict=True):
            n, answer = WINDOW - width + 1, None
            for k, table in enumerate(parts):
                index = pairs[:, 2 * k:2 * k + n] if len(table) > 256 else w[:, 2 * k:2 * k + n]
                got = np.take(table, index, axis=0)
                answer = got if answer is None else np.add(answer, got, out=answer)
            pooled.append(np.maximum(answer.max(axis=1) + bias, 0))
        z = np.hstack(pooled) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(w: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> Network:
    """Adam on cross entropy. Some windows are cut short at random, so that
    short texts are known too."""
    r = np.random.default_rng(7)
    c = len(languages)
    p = {"e": r.normal(0, 0.5, (256, EMBEDDING)), "o": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, c)), "ob": np.zeros(c)}
    p["e"][0] = 0
    for k in WIDTHS:
        p[f"f{k}"] = r.normal(0, 1 / np.sqrt(k * EMBEDDING), (k * EMBEDDING, FILTERS))
        p[f"b{k}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(w))
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(w), batch):
            pick = order[at:at + batch]
            x, n = w[pick].copy(), len(pick)
            for i in np.flatnonzero(r.random(n) < 0.4):
                x[i, r.integers(6, WINDOW):] = 0
            emb, pooled, kept = p["e"][x], [], []
            for k in WIDTHS:
                col = np.lib.stride_tricks.sliding_window_view(emb, k, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - k + 1, k * EMBEDDING)
                answer = col @ p[f"f{k}"] + p[f"b{k}"]
                best = answer.argmax(axis=1)
                top = np.take_along_axis(answer, best[:, None, :], axis=1)[:, 0]
                pooled.append(np.maximum(top, 0))
                kept.append((col, best, top > 0))
            h = np.hstack(pooled)
            z = h @ p["o"] + p["ob"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y[pick]] -= 1
            z /= n
            g = {"o": h.T @ z, "ob": z.sum(axis=0), "e": np.zeros_like(p["e"])}
            dh = z @ p["o"].T
            for j, k in enumerate(WIDTHS):
                col, best, on = kept[j]
                d = dh[:, j * FILTERS:(j + 1) * FILTERS] * on
                chosen = col[np.arange(n)[:, None], best]  # (n, FILTERS, k * EMBEDDING)
                g[f"f{k}"] = np.einsum("nf,nfd->df", d, chosen)
                g[f"b{k}"] = d.sum(axis=0)
                back = (d[:, :, None] * p[f"f{k}"].T[None]).reshape(n, FILTERS, k, EMBEDDING)
                places = best[:, :, None] + np.arange(k)
                np.add.at(g["e"], x[np.arange(n)[:, None, None], places], back)
            g["e"][0] = 0
            step += 1
            for key, grad in g.items():
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.999 * v[key] + 0.001 * grad * grad
                p[key] -= (lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, p["e"], [p[f"f{k}"] for k in WIDTHS], [p[f"b{k}"] for k in WIDTHS], p["o"], p["ob"])


def _prepared(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace") if text else b""


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """A network for the labels of ``docs``, or None if no text is labelled."""
    text = F.col(text_col).cast("string")
    k1, k2 = text_key(text)
    named = docs.where(F.col(label_col).isNotNull() & text.rlike(r"\p{L}"))
    narrow = named.select(F.col(label_col).alias("_lang"), k1.alias("_k1"), k2.alias("_k2")).groupBy("_k1", "_k2").agg(F.min("_lang").alias("_lang"))
    first = Window.partitionBy("_lang").orderBy("_k1", "_k2")
    rows = narrow.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= TEXTS_PER_LANGUAGE).select("_k1", "_k2", "_lang").collect()
    if not rows:
        return None
    spark = docs.sparkSession
    picked = spark.createDataFrame(rows, "_k1 bigint, _k2 bigint, _lang string")
    found = named.select(text.alias("_text"), k1.alias("_k1"), k2.alias("_k2")).join(F.broadcast(picked), ["_k1", "_k2"]) \
                 .select("_k1", "_k2", "_lang", "_text")

    def run(batches):
        for b in batches:
            for k1, k2, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = windows(_prepared(t))
                w = w[np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_TEXT).astype(int))]
                yield pa.RecordBatch.from_arrays([pa.array([k1]), pa.array([k2]), pa.array([lang]), pa.array([w.tobytes()], pa.binary())], ["_k1", "_k2", "_lang", "_w"])

    got = map_arrow(found, run, "_k1 bigint, _k2 bigint, _lang string, _w binary").dropDuplicates(["_k1", "_k2"]).orderBy("_k1", "_k2").collect()
    languages = sorted({r["_lang"] for r in got})
    parts = [np.frombuffer(bytes(r["_w"]), np.uint8).reshape(-1, WINDOW) for r in got]
    y = np.repeat([languages.index(r["_lang"]) for r in got], [len(p) for p in parts])
    return train(np.vstack(parts), y, languages)


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of each text."""
    def run(batches):
        tables = network.tables() if network else None
        for b in batches:
            at = 0
            for part in chunks(zip(texts(b, 1), b.column(2).to_pylist(), strict=True), lambda r: WINDOW + len(r[0]), BLOCK * WINDOW):
                names, scores = ["und"] * len(part), [0.0] * len(part)
                data = [windows(_prepared(t)) if letters and network else None for t, letters in part]
                known = [i for i, d in enumerate(data) if d is not None]
                if known:
                    w = np.concatenate([data[i] for i in known])
                    logs = np.concatenate([network.log_probabilities(w[k:k + BLOCK], tables) for k in range(0, len(w), BLOCK)])
                    weight = np.count_nonzero(w, axis=1).astype(np.float64) + 1e-9
                    starts = np.cumsum([0] + [len(data[i]) for i in known[:-1]])
                    mean = np.add.reduceat(logs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                    e = np.exp(mean - mean.max(axis=1, keepdims=True))
                    e /= e.sum(axis=1, keepdims=True)
                    for i, row in zip(known, e, strict=True):
                        names[i], scores[i] = network.languages[int(row.argmax())], float(row.max())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 [id_col, "lang_pred", "score"])
                at += len(part)

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col), text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return map_arrow(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: str):
    """Documents whose labels are kept from learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predictions(docs: DataFrame) -> DataFrame:
    found = predict(docs, learn(docs.where(~held_out("doc_id"))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
