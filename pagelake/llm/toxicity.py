"""Toxicity by a weighted lexicon (operator 3).

Texts are folded first: lower case, look-alike letters and digit or symbol
substitutions to one letter of their class, zero-width characters dropped.
One Aho-Corasick automaton finds all lexicon entries and exception phrases in
the folded text. An entry counts where a word starts with it (or is it, for
whole-word entries) unless an exception phrase covers the place. The weighted
hits, as a sum and per length, give a score by a logistic curve.

``learn`` takes entries, weights and curve from labelled texts. It uses a
sample of fixed bounds (``TOXIC_SAMPLE``, ``CLEAN_SAMPLE`` distinct texts of at
most ``SAMPLE_CHARS`` characters, taken by hash of the text), so the model's
size and the work of fitting don't grow with the corpus; scoring reads every
whole text.

Defined cases: a NULL or empty text has no hits, and gets the curve's score
for that; rows are independent, so repeated rows and NULL ids each keep their
row; without toxic labels the built-in lexicon and curve hold; labels that
are NULL or of unknown documents are not used; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, text_key, texts

TOXIC_SAMPLE = 1500
CLEAN_SAMPLE = 3000
SAMPLE_CHARS = 12_000
#: Toxic texts that an entry must explain beyond the entries chosen before it.
MIN_GAIN = 3
PREFIXES = range(3, 9)
#: A clean sample text with an entry weighs as much as so many toxic ones.
CLEAN_COST = 5

# Letters that look like Latin ones, and common substitutions.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "l": "i", "|": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
ZERO_WIDTH = "​‌‍⁠﻿­"

_FOLD = str.maketrans({**LOOKALIKES, **SUBSTITUTIONS, **dict.fromkeys(ZERO_WIDTH),
                       **{chr(0xFF21 + i): chr(97 + i) for i in range(26)}, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
for _fullwidth in [c for c in _FOLD if _FOLD[c] == "l"]:
    _FOLD[_fullwidth] = "i"
_WORD = re.compile(r"[^\W_]+")

#: Entries from the start: with these weights where there are no toxic labels, else
#: with learned ones, unless clean texts have them.
DEFAULT_LEXICON = {"idiot": 2.0, "moron": 2.0, "scum": 2.0, "stupid": 1.5, "loser": 1.5, "worthless": 1.5, "pathetic": 1.5, "disgusting": 1.0}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pathetic fallacy")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


@dataclass
class Model:
    """``prefixes`` and ``words``: weights of folded entries that a word starts
    with, or equals. ``curve``: intercept and the factors of log(1 + sum) and
    log(1 + sum per 100 words)."""

    prefixes: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def automaton(self):
        import ahocorasick

        entries: dict[str, list] = {}
        for kind, found in (("prefix", self.prefixes), ("word", self.words), ("except", dict.fromkeys(map(fold, self.exceptions), 0.0))):
            for entry, weight in found.items():
                entries.setdefault(entry, []).append((kind, weight))
        if not entries:
            return None
        a = ahocorasick.Automaton()
        for entry, uses in entries.items():
            a.add_word(entry, (len(entry), tuple(uses)))
        a.make_automaton()
        return a

    def hits(self, folded: str, automaton) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries that count."""
        found, spared = [], []
        if automaton is None:
            return found
        n = len(folded)
        for last, (size, uses) in automaton.iter(folded):
            start, end = last - size + 1, last + 1
            if start and folded[start - 1].isalnum():
                continue
            ends = end == n or not folded[end].isalnum()
            for kind, weight in uses:
                if kind == "prefix" or kind == "word" and ends:
                    found.append((start, end, weight))
                elif kind == "except" and ends:
                    spared.append((start, end))
        if spared and found:
            found = [h for h in found if not any(s <= h[0] and h[1] <= e for s, e in spared)]
        return found

    def features(self, batch: list[str], automaton) -> np.ndarray:
        out = np.zeros((len(batch), 2))
        for i, text in enumerate(batch):
            if text:
                folded = fold(text)
                hits = self.hits(folded, automaton)
                if hits:
                    total = sum(h[2] for h in hits)
                    out[i] = total, 100 * total / (len(folded.split()) + 20)
        return np.log1p(out)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def default_model() -> Model:
    return Model(words={fold(w): x for w, x in DEFAULT_LEXICON.items()})


def _entries(toxic: list[str], clean: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Entries that explain the toxic texts and spare the clean ones: greedy
    cover, in which each text asks for two entries."""
    def marks(text: str) -> set[str]:
        words = set(_WORD.findall(fold(text)))
        return {w[:n] for w in words for n in PREFIXES if len(w) >= n} | {f"{w} " for w in words if len(w) >= 3}

    where: dict[str, list[int]] = {}
    for i, text in enumerate(toxic):
        for m in marks(text):
            where.setdefault(m, []).append(i)
    where = {m: at for m, at in where.items() if len(at) >= MIN_GAIN}
    spoiled = dict.fromkeys(where, 0)
    defaults = {f"{fold(w)} " for w in DEFAULT_LEXICON}
    for text in clean:
        found = marks(text)
        defaults -= found
        for m in found & where.keys():
            spoiled[m] += 1
    best = [m for m in where if len(where[m]) > CLEAN_COST * spoiled[m] + MIN_GAIN - 1]
    # of entries that explain the same texts, the longest spares the most words
    best.sort(key=lambda m: (CLEAN_COST * spoiled[m] - len(where[m]), -len(m), m))
    prefixes, words = {}, {}
    asks = np.full(len(toxic), 2)
    at = {m: np.array(where[m]) for m in best}
    for once in (True, False):
        while best:
            open_ = asks > (1 if once else 0)
            top, top_gain = None, 0.0
            for m in best:  # sorted by the most that each can gain
                if len(where[m]) - CLEAN_COST * spoiled[m] <= top_gain:
                    break
                g = int(open_[at[m]].sum()) - CLEAN_COST * spoiled[m]
                if g > top_gain:
                    top, top_gain = m, g
            if top is None or top_gain < (MIN_GAIN if once else 4 * MIN_GAIN):
                break
            entry = top.rstrip(" ")
            weight = float(np.log((len(where[top]) + 0.5) / len(toxic) * (len(clean) + 1) / (spoiled[top] + 0.5)))
            (words if top.endswith(" ") else prefixes)[entry] = max(weight, 0.1)
            asks[at[top]] -= 1
            # neither extensions of a chosen prefix nor prefixes of a chosen entry count again
            best = [m for m in best if not (m.startswith(entry) or entry.startswith(m.rstrip(" ")))]
    for entry in sorted(d.rstrip(" ") for d in defaults):
        if entry not in words and not any(entry.startswith(p) for p in prefixes):
            words[entry] = float(np.log((len(where.get(f"{entry} ", ())) + 1.5) / len(toxic) * (len(clean) + 1) / 0.5))
    return prefixes, words


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method; the factors
    are kept from falling below zero."""
    a, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(3)
    keep = [0, 1, 2]
    for _ in range(60):
        b = a[:, keep]
        p = 1 / (1 + np.exp(-np.clip(b @ w[keep], -30, 30)))
        h = (b * (p * (1 - p) + 1e-6)[:, None]).T @ b + 0.05 * np.eye(len(keep))
        step = np.linalg.solve(h, b.T @ (y - p) - 0.05 * w[keep])
        w[keep] += np.clip(step, -2, 2)
        if (w[1:] < 0).any():
            keep = [k for k in keep if k == 0 or w[k] >= 0]
            w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the texts that ``labels`` marks 0 or 1."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
                   .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_toxic"))
    text = F.col(text_col).cast("string")
    k1, k2 = text_key(text)
    sized = docs.where(text.isNotNull() & (F.length(text) <= SAMPLE_CHARS)) \
                .select(F.col(id_col).alias("_id"), k1.alias("_k1"), k2.alias("_k2"))
    distinct = sized.join(marked, "_id").groupBy("_k1", "_k2").agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic"))
    picked = None
    for label, most in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        part = distinct.where(F.col("_toxic") == label).orderBy("_k1", "_k2").limit(most).select("_id", "_toxic", "_k1", "_k2")
        picked = part if picked is None else picked.unionByName(part)
    rows = picked.collect()  # at most TOXIC_SAMPLE + CLEAN_SAMPLE ids
    if not any(r["_toxic"] for r in rows):
        return default_model()
    picked = docs.sparkSession.createDataFrame(rows, picked.schema)
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), k1.alias("_k1"), k2.alias("_k2")) \
                .join(F.broadcast(picked), ["_id", "_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]) \
                .select("_text", "_toxic", "_k1").orderBy("_k1").toPandas()
    toxic = found.loc[found["_toxic"] == 1, "_text"].tolist()
    clean = found.loc[found["_toxic"] == 0, "_text"].tolist()
    prefixes, words = _entries(toxic, clean)
    model = Model(prefixes, words)
    x = model.features(toxic + clean, model.automaton())
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    model.curve = _curve(x, y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of each text."""
    def run(batches):
        automaton = model.automaton()
        for b in batches:
            found = [model.features(part, automaton) for part in chunks(texts(b, 1), len, 1 << 20)]
            scores = model.scores(np.concatenate(found)) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_arrow(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, below: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``below``."""
    def run(batches):
        automaton = model.automaton()
        for b in batches:
            found = [model.features(part, automaton) for part in chunks(texts(b, b.num_columns - 1), len, 1 << 20)]
            if found:
                rows = pa.RecordBatch.from_arrays(list(b.columns[:-1]), schema=pa.schema(list(b.schema)[:-1]))
                yield rows.filter(pa.array(model.scores(np.concatenate(found)) < below))

    src = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(text_col).cast("string").alias("__text"))
    return map_arrow(src, run, docs.schema)


def held_out(doc_id: str):
    """Documents whose labels are kept from learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs.where(~held_out("doc_id")), labels)
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
