"""SimHash near-duplicates with a Gray-order hierarchical index (operator 10).

A text's fingerprint has 64 bits: a bit is set if over half of the XXH64 hashes
(seed 42) of its word shingles have it. Documents are linked where fingerprints
differ in at most ``distance`` bits.

Finding links: distinct fingerprints are dealt out by keys of equal bits. With
``distance`` + 1 blocks one block is the same in both, and of the rest's
``distance`` + 1 parts one is, too, so a pair within the distance shares one of
(distance + 1)^2 keys. Within a key the fingerprints are sorted by Gray rank,
which puts those that differ in few bits side by side; nodes of ``FANOUT``
neighbours keep the bits that all below share, nodes of nodes likewise. Two
nodes are compared by the differences in the bits fixed in both: more than
``distance`` prune all pairs below. Pairs of nodes that are in one component
already are passed over, so large groups of copies hand on a spanning tree,
not all their pairs.

Defined cases: NULL and empty texts have no words, and fingerprint 0, which is
linked like any other; fewer words than a shingle make one shingle; repeated
rows keep one row each; NULL ids have a row, but are no component's id (the
component's id is NULL if it has no other); other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, shared_table, text_key, texts
from .components import components

SEED = 42
FANOUT = 16
#: Shingles whose bits are counted together.
SLICE = 1 << 15
#: Node or member pairs that are compared together.
PAIRS = 1 << 20


def shingle_hashes(text: str, size: int) -> np.ndarray:
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at:at + SLICE].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``k1``, ``k2`` (128-bit identity of the text) and ``fp`` (the
    fingerprint as a long) of each text."""
    def run(batches):
        for b in batches:
            at = 0
            for part in chunks(texts(b, 3), len):
                found = np.array([fingerprint(shingle_hashes(t, shingle_words)) for t in part], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(part)) for k in range(3)), pa.array(found)], [id_col, "k1", "k2", "fp"])
                at += len(part)

    text = F.col(text_col).cast("string")
    k1, k2 = text_key(text)
    src = docs.select(F.col(id_col).alias("_id"), k1.alias("k1"), k2.alias("k2"), text.alias("_text"))
    return map_arrow(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, k1 bigint, k2 bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray sequence."""
    x = x.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class _Sets:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unite; returns the places of the pairs that did unite two sets."""
        kept, root = [], self.root
        for k in np.flatnonzero(root[a] != root[b]):
            x, y = int(a[k]), int(b[k])
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append(k)
        while (root[root] != root).any():
            root[:] = root[root]
        return np.array(kept, np.int64)


def group_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps`` (distinct), as two arrays."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    n = len(fps)
    levels = [(fps, np.full(n, ~np.uint64(0)))]  # value and mask of fixed bits
    while len(levels[-1][0]) > FANOUT:
        value, mask = levels[-1]
        at = np.arange(0, len(value), FANOUT)
        both, any_ = np.bitwise_and.reduceat(value & mask, at), np.bitwise_or.reduceat(value & mask, at)
        levels.append((both, np.bitwise_and.reduceat(mask, at) & ~(both ^ any_)))
    sets, out = _Sets(n), []

    def visit(level: int, a: np.ndarray, b: np.ndarray) -> None:
        value, mask = levels[level]
        for s in range(0, len(a), PAIRS):
            x, y = a[s:s + PAIRS], b[s:s + PAIRS]
            if level:  # pass over pairs of nodes whose members are all in one component
                at = np.arange(0, n, FANOUT**level)
                low, high = np.minimum.reduceat(sets.root, at), np.maximum.reduceat(sets.root, at)
                open_ = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
            else:
                open_ = sets.root[x] != sets.root[y]
            x, y = x[open_], y[open_]
            near = np.bitwise_count((value[x] ^ value[y]) & mask[x] & mask[y]) <= distance
            x, y = x[near], y[near]
            if not level:
                kept = sets.join(x, y)
                if len(kept):
                    out.append((fps[x[kept]], fps[y[kept]]))
                continue
            step = max(1, PAIRS // FANOUT**2)
            for t in range(0, len(x), step):
                i = (x[t:t + step, None] * FANOUT + np.arange(FANOUT))[:, :, None]
                j = (y[t:t + step, None] * FANOUT + np.arange(FANOUT))[:, None, :]
                i, j = (z.ravel() for z in np.broadcast_arrays(i, j))
                size = len(levels[level - 1][0])
                good = (j < size) & ((i < j) if level == 1 else (i <= j))
                visit(level - 1, i[good], j[good])

    top = len(levels) - 1
    k = len(levels[top][0])
    i, j = np.triu_indices(k, 0 if top else 1)
    # neighbours in Gray order first: they unite most of a group of copies
    order = np.argsort(j - i, kind="stable")
    visit(top, i[order], j[order])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _keys(fp, distance: int):
    """The keys of a fingerprint, packed with their number."""
    parts = distance + 1
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    found = []

    def bits(x, low: int, size: int):
        mask = (1 << size) - 1 if size < 63 else -1
        return F.shiftrightunsigned(x, low).bitwiseAND(F.lit(mask).cast("long"))

    for i in range(parts):
        low, high = edges[i], edges[i + 1]
        below = bits(fp, 0, low) if low else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned(fp, high), low) if high < 64 else F.lit(0).cast("long")
        rest, size = below.bitwiseOR(above), 64 - (high - low)
        cuts = [round(size * k / parts) for k in range(parts + 1)]
        for j in range(parts):
            found.append(F.struct(F.lit(i * parts + j).alias("n"), bits(fp, low, high - low).alias("a"), bits(rest, cuts[j], cuts[j + 1] - cuts[j]).alias("b")))
    return F.array(*found)


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """``u``, ``v``: links among the distinct longs ``fp``, enough to connect
    whatever is within ``distance`` bits."""
    def run(batches):
        key, held = None, []  # the last key may go on in the next batch

        def done(parts):
            f = np.concatenate(parts)
            return group_links(f, distance) if len(f) > 1 else (f[:0], f[:0])

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            n, a, b, fp = (c.to_numpy() for c in batch.columns)
            fp = fp.view(np.uint64)
            change = np.flatnonzero((n[1:] != n[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(fp)]])
            found = []
            if held and key != (n[0], a[0], b[0]):
                found.append(done(held))
                held = []
            key = (n[-1], a[-1], b[-1])
            for s, e in zip(starts[(sel := (ends - starts > 1) | (starts == 0) | (ends == len(fp)))], ends[sel], strict=True):
                if s == 0:
                    held.append(fp[s:e])
                    if e == len(fp):
                        continue
                    found.append(done(held))
                    held = []
                elif e == len(fp):
                    held = [fp[s:e]]
                else:
                    found.append(done([fp[s:e]]))
            found = [f for f in found if len(f[0])]
            if found:
                yield out(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        if held:
            a, b = done(held)
            if len(a):
                yield out(a, b)

    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), distance)).alias("key")).select("key.n", "key.a", "key.b", "fp")
    dealt = keyed.repartition("n", "a", "b").sortWithinPartitions("n", "a", "b")
    return map_arrow(dealt, run, "u bigint, v bigint")


def groups(found: DataFrame, distance: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``found`` (:func:`fingerprints`, materialised) with ``root``, a
    fingerprint that stands for the component, and ``component_id``, its smallest id."""
    fps = shared_table(found.groupBy("fp").agg(F.min(id_col).alias("label")), "fingerprints")
    stars = components(links(fps.select("fp"), distance))
    rooted = fps.join(stars, fps["fp"] == stars["u"], "left").select("fp", "label", F.coalesce("v", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("label").alias("component_id"))
    known = shared_table(rooted.select("fp", "root").join(ids, "root"), "components")
    return found.join(known, "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``k1``, ``k2``, ``fp``, ``root`` and ``component_id`` of each text."""
    return groups(shared_table(fingerprints(docs, shingle_words, id_col, text_col), "simhash"), distance, id_col)


def keep_one(docs: DataFrame, shingle_words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with
    the smallest id (NULL last), of equal ids one by the text's identity."""
    found = near_duplicates(docs, shingle_words, distance, id_col, text_col)
    first = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("k1"), F.col("k2"))
    kept = found.groupBy("root").agg(F.min(first).alias("s")).select(
        _id_key(F.col(f"s.{id_col}")).alias("__d0"), F.col("s.k1").alias("__d1"), F.col("s.k2").alias("__d2"))
    k1, k2 = text_key(F.col(text_col).cast("string"))
    keyed = docs.withColumns({"__d0": _id_key(F.col(id_col)), "__d1": k1, "__d2": k2})
    # join and de-duplication share their keys, so texts are shuffled once
    return keyed.join(kept, ["__d0", "__d1", "__d2"], "left_semi").dropDuplicates(["__d0", "__d1", "__d2"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def _id_key(id_):
    """An id as a string that is never NULL."""
    return F.when(id_.isNull(), F.lit("null")).otherwise(F.concat(F.lit("id "), id_.cast("string")))


def classes(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
