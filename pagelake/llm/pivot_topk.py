"""Exact top-k search by inner product with a pivot table (operator 1).

The pivot table holds each vector's distance to ``PIVOTS`` pivots. For a query q
and a vector x the triangle inequality gives, with every pivot p,
``|d(q,p) - d(x,p)| <= d(q,x)``; the largest of these lower bounds turns into an
upper bound of the inner product, ``(|q|^2 + |x|^2 - bound^2) / 2``. Each task
takes its vectors in the order of that bound and stops for a query as soon as
no bound reaches the query's k-th best score.

Queries come in blocks of fixed size, sent to all tasks with their pivot
distances and a first k-th best score (among the pivot sample). Every block is
one pass over the pivot table; tasks hand on k rows per query, and a rank
within the query merges them. Blocks are written to the shared folder one by
one, so a lost executor costs at most one block's tasks.

Defined cases: vectors that are NULL, or hold NULL or non-finite components,
take no part; shorter vectors count as padded with zeros (an empty one scores
0 with all); ties go to the smaller id; NULL ids take no part; a query's own id
is no candidate, whichever row has it; repeated rows are separate candidates
and equal query rows are answered once; scores beyond a long are cut to its
range; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import ensure_checkpoint_dir

from .common import map_arrow, shared_table

PIVOTS = 32
#: Rows by hash of the id from which pivots are chosen, each far from the others.
PIVOT_SAMPLE = 1024
#: Queries of one pass.
QUERY_BLOCK = 4096
#: Candidates of one step: bounds of a step are ordered together.
STEP = 4096
#: Products below 2**53 are exact in doubles.
_EXACT = float(2**53)


def quantised(df: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """Rows whose vector takes part, with ``q``: floor(scale * x) of its components."""
    v = F.col(vec_col).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(whole).withColumn("q", F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def matrix(column, width: int) -> np.ndarray:
    """A list column as rows of doubles, filled with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    if width and len(flat):
        out[np.arange(width) < sizes[:, None]] = flat
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each as far as possible from those before it."""
    if not len(sample):
        return sample
    picked = [int((sample * sample).sum(axis=1).argmax())]
    gap = distances(sample, sample[picked])[:, 0]
    while len(picked) < min(n, len(sample)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products, cut to the range of a long."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1])
    if most < _EXACT:
        return (x @ q).astype(np.int64)
    a, b = x.astype(object), q.astype(object)
    low, high = -2**63, 2**63 - 1
    return np.array([min(high, max(low, sum(int(s) * int(t) for s, t in zip(row, b, strict=True)))) for row in a], np.int64)


def merge(scores, ids, new_scores, new_ids, k: int):
    """The k best of both, ties to smaller ids."""
    scores, ids = np.concatenate([scores, new_scores]), np.concatenate([ids, new_ids])
    order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == -2**63 else -scores))[:k]
    return scores[order], ids[order]


def search_step(x, ids, table, norms, block, best, k: int) -> int:
    """Offer the vectors ``x`` to every query of the block; ``best`` holds (scores,
    ids) per query. Returns how many products were made."""
    made = 0
    for i, (qid, q, qd, qn, start) in enumerate(block):
        scores, found = best[i]
        floor = scores[-1] if len(scores) == k else start
        lower = np.abs(table - qd).max(axis=1)
        upper = 0.5 * (qn + norms - lower * lower)
        upper += 1e-9 * (qn + norms) + 1.0  # no rounding may prune
        keep = np.flatnonzero((upper >= floor) & (ids != qid)) if floor is not None else np.flatnonzero(ids != qid)
        if not len(keep):
            continue
        keep = keep[np.argsort(-upper[keep])]
        at, size = 0, max(4 * k, 64)
        while at < len(keep) and (floor is None or upper[keep[at]] >= floor):
            part = keep[at:at + size]
            made += len(part)
            s = dot(x[part], q)
            good = s >= floor if floor is not None else np.ones(len(s), bool)
            if good.any():
                scores, found = merge(scores, found, s[good], ids[part][good], k)
                if len(scores) == k:
                    floor = scores[-1] if floor is None else max(floor, scores[-1])
            at += size
            size *= 2
        best[i] = (scores, found)
    return made


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score``: the ``k`` rows of
    ``vectors`` with the highest integer inner product for each row of ``queries``."""
    spark = vectors.sparkSession

    def clean(df):
        return quantised(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL"), "v", scale).select("id", "q")

    source = clean(vectors)
    width = source.agg(F.max(F.size("q"))).first()[0] or 0
    sample = source.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()  # a fixed number of rows
    seeds = matrix(pa.array([r["q"] for r in sample], pa.list_(pa.float64())), width)
    seed_ids = np.array([r["id"] for r in sample], np.int64)
    pivots = choose_pivots(seeds)
    sent = spark.sparkContext.broadcast(pivots)

    def measure(batches):
        for b in batches:
            x = matrix(b.column(1), width)
            d = distances(x, sent.value) if len(sent.value) else np.zeros((len(x), 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * x).sum(axis=1)), pa.array(list(d), pa.list_(pa.float64()))], ["id", "q", "norm", "d"])

    table = shared_table(map_arrow(source, measure, "id bigint, q array<double>, norm double, d array<double>"), "pivots")
    asked = shared_table(clean(queries).distinct().withColumn("block", F.floor(F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id", "q")) / F.lit(QUERY_BLOCK // 64))), "queries")
    blocks = sorted(r["block"] for r in asked.select("block").distinct().collect())  # one number per block
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/topk-{uuid.uuid4().hex[:12]}"
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    schema = f"query_id bigint, `{id_col}` bigint, score bigint"
    for n in blocks:
        rows = asked.where(F.col("block") == n).select("id", "q").collect()  # at most QUERY_BLOCK queries
        q = matrix(pa.array([r["q"] for r in rows], pa.list_(pa.float64())), width)
        qd = distances(q, pivots) if len(pivots) else np.zeros((len(q), 0))
        block = []
        for r, x, d in zip(rows, q, qd, strict=True):
            others = dot(seeds, x)[seed_ids != r["id"]] if len(seeds) else np.empty(0, np.int64)
            start = int(np.partition(others, -k)[-k]) if len(others) >= k else None
            block.append((r["id"], x, d, float((x * x).sum()), start))
        shipped = spark.sparkContext.broadcast(block)

        def search(batches, shipped=shipped):
            block = shipped.value
            best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in block]
            for b in batches:
                for at in range(0, b.num_rows, STEP):
                    part = b.slice(at, STEP)
                    x = matrix(part.column(1), width)
                    d = matrix(part.column(3), len(pivots))
                    search_step(x, part.column(0).to_numpy(), d, part.column(2).to_numpy(), block, best, k)
            if block:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([e[0] for e in block], [len(s) for s, _ in best]).astype(np.int64)),
                                                  pa.array(np.concatenate([f for _, f in best])), pa.array(np.concatenate([s for s, _ in best]))],
                                                 ["query_id", id_col, "score"])

        found = map_arrow(table, search, schema).withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
        found.write.mode("append").parquet(path)
        shipped.unpersist()
    if not blocks:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score bigint")
    return spark.read.parquet(path).select("query_id", "rank", id_col, "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """The ten best of every vector whose vec_id is divisible by 100."""
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
