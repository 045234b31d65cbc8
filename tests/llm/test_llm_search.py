import math

import numpy as np
from helpers import rows

from pagelake.llm import pivot_topk


def brute(data, queries, k, scale=1024):
    def clean(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]

    d = [(i, clean(v)) for i, v in data if i is not None and clean(v) is not None]
    out = []
    for qid, q in sorted({(i, tuple(clean(v))) for i, v in queries if i is not None and clean(v) is not None}):
        found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in d if i != qid)[:k]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as id", "'x' as q", "2 as norm", "3 as rank", "4 as score")


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 64)
    r = np.random.default_rng(4)
    x = np.round(r.normal(0, 0.3, (700, 12)), 2)
    x[300:360] = x[:60] + 0.01  # near copies
    x[400:420] = x[5]  # ties
    data = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    data += [(1000, None), (1001, [float("nan")] * 12), (1002, [float("inf")] + [0.0] * 11), (1003, []), (None, [0.5] * 12), (1004, [0.25] * 5)]
    v = frame(spark, data)
    got = rows(pivot_topk.top_k(v, v.where("vec_id % 7 = 0"), k=10), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == sorted(brute(data, [d for d in data if d[0] is not None and d[0] % 7 == 0], 10))


def test_top_k_few_rows_and_empty_tables(spark):
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    v = frame(spark, data)
    assert sorted(rows(pivot_topk.nearest(v), "query_id", "rank", "vec_id", "score")) == brute(data, data[:1], 10)
    assert pivot_topk.nearest(v.limit(0)).count() == 0
    assert pivot_topk.nearest(v.where("vec_id > 0")).count() == 0


def test_dot_is_exact_and_cut_to_a_long():
    x, q = np.array([[2.0**40, 3.0], [2.0**40, -2.0**40]]), np.array([2.0**20, 1.0])
    assert pivot_topk.dot(x, q).tolist() == [2**60 + 3, 2**60 - 2**40]
    assert pivot_topk.dot(np.array([[2.0**60, 2.0**60]]), np.array([2.0**30, 0.0])).tolist() == [2**63 - 1]


def test_bounds_save_products():
    """Clustered vectors: most candidates are never multiplied."""
    r = np.random.default_rng(6)
    centres = r.normal(0, 300, (20, 16))
    x = np.floor(np.repeat(centres, 200, axis=0) + r.normal(0, 5, (4000, 16)))
    pivots = pivot_topk.choose_pivots(x[::7])
    d, n = pivot_topk.distances(x, pivots), (x * x).sum(axis=1)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    block = [(0, x[0], d[0], n[0], None)]
    made = pivot_topk.search_step(x, np.arange(4000), d, n, block, best, 10)
    want = sorted((-int(a @ x[0]), i) for i, a in enumerate(x) if i)[:10]
    assert list(zip((-best[0][0]).tolist(), best[0][1].tolist(), strict=True)) == want
    assert made < 2000
