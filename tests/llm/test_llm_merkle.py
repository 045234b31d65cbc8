"""Operator 11 against a plain construction of the trees."""

import hashlib
import zlib

import pytest
from helpers import LONG, rows

from pagelake.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def ascii_lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 8 * 8:at // 8 * 8 + 8]
        out.append((at % 8, run[:at % 8] + run[at % 8 + 1:]))
        at //= 8
    return out


def brute(data):
    """data: (doc_id, source, lang, n_chars, text)"""
    langs = sorted({r[2] for r in data}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: sorted(((r, leaf(r)) for r in data if r[2] == k), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for k in langs}
    built = {k: levels([d for _, d in t]) for k, t in trees.items()}
    top = levels([built[k][-1][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        for at, (r, d) in enumerate(trees[k]):
            steps = path(built[k], at) + path(top, n)
            proof = sha("".join(x for _, sibs in steps for x in sibs))
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf((*r[:4], ascii_lower(r[4]))) if bad else d
            for i, sibs in steps:
                now = sha("".join([*sibs[:i], now, *sibs[i:]]))
            out.append((r[0], d, built[k][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def frame(spark, data):
    df = spark.createDataFrame(data, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    return df.selectExpr("*", "1 as id", "2 as rank", "'t' as tree", "'p' as path", "3 as idx", "4 as leaf", "5 as changed")


def sample():
    data = [(3 * i, f"s{i % 3}", ["de", "en", "ünï", None][min(i % 7, 3)], i, f"Text Number {i}, Ärger") for i in range(600)]
    data += [(5000 + i, None, "fr", None, None) for i in range(9)] + [(6000, "s", "one", 1, ""), (6001, "s", "", 1, LONG)]
    data += [(7000, "same", "en", 4, "Same")] * 70 + [(None, "x", "en", 1, "A"), (None, "x", "en", 1, "B"), (12, "tie", "de", 0, "x")]
    return data


def test_digests_equal_plain_trees(spark):
    got = sorted(rows(merkle.digests(frame(spark, sample())), *COLUMNS), key=str)
    want = brute(sample())
    assert got == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("data", [[], [(9, "s", "en", 1, "Ab")], [(9, "s", None, 1, "Ab"), (10, "s", "en", 1, "Cd")]])
def test_few_rows(spark, data):
    assert sorted(rows(merkle.digests(frame(spark, data)), *COLUMNS), key=str) == brute(data)


def test_one_tree_of_each_size_around_the_fan(spark):
    for n in (8, 9, 65):
        data = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
        assert sorted(rows(merkle.digests(frame(spark, data)), *COLUMNS), key=str) == brute(data)


def test_requests_of_some_leaves(spark):
    """Proofs of chosen leaves verify; a request of no leaf has none; equal nodes are stored once."""
    from pyspark.sql import functions as F

    data = [(i, "s", "en", 1, f"T{i}") for i in range(100)] + [(1000, "s", "de", 1, "same")] * 128
    m = merkle.build(frame(spark, data), ["source", "lang", "text"], by="lang", order="doc_id")
    asked = m.leaves.where("tree = '=en' and rank in (0, 63, 64, 99)").select("tree", "rank", "leaf")
    asked = asked.unionByName(asked.limit(1)).unionByName(asked.limit(1).withColumn("rank", F.lit(10**6).cast("bigint")))
    got = merkle.prove(m, asked).select("rank", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("r")).collect()
    assert sorted(x["rank"] for x in got)[-1] == 99 and len(got) == 5
    assert all(bytes(x["root"]).hex() == x["r"] for x in got)
    counts = {r["height"]: r["count"] for r in m.records.groupBy("height").count().collect()}
    assert counts == {1: 13 + 1 + 1, 2: 2 + 1, 3: 1 + 1}
