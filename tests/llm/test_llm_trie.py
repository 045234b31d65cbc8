"""Operator 13 against a plain trie of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import LONG

from pagelake.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def content(role, text):
    role, text = role or "", text or ""
    return role, text, hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()


def rebuilt(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            r, t, digest = content(role, text)
            own[c].append(((turn is not None, turn or 0, r, digest), (r, t)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def brute(convs):
    members, ends, children = defaultdict(set), defaultdict(set), defaultdict(set)
    for c, turns in convs.items():
        ends[turns].add(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
            if d:
                children[turns[:d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0], r[1], r[3]))


def frame(spark, data):
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    return df.selectExpr("*", "1 as depth", "'x' as k1", "2 as n", "'d' as digest", "3 as rank", "4 as bytes", "5 as top")


def sample():
    rng = random.Random(5)
    data = []
    for c in range(160):
        for turn in range(rng.randrange(1, 9)):
            data.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["Hello", "ünï", "", "no"])))
    data += [(c, t, "user", "common") for c in range(200, 240) for t in range(3)]             # one common conversation
    data += [(c, t, "user", f"t{t}") for c in (300, 1000) for t in range(400 if c == 300 else 380)]  # long, one is the head of the other
    data += [(400, None, None, None), (400, 2, "user", "b"), (400, 2, "user", "a"), (400, 2, "user", "a"), (401, 0, "user", LONG), (402, 0, "user", LONG)]
    return [*data, (None, 0, "user", "nobody"), *data[:3]]


@pytest.fixture(scope="module")
def case(spark):
    data = sample()
    return frame(spark, data), brute(rebuilt(data))


def test_nodes_equal_a_plain_trie(case):
    df, want = case
    assert got(prefix_trie.nodes(df)) == want


def test_small_shards_and_a_spilling_queue(case):
    df, want = case
    assert got(prefix_trie.trie(*prefix_trie.rebuilt(df), tops=12, limit=2)) == want


@pytest.mark.parametrize("data", [[], [(3, 0, "user", "x")]])
def test_few_rows(spark, data):
    assert got(prefix_trie.nodes(frame(spark, data))) == brute(rebuilt(data))


def test_queue_gives_messages_of_an_address_from_memory_and_runs():
    rng = random.Random(1)
    sent = [((rng.randrange(-9, 0), rng.randrange(5), 1), i, 2 * i) for i in range(500)]
    queue = prefix_trie.MessageQueue(limit=7)
    for m in sent:
        queue.push(m)
    for address in sorted({m[0] for m in sent}):
        assert sorted(queue.take(address)) == sorted(m for m in sent if m[0] == address)
