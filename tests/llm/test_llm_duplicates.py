import collections
import hashlib
import re

import duckdb
import numpy as np
import xxhash
from helpers import documents, edge, rows

from pagelake.llm import components, decontaminate, licenses, simhash, suffix_dedup
from pagelake.llm.common import shared_table


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(fps, ids):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    best = {}
    for r, i in zip(root, ids, strict=True):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return [best.get(r) for r in root]


def test_components(spark):
    r = np.random.default_rng(0)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000 + int(a), 1000 + int(b)) for a, b in r.integers(0, 80, (60, 2))] + [(5000, -7), (5, 5)]
    found = dict(rows(components.components(spark.createDataFrame(links, "u bigint, v bigint")), "u", "v"))
    nodes = {x for link in links for x in link}
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {x: found.get(x, x) for x in nodes} == label


def test_gray_rank_is_the_inverse_of_the_code():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_group_links_keep_components():
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 4, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (500, 2)).astype(np.uint64), axis=1) for b in base]
    x = np.unique(np.concatenate([*near, r.integers(0, 2**63, 300, dtype=np.uint64)]))
    a, b = simhash.group_links(x, 3)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    close, label = np.bitwise_count(x[:, None] ^ x[None]) <= 3, np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in close])
        if (new == label).all():
            break
        label = new
    assert len(x) - len(a) == len(set(label.tolist()))


def test_links_within_three_bits_share_a_key(spark):
    r = np.random.default_rng(9)
    x = r.integers(0, 2**63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for bit in r.choice(64, 3, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    fps = spark.createDataFrame([(int(v),) for v in np.concatenate([x, y]).view(np.int64)], "fp bigint")
    got = {frozenset(p) for p in rows(simhash.links(fps), "u", "v")}
    assert got == {frozenset((int(a), int(b))) for a, b in zip(x.view(np.int64), y.view(np.int64), strict=True)}


def test_simhash_edge_rows(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choice(words, 120)) for _ in range(30)]
    texts += [t + " tail" for t in texts[:12]] + texts[:3] + ["One two", "ONE two", "solo", "İ É", " \x0b\x0c "]
    docs = edge(spark, texts)
    want = rows(docs, "doc_id", "text")
    fps = [fingerprint(t) for _, t in want]
    ids = classes(fps, [i for i, _ in want])
    expected = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(want, fps, ids, strict=True)), key=str)
    assert sorted(rows(simhash.classes(docs), "doc_id", "fingerprint", "component_id"), key=str) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(i for (i,) in rows(kept, "doc_id")) == sorted({c for c in ids})
    assert simhash.classes(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_of_nameless_rows(spark):
    docs = documents(spark, ["a b c d", "a b c d", "x y z"]).selectExpr("cast(null as bigint) as doc_id", "text")
    assert sorted(rows(simhash.keep_one(docs), "text")) == [("a b c d",), ("x y z",)]


def covered(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[s:s + length] for d in data for s in range(len(d) - length + 1))
    marks = []
    for d in data:
        m = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                m[s:s + length] = b"\1" * length
        marks.append(m)
    return data, marks


def repeated_texts():
    r = np.random.default_rng(12)
    word = [f"{a}{b}{c}" for a in "bdkst" for b in "aeiouéü" for c in ("n", "r", "lt", "")]
    line = lambda n: " ".join(r.choice(word, n))
    common, other = line(60), line(90)
    texts = [line(80) + " " + common + " " + line(30) for _ in range(6)] + [line(150)] * 3 + [other + line(10), line(10) + other, "ab" * 400, "x" * 900, line(30) * 4]
    edited = list(texts[0])
    edited[200] = "#"
    return [*texts, "".join(edited), common[:150], line(500), "é" * 99, "é" * 100, "y" + "é" * 100]


def check_spans(docs, found):
    want = rows(docs, "doc_id", "text")
    data, marks = covered([t for _, t in want])
    expected = []
    for (i, _), d, m in zip(want, data, marks, strict=True):
        kept = bytes(x for x, f in zip(d, m, strict=True) if not f)
        expected.append((i, len(d), sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), hashlib.sha256(kept).hexdigest()))
    assert sorted(found, key=str) == sorted(expected, key=str)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_equals_brute_force(spark):
    docs = documents(spark, [*repeated_texts(), None, "", "short"])
    check_spans(docs, rows(suffix_dedup.digests(docs), *COLUMNS))
    assert suffix_dedup.digests(docs.limit(0)).count() == 0


def test_suffix_dedup_hot_grams_slices_and_shuffles(spark, monkeypatch):
    """The ways for large inputs give the same rows."""
    monkeypatch.setattr(suffix_dedup, "HOT_CONTENTS", 2)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    docs = documents(spark, repeated_texts())
    check_spans(docs, rows(suffix_dedup.digests(docs), *COLUMNS))


def test_suffix_dedup_shuffles_alike_from_small_sizes_on(spark):
    """Spans of half a megabyte are not broadcast: disk would leap once they outgrow that."""
    docs = documents(spark, repeated_texts())
    spans = shared_table(spark.range(40_000).selectExpr("xxhash64(id) AS k1", "shiftrightunsigned(xxhash64(id, 1), 40) AS kk",
                                                        "array(struct(id AS start, id + 200 AS end)) AS spans"), "spans")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "256k")
    try:
        plan = suffix_dedup.remove(docs, spans)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_suffix_dedup_repeated_rows_and_nameless(spark):
    docs = edge(spark, ["q" * 199, "unique words stand here"])
    found = {(i, n, removed) for i, n, removed, _, _ in rows(suffix_dedup.digests(docs), *COLUMNS)}
    assert (0, 199, 0) in found and (None, 0, 0) in found
    n = len("alpha beta gamma delta ") * 30_000
    assert (4, n, n) in found  # the long text repeats itself


def test_remove_text_keeps_characters_and_columns(spark):
    docs = documents(spark, repeated_texts())
    spans = suffix_dedup.repeated_spans(docs)
    cut = suffix_dedup.remove_text(docs, spans)
    assert cut.columns == docs.columns
    want = rows(docs, "doc_id", "text")
    data, marks = covered([t for _, t in want])
    got = dict(rows(cut, "doc_id", "text"))
    for (i, t), m in zip(want, marks, strict=True):
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not all(m[at:at + n]):
                kept.append(c)
            at += n
        assert got[i] == "".join(kept)


def test_licenses_equal_the_oracle(spark):
    texts = ["Some text. Released under the MIT License.", "CC-BY cc by CC BY-NC 4.0 and Licensed under CC BY-NC 4.0!", "all rights reserved", "All rights were reserved",
             "This work is licensed under the GNU General Public License, version 3. General  public\nlicense", "licensed under the Apache license, Version 2.1",
             "éall rights reserved", "all rights reserved É", "cc by" * 3, "by cc", "cc", "K all K rights reserved", "...", "a b" * 50]
    docs = edge(spark, texts)
    got = rows(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.execute("CREATE TABLE d2 AS SELECT * FROM documents")
    con.unregister("documents")
    con.execute("CREATE VIEW documents AS SELECT * FROM d2")
    want = con.execute(licenses.ORACLE).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    by = {g[0]: g for g in got}
    assert by[2][2:7] == (1, 0, 0, "reserved", "reserved") and by[3][2] == 0 and "mit" in by[0][6] and "apache-2.0" in by[5][6]
    assert licenses.scan(docs.limit(0)).count() == 0


def words(text):
    import regex
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def contaminated(texts, items):
    def shingles(w, k):
        return collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))

    out = []
    for t in texts:
        w, found = words(t), []
        for i, item in items:
            m = len(iw := words(item))
            if i is None or not m:
                continue
            k, best = min(5, m), 0.0
            c = shingles(iw, k)
            for s in range(max(1, len(w) - m + 1)):
                x = shingles(w[s:s + m], k)
                both = sum((x & c).values())
                union = sum(x.values()) + sum(c.values()) - both
                best = max(best, both / union if union else 0)
            if best >= 0.8:
                found.append((-best, i))
        out.append((bool(found), len({i for _, i in found}), min(found)[1] if found else None, -min(found)[0] if found else 0.0))
    return out


def test_decontaminate_equals_brute_force(spark):
    r = np.random.default_rng(21)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("or", "en", "ti", "wh", "ea", "ou")]
    line = lambda n: " ".join(r.choice(vocabulary, n))
    items = [(i, line(n)) for i, n in enumerate((40, 60, 25, 14, 80, 40))] + [(6, "short item"), (7, "three word item"), (8, ""), (9, None), (None, line(30)), (3, "other text of three")]
    texts = [line(200)]
    for i, (_, t) in enumerate(items[:6]):
        w = t.split()
        texts += [f"{line(20)}. {t.upper()}, {line(15)}", " ".join([*w[:len(w) // 2], "inserted", *w[len(w) // 2:]]), " ".join(w[1:]), " ".join([*w[:-1], "last"]),
                  f"{line(5)} {' '.join(w[:len(w) // 2])} {line(50)}", t + "\n" + t]
    texts += ["a short item here", "three word", "This: THREE-word item!", items[0][1] + " " + items[1][1]]
    docs = edge(spark, texts)
    bench = spark.createDataFrame(items + items[:2], "item_id bigint, text string").selectExpr("*", "1 as m", "2 as k", "'z' as iw")
    want = rows(docs, "doc_id", "text")
    expected = sorted(((i, *c) for (i, _), c in zip(want, contaminated([t for _, t in want], items), strict=True)), key=str)
    got = rows(decontaminate.verdicts(docs, bench), "doc_id", "contaminated", "n_items", "best_item", "similarity")
    assert sorted(got, key=str) == expected
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(rows(kept, "doc_id"), key=str) == sorted(((e[0],) for e in expected if not e[1]), key=str)
    assert decontaminate.verdicts(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.verdicts(docs.limit(0), bench).count() == 0


def test_decontaminate_swapped_halves_and_repeated_shingles(spark):
    """Windows in which no shared shingle stands where it stands in its item."""
    fill = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    items = [(n, fill(f"i{n}w", n)) for n in (40, 48, 64, 23)] + [(9, "a b c d e " * 12), (10, fill("x", 20) + " a b c d e a b c d e a b c d e")]
    texts = []
    for n, item in items:
        w = item.split()
        swapped = " ".join(w[len(w) // 2:] + w[:len(w) // 2])
        texts += [f"{fill('b', 30)} {swapped} {fill('c', 30)}", swapped, f"{fill('b', 30)} {swapped}", f"{item} {swapped} {item}", " ".join(w[:int(len(w) * 0.85)])]
    docs = edge(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = rows(docs, "doc_id", "text")
    expected = sorted(((i, *c) for (i, _), c in zip(want, contaminated([t for _, t in want], items), strict=True)), key=str)
    assert [c[0] for c in contaminated([texts[0], texts[5], texts[10]], items)] == [True] * 3
    assert sorted(rows(decontaminate.verdicts(docs, bench), "doc_id", "contaminated", "n_items", "best_item", "similarity"), key=str) == expected


def test_decontaminate_keeps_no_cut_items(spark):
    """Three of 36 words turn the majority in the item, and half of the bits of a word SimHash."""
    head = "ba ab ab ba ba ba ab ba ab ab ba ba ab ba ab ab ab ba ba ab ba ab ba ab ab ba ba ab ab ba ba ab ab".split()
    item, tail = " ".join([*head, "ba", "ba", "ba"]), " ".join([*head, "ab", "ab", "ab"])
    docs = documents(spark, [tail, f"{tail} other words", "other words"])
    got = rows(decontaminate.verdicts(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")), "doc_id", "contaminated", "n_items", "best_item", "similarity")
    want = contaminated([tail, f"{tail} other words", "other words"], [(1, item)])
    assert [w[0] for w in want] == [True, True, False]
    assert [g[1:] for g in sorted(got)] == want


def test_native_operators_run_no_python(spark):
    docs = documents(spark, ["released under the mit license", "one two three four five six"])
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    for df in (licenses.scan(docs), decontaminate.verdicts(docs, bench)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
