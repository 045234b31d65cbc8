import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import LONG, documents, edge, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelake.llm import byte_bpe, simple8b, token_files

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Bpe(byte_bpe.read_ranks(open(RANKS, "rb").read()), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stlrea12½²é\x1c\x85\xa0́　"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encode_equals_merges(bpe, reference, text):
    ids = np.frombuffer(bpe.encode_batch([text])[0], "<u4").tolist()
    assert ids == reference.encode_ordinary(text)
    assert bpe.decode(np.array(ids, "<u4").tobytes()) == text.encode()


def test_encode_joined_tokens(bpe, reference):
    r = np.random.default_rng(5)
    for _ in range(300):
        text = reference.decode([int(i) for i in r.integers(0, 50256, 10)]).replace("�", "")
        assert np.frombuffer(bpe.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_caches_may_be_cleared(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 2)
    small = byte_bpe.Bpe(byte_bpe.read_ranks(open(RANKS, "rb").read()), P.PATTERN)
    for text in ("one two unthinkably three", "four unthinkably five six", "one seven eight  nine"):
        assert np.frombuffer(small.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_caches_hold_the_distinct_words_of_a_task(bpe):
    """A task of 16 MB meets some 300,000 pieces; those met first are not encoded again."""
    bpe.forget()
    word = lambda n: "x" + "".join("abcdefghij"[int(d)] for d in str(n))
    for start in (0, 60_000):
        bpe.encode_batch([" ".join(word(n) for n in range(start, start + 60_000))])
    assert word(0) in bpe.pieces and len(bpe.pieces) == 120_000
    bpe.forget()


def test_small_vocabulary_backtracks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259}
    own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    small = byte_bpe.Bpe(ranks, r"\S+")
    for text in ("abcd", "bcd", "abab", "abcabcd", "xbcdab", "cdcd"):
        assert np.frombuffer(small.encode_batch([text])[0], "<u4").tolist() == own.encode_ordinary(text)


def test_byte_bpe_edge_rows(spark, reference):
    docs = edge(spark, ["Plain text, 12 words.", "don't  do\nthat "])
    got = sorted(rows(byte_bpe.digests(docs, with_ids=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"), key=str)
    want = []
    for i, t in rows(docs, "doc_id", "text"):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert [(*g[:4], bytes(g[4])) for g in got] == sorted(want, key=str)
    assert byte_bpe.digests(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000), st.sampled_from([7, 128, 1024]))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, starts = simple8b.pack(v, block)
    assert (simple8b.unpack(words, starts, len(v), block) == v).all()


def test_simple8b_is_compact_and_escapes():
    words, _ = simple8b.pack(np.zeros(960, np.uint64))
    assert len(words) <= 5
    words, _ = simple8b.pack(np.full(12, 2**15 - 1, np.uint64))
    assert len(words) == 3
    for big in (2**60 - 2, 2**60 - 1, 2**60, 2**64 - 1):
        w, s = simple8b.pack(np.array([1, big, big, 2], np.uint64))
        assert simple8b.unpack(w, s, 4).tolist() == [1, big, big, 2]


def test_cached_tokenizer_equals_the_library():
    path = P.path("word_bpe_49k.json")
    own, library = token_files.CachedTokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for text in ("Don't STOP, the café's 12 ½ things…", "é ÀÉ ß straße\x1cx\x85y\xa0z", "<|endoftext|> a<|startoftext|>b", "", " ", "l'été ﬁn Ⅷ 漢字 😀!", LONG[:5000]):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_tokenizer_is_asked_once_per_word_of_a_task():
    """Words of one task outnumber 200,000; one before punctuation is the cut without it."""
    own = token_files.CachedTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    word = lambda n: "x" + "".join("abcdefghij"[int(d)] for d in str(n))
    for start in (0, 110_000):
        own.ids(" ".join(word(n) for n in range(start, start + 110_000)))
    assert word(0).encode() in own.cuts and len(own.cuts) == 220_000
    assert own.ids("Solitary,") == own.cuts[b"solitary"] + own.ids(",")


def test_pack_chooses_the_smallest_selector_that_fits():
    """The words of a plain greedy pass, value by value."""
    r = np.random.default_rng(4)
    v = np.concatenate([r.integers(0, 1 << r.integers(1, 61), r.integers(1, 400)) for _ in range(60)]).astype(np.uint64)
    want, at = [], 0
    for start in range(0, len(v), 512):
        block = [int(x) for x in v[start:start + 512]]
        at = 0
        while at < len(block):
            s = next(s for s in range(16) if all(x <= int(simple8b._MOST[s]) for x in block[at:at + int(simple8b.COUNT[s])]))
            want.append(s)
            at += int(simple8b.COUNT[s])
    words, starts = simple8b.pack(v)
    assert (words >> np.uint64(60)).tolist() == want and (simple8b.unpack(words, starts, len(v)) == v).all()


def test_token_files_edge_rows(spark):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = edge(spark, ["Zebra words here.", "a b c"]).orderBy("text")
    got = rows(token_files.digests(docs), "doc_id", "start", "n_tokens", "ids_crc32")
    ordered = sorted(rows(docs, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.digests(docs.limit(0)).count() == 0


def test_token_files_many_blobs(spark, tmp_path):
    docs = documents(spark, [f"word{i} " * (i % 50) for i in range(400)])
    path = str(tmp_path / "tokens")
    token_files.write(docs, path, P.path("word_bpe_49k.json"), end_id=1, shards=5)
    back = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in token_files.read(spark, path).collect()}
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert back == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in rows(docs, "doc_id", "text")}
    bases = sorted(rows(token_files.blob_starts(spark, path), "shard", "seq", "base"))
    assert bases[0][2] == 0 and [b[2] for b in bases] == sorted(b[2] for b in bases) and len(bases) == 5


def test_encode_then_decode_as_two_steps(spark):
    docs = edge(spark, ["Two steps, not one.", "é ½"])
    ids = byte_bpe.encode(docs, RANKS, P.PATTERN)
    back = byte_bpe.decode(ids, RANKS, P.PATTERN)
    assert sorted(((i, bytes(d).decode()) for i, d in rows(back, "doc_id", "decoded")), key=str) == sorted(((i, t or "") for i, t in rows(docs, "doc_id", "text")), key=str)
