"""Byte-level BPE encoding and decoding (operator 4).

Bytes are mapped one to one to Latin-1 characters, so that one
``pyahocorasick`` automaton of all tokens finds every match in one pass. A
piece is encoded by backtracking: take the longest token at the position; if
it cannot stand beside the token before it, take its longest proper prefix
token, and so on; if none fits, mark the position as a dead end and go back
one token. Two tokens can stand side by side if merging the bytes of both
by rank yields exactly these two tokens; that answer is memoised per pair.
No position is left as a dead end twice, so the work is linear in the piece.

Work per text: the text is cut at white space, each cut is looked up in a
bounded per-task cache of encoded cuts, and only unknown ones are split by
the pattern and encoded.

Defined cases: a NULL or empty text has no tokens (empty ``ids``); rows are
independent, so repeated rows and NULL ids keep one result row each; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, texts

#: Cached cuts and pieces of one task, each.
CACHE_ENTRIES = 300_000
#: Memoised token pairs of one Python worker.
MEMO_ENTRIES = 150_000

# Unicode White_Space, as the tokenizers' ``\s`` sees it.
_WS = "\t-\r \x85\xa0  -     　"
_CUT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Alternatives of the split pattern that a cut at white space keeps whole.
_SAFE_TAIL = r"\s+(?!\S)|\s+"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Bpe:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.of = {v: k for k, v in self.ranks.items()}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cut = _CUT if pattern.endswith(_SAFE_TAIL) and r"\r" not in pattern else None
        self.halves, self.merged = self._merges()
        usable = [t for t, i in self.ranks.items() if len(t) == 1 or i in self.halves]
        self.trie = ahocorasick.Automaton()
        for t in usable:
            self.trie.add_word(t, (len(t), self.ranks[t]))
        self.trie.make_automaton()
        known = set(usable)
        self.shorter = {}
        for t in usable:
            p = next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in known), None)
            self.shorter[self.ranks[t]] = None if p is None else self.ranks[p]
        self.memo: dict[int, bool] = {}
        self.cuts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _merges(self):
        """The two tokens that each token is merged from, and the reverse.
        A token that no merges lead to is left out: it is only ever used for
        a piece that equals it."""
        halves, merged = {}, {}
        for t, i in self.ranks.items():
            if len(t) < 2:
                continue
            parts = list(t)
            while len(parts) > 2:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    r = self.ranks.get(parts[k] + parts[k + 1])
                    if r is not None and r < i and (best is None or r < best):
                        best, at = r, k
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2 and all(p in self.ranks for p in parts):
                a, b = self.ranks[parts[0]], self.ranks[parts[1]]
                halves[i] = (a, b)
                merged[a, b] = i
        return halves, merged

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both yields these two tokens."""
        key = left << 32 | right
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            found = self.memo[key] = self._compatible(left, right)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges of both tokens from the latest to the earliest; at
        # each moment the tokens that touch must not have merged earlier than
        # the merge that was undone last.
        latest = None
        while True:
            m = self.merged.get((a, b))
            if m is not None and (latest is None or m < latest):
                return False
            ha, hb = self.halves.get(a), self.halves.get(b)
            if ha is None and hb is None:
                return True
            # the left token's merge is undone first if it came later, or if
            # both are the same merge: then the left one was made first
            if hb is None or (ha is not None and a > b):
                latest, a = a, ha[1]
            else:
                latest, b = b + 1, hb[0]

    def _longest(self, joined: str) -> list:
        best: list = [None] * len(joined)
        for end, (n, i) in self.trie.iter(joined):
            best[end - n + 1] = i
        return best

    def _encode_new(self, new: list[str]) -> None:
        """Encode pieces that the cache does not hold."""
        from struct import pack

        raw = [p.encode("utf-8").decode("latin-1") for p in new]
        joined = "\u0100".join(raw)  # no token holds the separator
        best, start = self._longest(joined), 0
        of, shorter, compatible = self.of, self.shorter, self.compatible
        for piece, text in zip(new, raw, strict=True):
            i = self.ranks.get(text)
            if i is not None:
                self.pieces[piece] = pack("<I", i)
                start += len(text) + 1
                continue
            stop, pos, out, dead = start + len(text), start, [], set()
            token = best[pos]
            while pos < stop:
                while token is not None:
                    end = pos + len(of[token])
                    if end not in dead and (not out or compatible(out[-1], token)):
                        break
                    token = shorter[token]
                if token is None:
                    dead.add(pos)
                    token = out.pop()
                    pos -= len(of[token])
                    continue
                out.append(token)
                pos = end
                token = best[pos] if pos < stop else None
            self.pieces[piece] = pack(f"<{len(out)}I", *out)
            start = stop + 1

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = self.cut.findall if self.cut else (lambda t: [t] if t else [])
        return [b"".join(self._ids(cut(t))) for t in batch]

    def _ids(self, cuts: list[str]) -> list[bytes]:
        got = list(map(self.cuts.get, cuts))
        if None in got:
            new = {c: None for c, g in zip(cuts, got, strict=True) if g is None}
            split = {c: self.pattern.findall(c) for c in new}
            fresh = list(dict.fromkeys(p for ps in split.values() for p in ps if p not in self.pieces))
            if len(self.pieces) + len(fresh) > CACHE_ENTRIES:
                self.pieces.clear()
                fresh = list(dict.fromkeys(p for ps in split.values() for p in ps))
            if fresh:
                self._encode_new(fresh)
            if len(self.cuts) > CACHE_ENTRIES:
                self.cuts.clear()
            pieces = self.pieces
            for c, ps in split.items():
                new[c] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])
                if len(c) < 64:
                    self.cuts[c] = new[c]
            got = [new[c] if g is None else g for c, g in zip(cuts, got, strict=True)]
        return got

    def forget(self) -> None:
        """Empty the caches of texts at a task's end: the worker may go on with others."""
        self.cuts.clear()
        self.pieces.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def _bpe(data: bytes, pattern: str) -> Bpe:
    return Bpe(read_ranks(data), pattern)


def _file(spark, ranks_path: str):
    """The rank file's bytes, sent to the executors once (a vocabulary file;
    its size does not depend on the data)."""
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``: each text's token ids as little-endian unsigned
    32-bit integers, as the rank table's own merges give them."""
    data = _file(docs.sparkSession, ranks_path)

    def run(batches):
        for b in batches:
            bpe = _bpe(data.value, pattern)
            at = 0
            for part in chunks(texts(b, 1), len, 1 << 20):
                ids = pa.array(bpe.encode_batch(part), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), ids], [id_col, "ids"])
                at += len(part)
        _bpe(data.value, pattern).forget()

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = src.schema[0].dataType.simpleString()
    return map_arrow(src, run, f"`{id_col}` {kind}, ids binary")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded``: the bytes that the ids stand for.
    NULL ids give no bytes."""
    data = _file(tokens.sparkSession, ranks_path)

    def run(batches):
        for b in batches:
            bpe = _bpe(data.value, pattern)
            at = 0
            for part in chunks((x.as_py() or b"" for x in b.column(1)), len, 4 << 20):
                out = pa.array([bpe.decode(x) for x in part], pa.binary())
                n = len(part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(part, pa.binary()), out], [id_col, "ids", "decoded"])
                at += n

    src = tokens.select(id_col, "ids")
    kind = src.schema[0].dataType.simpleString()
    return map_arrow(src, run, f"`{id_col}` {kind}, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded``: :func:`encode` and :func:`decode` in one
    pass, so that a task keeps one Python worker with one set of tables."""
    data = _file(docs.sparkSession, ranks_path)

    def run(batches):
        for b in batches:
            bpe = _bpe(data.value, pattern)
            at = 0
            for part in chunks(texts(b, 1), len, 1 << 20):
                ids = bpe.encode_batch(part)
                back = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
                                                 [id_col, "ids", "decoded"])
                at += len(part)
        _bpe(data.value, pattern).forget()

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_arrow(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Encode and decode with the public 50k byte-level vocabulary; digests of
    the ids and of the decoded bytes, and the ids themselves if asked for."""
    import public_tokenizers as P

    back = round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *(["ids"] if with_ids else []),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
