"""Token-ID files in Simple-8b (operator 2).

``write`` encodes every text with a vocabulary file of the ``tokenizers``
library, appends the end id, and writes the ids in ascending document order
as a parquet dataset of blobs; ``read`` unpacks them again. A row of the
dataset is one blob of whole documents, at least ``BLOB_IDS`` ids unless it is
the last of its shard::

    shard int, seq int       place of the blob: shards and blobs ascend with doc_id
    doc_ids array<bigint>    the documents in order
    n_tokens array<bigint>   ids of each document, with the end id
    n_ids bigint             their sum
    payload binary           <4s magic, u32 block size, u64 ids, u64 words>,
                             u64 first word of each block and the end, u64 words

Parquet is the container because Spark can write and read it on any store.
Texts are range-partitioned by doc_id once, before they are encoded.

Defined cases: a NULL or empty text has the end id only; NULL doc_ids come
first; equal doc_ids are ordered by text, and equal rows are kept; an empty
table gives no rows; other columns are ignored. A document is never split, so
a very long one makes one larger blob.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.session import ensure_checkpoint_dir

from .common import map_arrow, texts
from .simple8b import BLOCK, pack, unpack

BLOB_IDS = 1 << 19
#: Cached cuts of one task, words among them.
CACHE_ENTRIES = 400_000
MAGIC = b"TKS8"
_HEAD = struct.Struct("<4sIQQ")


class CachedTokenizer:
    """The library's tokenizer, asked once per distinct cut at white space.

    Valid for tokenizers that drop white space and never join what stands on
    both sides of it. Words of Latin-1 letters, whose normal form is their
    lower case, go to the library's model directly, the rest through the whole
    tokenizer.
    """

    def __init__(self, data: str):
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        spec = json.loads(data)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("a lower-casing tokenizer that drops white space is needed")
        self.ascii = re.compile(rb"([a-zA-Z]+)([.,;:!?]*)")
        self.latin = re.compile("([a-zA-Zà-öø-ÿÀ-ÖØ-Þß]+)([.,;:!?]*)")
        # byte-level alphabet: printable bytes stand for themselves, the others for what follows 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_level = {b: 256 + n for n, b in enumerate(hidden)}
        self.model = self.tokenizer.model
        self.cuts: dict[bytes, bytes] = {}
        self.punctuation: dict[bytes, bytes] = {b"": b""}

    def _model_ids(self, word: bytes) -> bytes:
        """Ids of a lower-case word or run of punctuation, as UTF-8."""
        mapped = word.decode("ascii") if word.isascii() else word.decode("latin-1").translate(self.byte_level)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        """Ids of a lower-case word, which is a cut of its own elsewhere."""
        got = self.cuts.get(word)
        if got is None:
            got = self.cuts[word] = self._model_ids(word)
        return got

    def _marks(self, marks: bytes) -> bytes:
        """Ids of a run of punctuation."""
        got = self.punctuation.get(marks)
        if got is None:
            if len(self.punctuation) >= 10_000:
                self.punctuation = {b"": b""}
            got = self.punctuation[marks] = self._model_ids(marks)
        return got

    def _cut(self, cut: bytes) -> bytes:
        if cut.isalpha():  # of bytes: ASCII letters only
            return self._word(cut.lower())
        m = self.ascii.fullmatch(cut)
        if m:
            return self._word(m[1].lower()) + self._marks(m[2])
        text = cut.decode("utf-8")
        m = self.latin.fullmatch(text)
        if m:
            return self._word(m[1].lower().encode("utf-8")) + self._marks(m[2].encode("ascii"))
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def forget(self) -> None:
        """Empty the caches at a task's end: the worker may go on with others."""
        self.cuts.clear()

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            # lower case first where it is sure to be the tokenizer's, and makes no special token
            cuts = (text if "<|" in text else text.lower()).encode("utf-8").split()
        except UnicodeEncodeError:
            cuts = text.encode("utf-8").split()
        got = list(map(self.cuts.get, cuts))
        if None in got:
            if len(self.cuts) > CACHE_ENTRIES:
                self.cuts.clear()  # what was found stays in ``got``
            for i, ids in enumerate(got):
                if ids is None:
                    cut = cuts[i]
                    ids = self.cuts.get(cut)  # met above, in this text
                    if ids is None:
                        ids = self.cuts[cut] = self._cut(cut)
                    got[i] = ids
        return b"".join(got)


@lru_cache(maxsize=2)
def _tokenizer(data: str) -> CachedTokenizer:
    return CachedTokenizer(data)


def pack_blob(ids: np.ndarray) -> bytes:
    words, starts = pack(ids.astype(np.uint64))
    return _HEAD.pack(MAGIC, BLOCK, len(ids), len(words)) + starts.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def unpack_blob(blob: bytes) -> np.ndarray:
    magic, block, n, n_words = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token blob")
    blocks = -(-n // block)
    starts = np.frombuffer(blob, "<u8", blocks + 1, _HEAD.size).astype(np.int64)
    words = np.frombuffer(blob, "<u8", n_words, _HEAD.size + 8 * (blocks + 1))
    return unpack(words, starts, n, block)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of ``docs`` as the dataset described above.
    ``shards``: range partitions, by default the session's shuffle partitions."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        data = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the data
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = struct.pack("<I", end_id)

    def run(batches):
        shard, seq = TaskContext.get().partitionId(), 0
        doc_ids, parts, held = [], [], 0

        def blob():
            nonlocal seq, doc_ids, parts, held
            n = [len(p) // 4 for p in parts]
            payload = pack_blob(np.frombuffer(b"".join(parts), "<u4"))
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "seq": pa.array([seq], pa.int32()),
                                              "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "n_tokens": pa.array([n], pa.list_(pa.int64())),
                                              "n_ids": pa.array([sum(n)], pa.int64()), "payload": pa.array([payload], pa.binary())})
            seq, doc_ids, parts, held = seq + 1, [], [], 0
            return out

        for b in batches:
            tok = _tokenizer(data.value)
            for i, text in zip(b.column(0).to_pylist(), texts(b, 1), strict=True):
                doc_ids.append(i)
                parts.append(tok.ids(text) + end)
                held += len(parts[-1]) // 4
                if held >= BLOB_IDS:
                    yield blob()
        if doc_ids:
            yield blob()
        _tokenizer(data.value).forget()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = src.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    blobs = map_arrow(ordered, run, "shard int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, payload binary")
    blobs.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token dataset: ``shard``, ``seq``, ``doc_id``,
    ``offset`` (ids before it in its blob), ``n_tokens`` and ``ids`` (little-endian
    unsigned 32-bit integers)."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = unpack_blob(row["payload"]).astype("<u4")
                ends = np.cumsum(row["n_tokens"], dtype=np.int64)
                starts = ends - row["n_tokens"]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts), pa.array(row["n_tokens"], pa.int64()),
                    pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())],
                    ["shard", "seq", "doc_id", "offset", "n_tokens", "ids"])

    blobs = spark.read.parquet(path).select("shard", "seq", "doc_ids", "n_tokens", "payload")
    return map_arrow(blobs, run, "shard int, seq int, doc_id bigint, offset bigint, n_tokens bigint, ids binary")


def blob_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard``, ``seq``, ``base``: the ids before each blob in the dataset. Sums
    within a shard are made in parallel; only one row per shard meets."""
    blobs = spark.read.parquet(path).select("shard", "seq", "n_ids")
    shards = blobs.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blobs = blobs.select("shard", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    return blobs.join(shards, "shard").select("shard", "seq", (F.col("inside") + F.col("before")).alias("base"))


def digests(docs: DataFrame) -> DataFrame:
    """Write ``docs`` with the public 49k word vocabulary and end id 1 to the
    shared folder, read the files back, and describe each document from them."""
    import uuid

    import public_tokenizers as P

    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex[:12]}"
    write(docs, path, P.path("word_bpe_49k.json"), end_id=1)
    found = read(spark, path).select("shard", "seq", "doc_id", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(blob_starts(spark, path), ["shard", "seq"]) \
                .select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
