"""Trie of conversation prefixes, with subtree totals by time-forward processing
(operator 13).

``rebuilt`` gives conversations that share heads, ``trie`` the nodes of any
conversations (``conv_id``, ``depth`` from 1, ``a``, ``b``: the turn's identity,
``bytes``), and ``totals`` passes subtree totals from children to parents.

* A prefix is named by its depth and 128 bits: the sum, modulo 2^32 in four
  lanes, of a hash of each turn with its place. Sums are running sums over range
  partitions, so a conversation of any length is many tasks' work, and a
  parent's name is the child's less one term.
* Nodes with the same members lie on one path without branches. Such a *chain*
  is known by its smallest member and member count, and there are fewer than two
  chains per conversation. Totals are needed per chain; the share of a node
  within its chain follows from running sums of bytes.
* Nodes of more than ``rows / TOPS`` members are *heavy*: at most ``TOPS`` and the
  root, as each has so many rows of its own. Heavy nodes hold the top of the trie;
  below it, each topmost light chain is the root of a shard of bounded members.
* Chains of a shard are sorted by Spark in reverse level order (deepest first).
  A chain takes the messages addressed to it from a priority queue ordered in the
  same way, adds its own share and sends the sum to its parent; the queue spills
  sorted runs. Sums of shard roots are combined per heavy chain, and the same
  pass over the heavy chains alone finishes the tops.

Defined cases: rows of NULL ``conv_id`` take no part; turns are in order of
``turn`` (NULLs first), those of the same turn by role and then by the hash of
role and text (any text order would do, this one keeps texts out of the
shuffle); equal rows are turns of their own; a NULL role or text is empty; a
conversation may be left without turns and is then a member of the root only;
an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, shared_table
from .ordering import ranked, running, sha256_joined, shuffle_partitions

#: Heavy nodes at most (besides the root): they are broadcast and one task's work.
TOPS = 4096
#: Messages of a queue that are in memory.
QUEUE = 1 << 18
#: A conversation may borrow this many turns less one, from one of as many as follow it.
HEADS, FAMILY = 9, 5
LANES = ("l0", "l1", "l2", "l3")
LOW = (1 << 32) - 1


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id``, ``n``: turns) and their turns (``conv_id``, ``depth``,
    ``a``, ``b``, ``bytes``), each with the head of the first of its family."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"))
    # the digest orders ties; after that its two hashes with the place are all that names a turn
    placed = shared_table(ranked(shared_table(turns, "turns"), "conv_id", ["turn", "role", "digest"])
                          .select("conv_id", "rank", "digest", "bytes"), "placed-turns")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("bigint")
    sizes = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    lent = sizes.select(F.col("conv_id").alias("first"), F.col("own").alias("lent"))
    sizes = shared_table(sizes.join(lent, "first", "left").withColumn("head", F.least("h", F.coalesce("lent", F.lit(0)))), "heads")
    # at most 8 turns of a family's first, for each of at most 9 conversations
    head = placed.where(F.col("rank") < HEADS - 1).withColumnRenamed("conv_id", "first") \
                 .join(sizes.select("conv_id", "first", "h"), "first").where("rank < h") \
                 .select("conv_id", (F.col("rank") + 1).alias("depth"), "digest", "bytes")
    # h follows from the id; the head's length is the one thing to look up
    own = placed.where(F.col("rank") >= h).join(sizes.select("conv_id", "head"), "conv_id") \
                .select("conv_id", (F.col("rank") - h + F.col("head") + 1).alias("depth"), "digest", "bytes")
    made = head.unionByName(own).select("conv_id", "depth", F.xxhash64("depth", "digest").alias("a"),
                                        F.xxhash64(F.lit("second"), "depth", "digest").alias("b"), "bytes")
    n = F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return sizes.select("conv_id", n.alias("n")), made


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def _prefixes(turns: DataFrame) -> DataFrame:
    """A row per turn: ``conv_id``, ``depth``, the name ``k1``, ``k2`` of the prefix it ends and
    ``p1``, ``p2`` of the one before, ``bytes`` and ``cum``, the bytes of all turns so far."""
    split = [c for x in ("a", "b") for c in (F.shiftrightunsigned(x, 32), F.col(x).bitwiseAND(F.lit(LOW)))]
    src = turns.select("conv_id", "depth", "bytes", *[c.alias(k) for c, k in zip(split, LANES, strict=True)])
    sums = running(src, "conv_id", "depth", {**dict.fromkeys(LANES, LOW), "bytes": None})
    now = [F.col(f"sum_{k}") for k in LANES]
    before = [(s - F.col(k) + (LOW + 1)).bitwiseAND(F.lit(LOW)) for s, k in zip(now, LANES, strict=True)]
    return shared_table(sums.select("conv_id", "depth", _joined(*now[:2]).alias("k1"), _joined(*now[2:]).alias("k2"),
                                    _joined(*before[:2]).alias("p1"), _joined(*before[2:]).alias("p2"),
                                    "bytes", F.col("sum_bytes").alias("cum")), "prefixes")


class MessageQueue:
    """Messages by ascending address; above ``limit`` in memory, sorted runs go to
    the task's scratch files, which vanish with it."""

    def __init__(self, limit: int = QUEUE):
        self._heap: list[tuple] = []
        self._heads: list[tuple] = []   # (message, run number) of the first unread message of each run
        self._runs: list[Iterator[tuple]] = []
        self._limit = limit

    @staticmethod
    def _spilled(messages: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()
        for at in range(0, len(messages), 4096):
            pickle.dump(messages[at:at + 4096], file)
        file.seek(0)

        def read():
            with file:
                while True:
                    try:
                        yield from pickle.load(file)
                    except EOFError:
                        return

        return read()

    def _advance(self, run: int) -> None:
        found = next(self._runs[run], None)
        if found is not None:
            heapq.heappush(self._heads, (found, run))

    def push(self, message: tuple) -> None:
        heapq.heappush(self._heap, message)
        if len(self._heap) > self._limit:
            self._runs.append(self._spilled(sorted(self._heap)))
            self._heap = []
            self._advance(len(self._runs) - 1)

    def take(self, address: tuple) -> Iterator[tuple]:
        """The messages addressed to ``address``; none may be addressed below it."""
        while self._heap and self._heap[0][0] == address:
            yield heapq.heappop(self._heap)
        while self._heads and self._heads[0][0][0] == address:
            message, run = heapq.heappop(self._heads)
            self._advance(run)
            yield message


#: A chain: its topmost depth, smallest member and members; the same of its parent; its own
#: share; children, leaves and savings that are known to lie below it.
CHAIN = ["top", "m", "n", "ptop", "pm", "pn", "own", "children", "leaves", "below"]
_TOTALS = ", ".join(f"{c} bigint" for c in [*CHAIN, "total"])


def totals(chains: DataFrame, limit: int = QUEUE) -> DataFrame:
    """``chains`` with ``children``, ``leaves`` and ``below`` of all that lies below them
    among the chains of their partition, and ``total``: ``own`` and ``below``."""

    def run(batches):
        queue = MessageQueue(limit)
        for b in batches:
            out = []
            for top, m, n, ptop, pm, pn, own, children, leaves, below in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for _, leaves_of, saved in queue.take((-top, m, n)):
                    children, leaves, below = children + 1, leaves + leaves_of, below + saved
                leaves = leaves or 1
                if pm is not None:
                    queue.push(((-ptop, pm, pn), leaves, own + below))
                out.append((top, m, n, ptop, pm, pn, own, children, leaves, below, own + below))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], [*CHAIN, "total"])

    ordered = chains.select(*CHAIN).sortWithinPartitions(F.desc("top"), "m", "n")
    return map_arrow(ordered, run, _TOTALS)


def trie(convs: DataFrame, turns: DataFrame, tops: int = TOPS, limit: int = QUEUE) -> DataFrame:
    """Nodes of the prefixes of conversations ``convs`` (``conv_id``, ``n``) with ``turns``:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    key = ["depth", "k1", "k2"]
    rows = _prefixes(turns)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    nothing = F.lit(None).cast("bigint")
    nodes = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
                                   F.max("cum").alias("cum"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = nodes.unionByName(root.select("conv_id", "n_convs", *[zero.alias(c) for c in (*key, "bytes", "cum")], nothing.alias("p1"), nothing.alias("p2")))
    nodes = shared_table(nodes, "prefix-nodes")

    # each heavy node but the root has over rows / tops rows: at most tops of them
    most = max(1, rows.count() // tops)
    heavy = shared_table(nodes.where((F.col("n_convs") > most) | (F.col("depth") == 0)).select(*key, "conv_id", "n_convs"), "heavy-nodes")

    # parents: the heavy ones may have any number of children, the light ones at most `most`
    up = [F.col("depth") + 1, F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("pm"), F.col("n_convs").alias("pn")]
    above = lambda df: df.select(up[0].alias("depth"), *up[1:])
    below = nodes.where("depth > 0")
    of_heavy = below.join(F.broadcast(above(heavy)), ["depth", "p1", "p2"])
    of_light = below.join(F.broadcast(above(heavy)), ["depth", "p1", "p2"], "left_anti") \
                    .join(above(nodes.where((F.col("n_convs") <= most) & (F.col("depth") > 0))), ["depth", "p1", "p2"])
    kept = [*key, "conv_id", "n_convs", "bytes", "cum", "pm", "pn"]
    tops_rows = nodes.where("depth = 0").withColumn("pm", nothing).withColumn("pn", nothing)
    linked = shared_table(of_heavy.select(kept).unionByName(of_light.select(kept)).unionByName(tops_rows.select(kept)), "linked-nodes")

    # chains: nodes of the same members
    top = F.min(F.struct("depth", (F.col("cum") - F.col("bytes")).alias("start"), "pm", "pn"))
    chains = linked.groupBy(F.col("conv_id").alias("m"), F.col("n_convs").alias("n")) \
                   .agg(top.alias("t"), F.max("depth").alias("bottom"), F.max("cum").alias("cum"))
    chains = shared_table(chains.select("m", "n", F.col("t.depth").alias("top"), "bottom", "cum", F.col("t.pm").alias("pm"), F.col("t.pn").alias("pn"),
                                        ((F.col("n") - 1) * (F.col("cum") - F.col("t.start"))).alias("own")), "chains")
    # the parent's topmost depth is part of its address; hot parents are heavy
    is_heavy = (F.col("n") > most) | (F.col("top") == 0)
    heavy_chains = shared_table(chains.where(is_heavy), "heavy-chains")
    parent = lambda df: df.select(F.col("m").alias("pm"), F.col("n").alias("pn"), F.col("top").alias("ptop"))
    of_heavy = chains.join(F.broadcast(parent(heavy_chains)), ["pm", "pn"])
    of_light = chains.where("pm is not null").join(F.broadcast(parent(heavy_chains)), ["pm", "pn"], "left_anti") \
                     .join(parent(chains.where(~is_heavy)), ["pm", "pn"])
    cols = ["m", "n", "top", "own", "pm", "pn", "ptop"]
    lowest = chains.where("pm is null").withColumn("ptop", nothing)
    none = [zero.alias(c) for c in ("children", "leaves", "below")]
    addressed = shared_table(of_heavy.select(cols).withColumn("up", F.lit(True)).unionByName(of_light.select(cols).withColumn("up", F.lit(False)))
                             .unionByName(lowest.select(cols).withColumn("up", F.lit(True))), "addressed-chains")

    # a conversation's shard is its first prefix that is not heavy
    shards = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").groupBy(F.col("conv_id").alias("m")) \
                 .agg(F.min(F.struct(*key)).alias("shard"))
    light = addressed.where(~is_heavy).join(shards, "m").repartition(shuffle_partitions(rows), "shard")
    shard_totals = shared_table(totals(light.select("*", *none), limit), "shard-totals")

    # sums of shard roots, then the heavy chains
    sums = addressed.where(~is_heavy & F.col("up")).select("m", "n").join(shard_totals, ["m", "n"]) \
                    .groupBy(F.col("pm").alias("m"), F.col("pn").alias("n")) \
                    .agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("total").alias("below"))
    known = addressed.where(is_heavy).join(sums, ["m", "n"], "left").na.fill(0, ["children", "leaves", "below"])
    top_totals = totals(known.repartition(1), limit)
    found = shared_table(shard_totals.unionByName(top_totals).select("m", "n", "children", "leaves", "below"), "chain-totals")
    found = found.join(chains.select("m", "n", "bottom", F.col("cum").alias("end")), ["m", "n"])

    # members that end at a node
    last = rows.alias("r").join(convs.alias("c"), F.expr("r.conv_id = c.conv_id and r.depth = c.n")).select("r.conv_id", *key)
    last = last.unionByName(convs.where("n = 0").select("conv_id", *[zero.alias(c) for c in key]))
    last = shared_table(last.select(*key, "conv_id", F.col("conv_id").cast("string").alias("id")), "ends")
    ends = sha256_joined(last, key, "conv_id", "id", ",", "ends_sha256").withColumn("ended", F.lit(1))
    named = linked.join(ends, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))

    # a single member's nodes need no totals: one leaf, nothing saved, a child unless it ends there
    head = ["conv_id", "depth", F.col("pm").alias("parent_conv_id"), "n_convs"]
    one = named.where("n_convs = 1").select(*head, (1 - F.coalesce("ended", F.lit(0))).cast("bigint").alias("n_children"),
                                            F.lit(1).cast("bigint").alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")
    many = named.where("n_convs > 1").join(found.where("n > 1"), (F.col("conv_id") == F.col("m")) & (F.col("n_convs") == F.col("n")))
    saved = (F.col("n") - 1) * (F.col("end") - F.col("cum") + F.col("bytes")) + F.col("below")
    many = many.select(*head, F.when(F.col("depth") < F.col("bottom"), 1).otherwise(F.col("children")).cast("bigint").alias("n_children"),
                       F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), "ends_sha256")
    return one.unionByName(many)


def nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all rebuilt ``conversations``."""
    return trie(*rebuilt(conversations))
