"""Places in a global order, and digests of whole ordered groups, for groups of any size.

A group may hold most of all rows, so no group is brought to one task to be
ordered: rows are range-partitioned by (group, order), and only groups that lie
on a border of two partitions are put together afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, shared_table


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def run_starts(values: np.ndarray, last) -> np.ndarray:
    """True where a value differs from the one before it (``last`` before the first)."""
    before = np.empty(len(values), dtype=object)
    before[0], before[1:] = last, values[:-1]
    return values.astype(object) != before


def ranked(table: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``table`` with ``rank``: the place of each row among those of its group,
    from 0, by the columns ``order`` (NULLs first; equal rows in any order, each
    with a place of its own). ``table`` is read from the shared folder and
    ``group`` is never NULL. At most two groups per partition meet elsewhere."""

    def places(batches):
        pid, last, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            values = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            at = np.arange(b.num_rows)
            starts = np.where(run_starts(values, last), at, -1)
            first = np.maximum.accumulate(starts)
            pos = np.where(first >= 0, at - first, at + held)
            last, held = values[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(pos.astype(np.int64))],
                                             [*b.schema.names, "_pid", "_pos"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    keyed = table.withColumn("_at", F.monotonically_increasing_id())  # equal rows are many, too
    dealt = keyed.repartitionByRange(shuffle_partitions(table), group, *order, "_at") \
                 .sortWithinPartitions(group, *order, "_at").drop("_at")
    placed = shared_table(map_arrow(dealt, places, f"{schema}, _pid int, _pos bigint"), "ranked")
    ends = placed.groupBy("_pid").agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    border = ends.select(F.explode(F.array("lo", "hi")).alias(group)).distinct()  # two rows per partition at most
    counts = placed.join(F.broadcast(border), group, "left_semi").groupBy(group, "_pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    base = shared_table(counts.select(group, "_pid", before.alias("base")).where("base > 0"), "bases")  # one row per partition at most
    return placed.join(F.broadcast(base), [group, "_pid"], "left") \
                 .withColumn("rank", F.col("_pos") + F.coalesce("base", F.lit(0))).drop("_pid", "_pos", "base")


def running(table: DataFrame, group: str, order: str, masks: dict[str, int | None]) -> DataFrame:
    """``table`` with ``sum_<c>`` for each column ``c`` of ``masks``: the sum of ``c``
    over the group's rows up to this one by ``order`` (unique in the group), cut
    to the bits of the mask if there is one. Columns with a mask hold values within
    it, of at most 32 bits; ``group`` is never NULL."""
    cut = lambda x, mask: x if mask is None else x & mask

    def sums(batches):
        pid, last, held = TaskContext.get().partitionId(), None, dict.fromkeys(masks, 0)
        for b in batches:
            if not b.num_rows:
                continue
            values = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            at = np.arange(b.num_rows)
            first = np.maximum.accumulate(np.where(run_starts(values, last), at, -1))
            found = []
            for c, mask in masks.items():
                v = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                s = cut(total - np.where(first >= 0, total[first] - v[first], -held[c]), mask)
                held[c] = int(s[-1])
                found.append(pa.array(s.astype(np.int64)))
            last = values[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), *found],
                                             [*b.schema.names, "_pid", *(f"_{c}" for c in masks)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    dealt = table.repartitionByRange(shuffle_partitions(table), group, order).sortWithinPartitions(group, order)
    summed = shared_table(map_arrow(dealt, sums, f"{schema}, _pid int, " + ", ".join(f"`_{c}` bigint" for c in masks)), "running")
    ends = summed.groupBy("_pid").agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    border = ends.select(F.explode(F.array("lo", "hi")).alias(group)).distinct()  # two rows per partition at most
    parts = summed.join(F.broadcast(border), group, "left_semi").groupBy(group, "_pid").agg(*[F.sum(c).alias(c) for c in masks])
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(group, "_pid", *[F.sum(c).over(before).alias(f"base_{c}") for c in masks])
    base = shared_table(base.where(F.col(f"base_{next(iter(masks))}").isNotNull()), "bases")
    out = summed.join(F.broadcast(base), [group, "_pid"], "left")
    for c, mask in masks.items():
        s = F.col(f"_{c}") + F.coalesce(f"base_{c}", F.lit(0))
        out = out.withColumn(f"sum_{c}", s if mask is None else s.bitwiseAND(F.lit(mask)))
    return out.drop("_pid", *(f"_{c}" for c in masks), *(f"base_{c}" for c in masks))


def sha256_of_parts(parts: DataFrame, keys: list[str], order: str, columns: list[str], sep: str = "") -> DataFrame:
    """``keys`` and, for each of ``columns``, the sha256 (hex) of a key's strings
    joined by ``sep`` in the order of ``order``. A digest is one sequential
    stream, so a key is one task's work, in constant memory: callers give few
    and large parts, and only of keys that have several."""
    mark = sep.encode()

    def run(batches):
        key, state, found = None, [], []

        def close():
            if key is not None:
                found.append([*key, *[h.hexdigest() for h in state]])

        def out():
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names)
            found.clear()
            return got

        kinds = names = None
        for b in batches:
            kinds = [*(b.schema.field(k).type for k in keys), *[pa.string()] * len(columns)]
            names = [*keys, *columns]
            ids = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            texts = [b.column(b.schema.get_field_index(c)) for c in columns]
            for i, k in enumerate(ids):
                fresh = k != key
                if fresh:
                    close()
                    key, state = k, [hashlib.sha256() for _ in columns]
                for h, t in zip(state, texts, strict=True):
                    if not fresh and mark:
                        h.update(mark)
                    h.update((t[i].as_py() or "").encode())
            if len(found) > 4096:
                yield out()
        close()
        if found:
            yield out()

    kind = dict(parts.dtypes)
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), *(f"`{c}` string" for c in columns)])
    dealt = parts.select(*keys, order, *columns).repartition(*keys).sortWithinPartitions(*keys, order)
    return map_arrow(dealt, run, schema)


#: Characters of a joined part.
PART_CHARS = 1 << 16


def sha256_joined(rows: DataFrame, keys: list[str], order: str, piece: str, sep: str, name: str) -> DataFrame:
    """``keys`` and ``name``: the sha256 (hex) of the strings ``piece`` of each
    key, joined by ``sep`` in the order of ``order``. Range partitions join
    neighbouring strings into parts; a key that lies within one part is digested
    there, the others by :func:`sha256_of_parts`. Keys are never NULL."""

    def run(batches):
        pid, n = TaskContext.get().partitionId(), 0
        key, held, size, split, first = None, [], 0, False, True
        out: list = []

        def put(whole):
            nonlocal n, held, size
            text = sep.join(held)
            out.append((*key, (pid << 32) + n, hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text))
            n, held, size = n + 1, [], 0

        def batch():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], [*keys, "part", name, "text"])

        kinds = None
        for b in batches:
            kinds = [*(b.schema.field(k).type for k in keys), pa.int64(), pa.string(), pa.string()]
            ids = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            for k, p in zip(ids, b.column(b.schema.get_field_index(piece)).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        put(whole=not (split or first))
                        first = False
                    key, split = k, False
                elif size >= PART_CHARS:
                    put(whole=False)
                    split = True
                held.append(p)
                size += len(p)
            if sum(len(r[-1] or "") for r in out) > 16 * PART_CHARS or len(out) > 4096:
                yield batch()
        if key is not None:
            put(whole=False)  # the next partition may go on with it
            yield batch()

    kind = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "part bigint", f"`{name}` string", "text string"])
    dealt = rows.select(*keys, order, piece).repartitionByRange(shuffle_partitions(rows), *keys, order).sortWithinPartitions(*keys, order)
    parts = shared_table(map_arrow(dealt, run, schema), "parts")
    rest = sha256_of_parts(parts.where(F.col(name).isNull()), keys, "part", ["text"], sep).withColumnRenamed("text", name)
    return parts.where(F.col(name).isNotNull()).select(*keys, name).unionByName(rest)
