"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import ensure_shipped, materialise

#: Bytes of values in one Arrow batch that an operator hands back.
OUT_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it survives
    lost executors and is computed once."""
    return materialise(df, name)


#: Rows in an Arrow batch that Spark hands to a task. Texts are long: at Spark's
#: default of 10,000 rows the batches of one executor's tasks outgrow its memory.
BATCH_ROWS = 1024
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package available on the executors, and with
    the session's Arrow batches at most ``BATCH_ROWS`` rows long."""
    ensure_shipped(df.sparkSession)
    rows = int(df.sparkSession.conf.get(_BATCH_CONF))
    if not 0 < rows <= BATCH_ROWS:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df.mapInArrow(partial(_tidied, fn), schema)


def _tidied(fn, batches):
    """A task's result; Arrow's unused memory goes back before the worker's next task."""
    try:
        yield from fn(batches)
    finally:
        pa.default_memory_pool().release_unused()


def table_bytes(df: DataFrame) -> int:
    """Catalyst's size of ``df``; exact for a parquet table read back."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast ``df`` if its parquet size is proven to be at most ``limit``
    bytes; otherwise Spark shuffles both sides of the join."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def text_key(text: Column) -> list[Column]:
    """128-bit identity of a text as two longs (NULL counts as empty). The literal
    comes first: its hash seeds that of the text, so the second is independent."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit("second"), t)]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of ASCII only take the faster
    ``lower``, which is the same for them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)) \
            .otherwise(F.translate(text, upper, upper.lower()))


def texts(batch: pa.RecordBatch, column: int, rows: int = 128) -> Iterator[str]:
    """A column's texts (NULL: empty), of which few are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        for x in batch.column(column).slice(at, rows).to_pylist():
            yield x or ""


def chunks(rows: Iterable, size_of, limit: int = OUT_BYTES) -> Iterator[list]:
    """Consecutive rows in lists of at most about ``limit`` bytes."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += size_of(r)
        if n >= limit:
            yield out
            out, n = [], 0
    if out:
        yield out
