"""Structured Streaming forms of the continuous behaviours.

* S1 page arrivals -> extraction rows: stateless projections, append mode.
* S2 admission per host: ``applyInPandasWithState`` holding, per host, only
  the admitted items still inside the longest rate interval.
* S3 quiet periods: ``session_window`` with a watermark; a session's end is
  the moment the page went quiet.
* X1 repeated documents: ``dropDuplicatesWithinWatermark`` on the content hash.
* J2 page arrivals joined with a lexicon that changes while the stream runs:
  every micro-batch reads the lexicon's newest version.

Sinks are parquet tables with a checkpoint under ``spark.checkpoint.dir``
(exactly-once file sink), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.urls import hostname
from ..operators import html_text as H
from ..operators import links as LK
from ..operators import quality as Q
from ..session import ensure_checkpoint_dir

PAGES_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                             T.StructField("html", T.StringType())])
DOCUMENTS_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """A driver table as a file stream (each new parquet file is new input)."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}*.parquet")


def run_once(df: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over all available input (``availableNow``)
    into a parquet table under the shared checkpoint folder; return it.
    Passing the same ``base`` again resumes from the checkpoint: only new
    input files are processed and the sink is appended exactly once."""
    spark = df.sparkSession
    base = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"
    q = (df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/data")


# ---- S1 ----
def extraction_rows(pages: DataFrame) -> DataFrame:
    """Per arriving page, selector text, quality and link counts (narrow)."""
    p = (LK.with_links(pages.select("page_id", "url", "html"))
         .select("page_id", "url", hostname("url").alias("host"), H.selector_text("html").alias("text"),
                 LK.link_stats("links").alias("ls")))
    p = Q.with_quality(p, "text", "q")
    return p.select("page_id", "host", F.col("q.character_length").alias("character_length"),
                    F.col("q.content_category").alias("content_category"),
                    F.col("ls.total_links").alias("total_links"), F.col("ls.internal_links").alias("internal_links"))


# ---- S2 ----
def _admission_state_fn(rates):
    longest = max(i for _, i in rates)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            # Every admitted item is older than the longest interval: the
            # bucket is empty, so its state can go.
            state.remove()
            yield pd.DataFrame({"event_id": [], "host": [], "admitted": []})
            return
        items = deque(tuple(x) for x in (state.get[0] if state.exists else []))
        out_ids, out_ok, last = [], [], None
        # A key's rows come in several Arrow batches: the order holds across all.
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", "event_id"])
        for eid, t, w in zip(rows["event_id"].values, rows["_t"].values, rows["weight"].values):
            while items and items[0][0] <= t - longest:
                items.popleft()
            ok = all(sum(x[1] for x in items if x[0] > t - iv) + w <= lim for lim, iv in rates)
            if ok:
                items.append((int(t), int(w)))
            out_ids.append(int(eid))
            out_ok.append(bool(ok))
            last = int(t) if last is None else max(last, int(t))
        state.update(([list(x) for x in items],))
        if items:
            expire_ms = (items[-1][0] + longest) // 1000
            if expire_ms > (state.getCurrentWatermarkMs() or 0):
                state.setTimeoutTimestamp(expire_ms)
            else:
                state.remove()
        else:
            state.remove()
        yield pd.DataFrame({"event_id": out_ids, "host": [key[0]] * len(out_ids), "admitted": out_ok})
    return fn


def admission_stream(log: DataFrame, rates, watermark: str = "1 hour") -> DataFrame:
    """Per-host admission over a stream of ``(event_id, host, ts, weight)``.
    State per host holds only admitted items inside the longest interval
    and is dropped by an event-time timeout once they have all expired, so
    state stays bounded by the active hosts. Rows of a micro-batch are decided
    in event-time order, whatever order and Arrow batches they come in; equal
    to the batch W5 result if no row comes in a later micro-batch than a row
    of the same host with a later time."""
    from ..session import ensure_shipped
    ensure_shipped(log.sparkSession)
    from ..operators.timeline import as_instant
    t = (log.withColumn("_ts", as_instant("ts", log)).withWatermark("_ts", watermark)
         .select("event_id", "host", "weight", "_ts", F.unix_micros("_ts").alias("_t")))
    return t.groupBy("host").applyInPandasWithState(
        _admission_state_fn(rates), "event_id long, host string, admitted boolean",
        "items array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)


# ---- S3 ----
def quiet_sessions(mutations: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """S3: sessions of mutations per key; ``quiet_at`` is the session end
    (last mutation + gap). Rows later than the watermark are dropped."""
    from ..operators.timeline import as_instant
    t = mutations.select(key, as_instant(ts, mutations).alias("_ts")).withWatermark("_ts", watermark)
    s = t.groupBy(key, F.session_window("_ts", gap).alias("s")).agg(F.count("*").alias("mutations"))
    return s.select(key, F.unix_micros(F.col("s.start")).alias("start_us"),
                    F.unix_micros(F.col("s.end")).alias("quiet_at_us"), "mutations")


# ---- X1 ----
def first_copies(docs: DataFrame, ts: str = "ts", within: str = "1 day", key: str = "doc_id", text: str = "text") -> DataFrame:
    """X1 over a stream: one row ``(content_hash, key, ts)`` for the first arriving document of
    each content; copies that come within ``within`` of it in event time are
    dropped, in whatever micro-batch. State is one hash per content and leaves
    once the watermark has passed that time, so it is bounded by the arrivals of
    the period. Rows later than the watermark (a stream's first one is 1970), or without a
    time, are dropped. Which of several copies in one micro-batch stands for them is not defined."""
    from ..operators.corpus import content_hash
    from ..operators.timeline import as_instant
    t = docs.select(content_hash(text).alias("content_hash"), key, as_instant(ts, docs).alias(ts))
    return t.where(F.col(ts).isNotNull()).withWatermark(ts, within).dropDuplicatesWithinWatermark(["content_hash"])


# ---- J2 ----
LEXICON_SCHEMA = "category string, keyword string, version long"


def publish_lexicon(lexicon: DataFrame, path: str, version: int) -> None:
    """Write ``lexicon(category, keyword)`` as a version of its own; a stream takes the newest at its next micro-batch."""
    lexicon.select("category", "keyword").write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def newest_lexicon(spark: SparkSession, path: str) -> tuple[int | None, DataFrame]:
    """The newest version's number and rows (None and no rows if there is none)."""
    every = spark.read.schema(LEXICON_SCHEMA).option("basePath", path).parquet(path)
    version = every.agg(F.max("version")).first()[0]   # of the folders' names and footers
    return version, every.where(F.col("version") == F.lit(version)).drop("version")


def keyword_hits_stream(texts: DataFrame, lexicon_path: str, base: str | None = None) -> DataFrame:
    """J2 over a stream of ``(id, text)``: hits per (id, category), with the version of
    the lexicon that the text's micro-batch was joined with.

    A plain static table is listed once, when a stream's plan is made; here
    each micro-batch reads the newest version. A batch is written to a folder
    of its own number, replacing what a failed attempt left there, so a
    restart on the same ``base`` repeats nothing and loses nothing."""
    spark = texts.sparkSession
    base = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/keywords-{uuid.uuid4().hex[:8]}"

    def join(batch: DataFrame, batch_id: int) -> None:
        version, lexicon = newest_lexicon(batch.sparkSession, lexicon_path)
        hits = Q.keyword_hits_joined(batch, lexicon, "id", "text")
        hits.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{base}/data/batch={batch_id}")

    q = (texts.writeStream.foreachBatch(join).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return (spark.read.schema("id long, category string, hits long, version long, batch long")
            .option("basePath", f"{base}/data").parquet(f"{base}/data").drop("batch"))


def fetch_log_cols():
    """The ``fetch_log`` projection of the seeded views, for a stream of events."""
    return ["event_id", "ts",
            F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string"), F.lit(".example.org")).alias("host"),
            (1 + F.col("event_id") % 3).alias("weight")]
