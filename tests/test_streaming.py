"""Streams resume from their checkpoint: two file arrivals processed in two
runs give the batch result, each input exactly once."""

import pyarrow.parquet as pq
import pyarrow.compute as pc

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from pagelake.operators import html_text as H
from pagelake.operators import timeline as TL
from pagelake.sources.seeded import seeded
from pagelake.sources.tables import read_table
from pagelake.streaming import jobs as S


def _split(src, dst, name, key, cut):
    t = pq.read_table(f"{src}/{name}.parquet")
    pq.write_table(t.filter(pc.less(t[key], cut)), f"{dst}/{name}-1.parquet")
    return t.filter(pc.greater_equal(t[key], cut))


def test_extraction_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rest = _split(SF_SMALL, src, "pages", "page_id", 20)
    base = str(tmp_path / "out")
    first = S.run_once(S.extraction_rows(S.stream_table(spark, str(src), "pages", S.PAGES_SCHEMA)), "x", base=base).count()
    pq.write_table(rest, f"{src}/pages-2.parquet")
    both = S.run_once(S.extraction_rows(S.stream_table(spark, str(src), "pages", S.PAGES_SCHEMA)), "x", base=base)
    batch = S.extraction_rows(read_table(spark, SF_SMALL, "pages"))
    assert first == 20
    assert sorted(tuple(r) for r in both.collect()) == sorted(tuple(r) for r in batch.collect())


def test_admission_stream_resumes_with_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rest = _split(SF_SMALL, src, "events", "event_id", 400)
    base = str(tmp_path / "out")
    rates = [(10, 2 * TL.HOUR_US)]

    def run():
        ev = S.stream_table(spark, str(src), "events", S.EVENTS_SCHEMA).select(*S.fetch_log_cols())
        return S.run_once(S.admission_stream(ev, rates), "adm", base=base)
    assert run().count() == 400
    pq.write_table(rest, f"{src}/events-2.parquet")
    streamed = {r.event_id: r.admitted for r in run().collect()}
    f = seeded(spark, SF_SMALL, "fetch_log").select("event_id", "host", "ts", "weight")
    batch = {r.event_id: r.admitted for r in TL.admission(f, "host", "ts", "event_id", "weight", rates).collect()}
    assert streamed == batch


def test_quiet_sessions_drop_rows_past_the_watermark(spark, tmp_path):
    """S3: a file of old events that arrives after newer ones is behind the
    watermark; its rows are dropped instead of re-opening closed sessions."""
    src = tmp_path / "in"
    src.mkdir()
    t = pq.read_table(f"{SF_SMALL}/events.parquet")
    cut = t["event_id"].to_pylist()[len(t) // 2]
    newer = t.filter(pc.greater_equal(t["event_id"], cut))
    older = t.filter(pc.less(t["event_id"], cut))
    pq.write_table(newer, f"{src}/events-1.parquet")
    base = str(tmp_path / "out")

    def run():
        ev = S.stream_table(spark, str(src), "events", S.EVENTS_SCHEMA).select("user_id", "ts")
        return S.run_once(S.quiet_sessions(ev, "user_id", "ts", "2 hours", "1 hour"), "q", base=base)
    first = run().count()
    pq.write_table(older, f"{src}/events-2.parquet")
    after = run()
    assert after.count() >= first
    # sessions only from the newer half: nothing starts before its first event
    min_new = min(newer["ts"].to_pylist())
    import datetime as dt
    floor_us = int((min_new - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert after.agg({"start_us": "min"}).first()[0] >= floor_us


def test_first_copies_emit_nothing_twice_over_restarts(spark, tmp_path):
    """Copies in a later file, within the watermark, are dropped, also by a restarted stream."""
    import pyarrow as pa
    src, base = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def arrive(n, rows):
        pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}),
                       f"{src}/documents-{n}.parquet")
        docs = S.stream_table(spark, str(src), "documents", S.DOCUMENTS_SCHEMA)
        docs = docs.withColumn("ts", F.timestamp_seconds("doc_id"))
        return [r.doc_id for r in S.run_once(S.first_copies(docs, within="1 hour"), "c", base=base).orderBy("doc_id").collect()]
    assert arrive(1, [(10, "One  text"), (11, "another"), (None, "no time"), (12, None)]) == [10, 11, 12]
    assert arrive(2, [(20, "one\ntext"), (21, "third"), (22, ""), (10, "One  text")]) == [10, 11, 12, 21]
    assert arrive(3, [(90000, "much later")]) == [10, 11, 12, 21, 90000]
    assert arrive(4, [(90001, "one text"), (90002, "much LATER")]) == [10, 11, 12, 21, 90000, 90001]  # the first is out of the period


def test_stream_takes_the_newest_lexicon_at_each_batch(spark, tmp_path):
    import pyarrow as pa
    src, base, path = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "lexicon")
    src.mkdir()

    def lexicon(version, rows):
        S.publish_lexicon(spark.createDataFrame(rows, "category string, keyword string"), path, version)

    def arrive(n, rows):
        pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": ["u"] * len(rows), "html": [r[1] for r in rows]}), f"{src}/pages-{n}.parquet")
        pages = S.stream_table(spark, str(src), "pages", S.PAGES_SCHEMA)
        texts = pages.select(F.col("page_id").alias("id"), H.selector_text("html").alias("text"))
        return sorted(tuple(r) for r in S.keyword_hits_stream(texts, path, base).select("id", "category", "hits", "version").collect())
    lexicon(1, [("a", "red"), ("a", "blue sky")])
    first = arrive(1, [(1, "<p>red red blue sky"), (2, "<p>green")])
    assert first == [(1, "a", 3, 1)]
    lexicon(2, [("b", "green"), ("a", "blue sky")])
    assert arrive(2, [(3, "<p>green red"), (4, "<p>blue sky")]) == [*first, (3, "b", 1, 2), (4, "a", 1, 2)]
