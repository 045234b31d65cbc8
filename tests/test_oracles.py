"""Every registered query with a SQL oracle equals DuckDB on sf0.001."""

import math
import re

import pandas as pd
import pytest

import __spark_entry__ as E
from sf_paths import SF_SMALL

ORACLES = E.oracle_sql()
PAGE_QUERIES = ["request_results", "iframe_text", "mode_parity", "host_rollup", "link_graph", "link_type_counts", "main_text",
                "links", "link_stats", "error_page", "cascade_500", "ultra_cascade", "simple_mode_records", "browser_mode_records"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    s = sdf.toPandas()
    d = duck.execute(ORACLES[name]).df()
    assert _rows(s) == _rows(d)
    dtypes = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields} == dtypes


def test_every_query_without_oracle_runs(spark):
    """Queries with an oracle are compared above; the others give rows."""
    from pagelake.plans import catalog
    catalog.load_all()
    for name, fn in catalog.QUERIES.items():
        if name not in catalog.ORACLES:
            assert fn(spark, SF_SMALL).count() > 0, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "host" in df.columns and "internal_ratio" in df.columns


def test_queries_create_no_session_views(spark):
    before = {t.name for t in spark.catalog.listTables()}
    for name in ["body_text", "quality", "rate_window", "hash_stability", "host_rollup"]:
        E.queries()[name](spark, SF_SMALL).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def _exchange_inputs(df):
    """Input columns of every shuffle, hash or round-robin, in the formatted plan."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return [line for block in buf.getvalue().split("\n\n") if re.search(r"\) Exchange|\) ShuffleExchange", block)
            for line in block.splitlines() if line.startswith("Input")]


@pytest.mark.parametrize("name", PAGE_QUERIES)
def test_html_crosses_no_shuffle(spark, name):
    """Also where no table is small enough for an automatic broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        inputs = _exchange_inputs(E.queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.set(key, old)
    assert not any("html#" in line for line in inputs), (name, inputs)


@pytest.mark.parametrize("name", ["rate_window", "quiet_period", "stream_quiet_sessions", "stream_admission"])
def test_time_queries_ignore_session_time_zone(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        s = E.queries()[name](spark, SF_SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert _rows(s) == _rows(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["host_rollup", "error_page"])
def test_plan_stays_small(spark, name):
    """An array of the node pass that is read many times is not copied into each reader."""
    sdf = E.queries()[name](spark, SF_SMALL)
    assert len(sdf._jdf.queryExecution().executedPlan().toString()) < 150_000
