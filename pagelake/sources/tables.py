"""Parquet table source (A1).

Pages, documents and request logs arrive as parquet tables; reading them
through ``spark.read.parquet`` keeps column pruning and filter pushdown in
the scan, so a query that needs ``page_id, url`` never reads ``html``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame, as the scan splits it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register tables as temp views under their own names."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def page_stream(spark: SparkSession, directory: str, schema=None) -> DataFrame:
    """Streaming form of the page source: new parquet files become new pages."""
    from pyspark.sql import types as T
    schema = schema or T.StructType([
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ])
    return spark.readStream.schema(schema).parquet(directory)
