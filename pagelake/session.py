"""Session helpers for tests, the bench and local runs.

On a cluster the session comes from the platform; nothing here overrides
settings that are already present.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", app: str = "pagelake") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory))
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder in that setting. Only a local session,
    whose executors share the machine, gets a temporary folder if it is
    unset; elsewhere executors could not see each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[^,]*\])?$", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="pagelake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialise(df, name: str = "table"):
    """Cut lineage by writing ``df`` as a parquet table in the shared folder
    named by ``spark.checkpoint.dir`` and reading it back.

    Used for intermediate results that are read more than once (a model,
    parsed blocks, per-page results): they are computed once, survive the
    loss of the executors that computed them, and the read-back carries
    file-size statistics for later broadcast decisions. Columnar parquet is
    much cheaper to write than a row-serialised RDD checkpoint.
    """
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ensure_shipped(spark=None) -> None:
    """Make ``pagelake`` importable in Python workers (once per application).

    Python operators (the DOM pass, the admission fold, decoding UDFs) are
    pickled by module reference, so executors must import this package. It
    is zipped from the driver's copy and added with ``addPyFile``, which
    distributes it like ``--py-files``.
    """
    import os
    import zipfile

    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    key = (sc.applicationId, sc.startTime)
    if key in _SHIPPED:
        return
    import pagelake
    root = os.path.dirname(os.path.abspath(pagelake.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="pagelake-pyfiles-"), "pagelake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for fn in files:
                if fn.endswith(".py"):
                    full = os.path.join(dirpath, fn)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
