"""Session construction and the shared work folder.

Operators that need a result more than once (a fitted table, a range-bucketed
distribution) write it to the shared folder as parquet and read it back.  That cuts the
lineage, survives lost executors, and gives Catalyst real file sizes, so a join against
the result is only broadcast when its measured size is under the session's threshold.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app: str = "tabweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` is only for local runs; on a cluster it comes from spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Call-site capture per column expression costs more than planning on wide projections.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A private temporary folder is only made for a local master without that setting.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _LOCAL_FOLDERS.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="tabweave-")
        _LOCAL_FOLDERS[sc.applicationId] = base
    return f"{base.rstrip('/')}/tabweave/{sc.applicationId}"


def new_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh path in the shared folder; nothing is ever overwritten."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
