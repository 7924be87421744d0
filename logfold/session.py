"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "logfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and a RocksDB state store."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder. On a
    cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.setdefault(app, _LOCAL_ROOTS.get(app) or tempfile.mkdtemp(prefix="logfold-"))
    return root


_SCOPE: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the open scope, else in the application's part of the shared folder."""
    app = os.path.join(scratch_root(spark), f"logfold-{spark.sparkContext.applicationId}")
    return os.path.join(_SCOPE.get() or app, f"{label}-{uuid.uuid4().hex}")


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Remove on exit every scratch table made inside. Results must be written by then."""
    folder = scratch_path(spark, "scope")
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts lineage in a way that survives lost executors, lets several readers share one
    computation with column pruning, and gives the optimizer true sizes: a join against
    the result is broadcast only if its files are below the session's broadcast limit.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
