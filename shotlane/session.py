"""Session defaults and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "shotlane", **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # array-per-shot rows are wide: keep Arrow batches small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one named by ``spark.checkpoint.dir``; only a local session may leave that unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        configured = "file:///tmp/checkpoints"
    return f"{configured.rstrip('/')}/shotlane-{spark.sparkContext.applicationId}"


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths that ``scratch_path`` hands out inside, in order, so that a caller can ``release`` them."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    written = _written.get()
    if written is not None:
        written.append(path)
    return path


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete ``paths`` (or all that this application has written to the shared folder); frames that read them can't be used any more."""
    for p in [shared_dir(spark)] if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Materialise in the shared folder, so that two readers see one result and lost executors cost little."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
