"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark runs in one JVM, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-tesserae-")
    return _own[app]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` there as Parquet and read it back: computed once, and safe when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/tesserae-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in what runs meanwhile, for rows that hold whole matrices; then the session's setting again."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(max(1, rows)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
