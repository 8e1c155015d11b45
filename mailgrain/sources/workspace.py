"""Where jobs may write intermediate data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path under the shared folder the cluster names.

    Without that setting the folder lies under the session's warehouse, which
    the driver and the executors share as well; never in a machine's own
    temporary folder.  Inside :func:`scratch` it lies in that folder.
    """
    root = _FOLDER.get() or spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    root = root or f"{spark.conf.get(WAREHOUSE).rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    """A path and its file system, whichever that is."""
    located = spark._jvm.org.apache.hadoop.fs.Path(path)
    return located, located.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this job made."""
    path, files = _located(spark, folder)
    files.delete(path, True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    path, files = _located(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def read_file(spark: SparkSession, file: str) -> str:
    """A small text file."""
    path, files = _located(spark, file)
    opened = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()


def publish(spark: SparkSession, file: str, text: str) -> None:
    """Create a small file that readers see whole or not at all; FileExistsError if it is there."""
    path, files = _located(spark, file)
    part, _ = _located(spark, f"{file}.{uuid.uuid4().hex}.part")
    out = files.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(path) or not files.rename(part, path):
        files.delete(part, False)
        raise FileExistsError(file)


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[None]:
    """All that is stored inside goes into one folder, deleted at the end; no lazy result may outlive it."""
    folder = shared_folder(spark, purpose)
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        remove_folder(spark, folder)


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows as a table in the shared folder and read them back."""
    folder = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
