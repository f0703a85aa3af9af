"""Materialise an intermediate DataFrame in the shared folder of the cluster.

A prepared ledger feeds many branches (monthly sums, counterparty sums, partner
search, percentiles).  Writing it once as parquet cuts the lineage, keeps column
pruning for every later branch and survives the loss of executors.

The tables of a session lie in one folder of their own, which is deleted when the
session's JVM ends; `clear` deletes it earlier.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.

    Only where it is unset and the master is local, so that driver and executors are
    one process, a scratch folder stands in; a cluster without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="uwspark-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
    return _LOCAL_DIR[0]


def _session_dir(spark: SparkSession) -> tuple[str, object, object]:
    """Folder of this session's tables with its file system and path object."""
    where = f"{shared_dir(spark).rstrip('/')}/uwspark-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return where, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back."""
    spark = df.sparkSession
    where, files, path = _session_dir(spark)
    table = f"{where}/{uuid.uuid4().hex}"
    df.write.parquet(table)
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(table)


def folder(spark: SparkSession) -> str:
    """A new folder of this session, deleted with it; for sinks that write several tables."""
    where, files, path = _session_dir(spark)
    files.deleteOnExit(path)
    return f"{where}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete the staged tables of this session."""
    forget()
    _, files, path = _session_dir(spark)
    files.delete(path, True)


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A staged table several queries of one session read; written by the first of them.

    It is tied to the application, so a new session never sees the table of an old one.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _SHARED:
        _SHARED[key] = stage(build())
    return _SHARED[key]


def forget() -> None:
    """Drop the references, so that the next query builds its inputs again."""
    _SHARED.clear()
