"""Readers of the columnar tables and the shared staging area."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
_leaving: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; a file or a directory of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Taken from ``spark.checkpoint.dir``. Where that is unset, a run on a single
    machine gets a folder of its process; on a cluster it is an error, since
    executors would write to disks of their own.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="verisieve-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def stage_home(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/verisieve/{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_stages(spark: SparkSession) -> None:
    """Remove all that this application staged; call it once results are written, since they read staged tables."""
    _remove(spark, stage_home(spark))


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end; results that read it must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: the rows survive the loss of any executor, and what
    follows starts from files instead of from a long plan.
    """
    spark = df.sparkSession
    home = stage_home(spark)
    if home not in _leaving:
        # What no one clears goes when the driver ends.
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _leaving.add(home)
    path = f"{home}/{label}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files behind a staged frame that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(spark, folder)
