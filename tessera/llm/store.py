"""Shared-folder staging: written tables cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Where that is unset, one machine (tests) takes a temporary folder; a cluster, whose executors would each write to a disk
    of their own, refuses.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        base = _own[app]
    return f"{base.rstrip('/')}/tessera-{app}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and return the table read back from there."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard_all(spark: SparkSession) -> None:
    """Delete whatever this application has staged; results that still read it must be written before."""
    discard(spark, shared_dir(spark))


def staged_path(df: DataFrame) -> str:
    """Folder of a table that `stage` returned."""
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""
