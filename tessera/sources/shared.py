"""The folder that all executors share, for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task of `dealt`, and rows up to which `looked_up` sends a table to all.
TASK_ROWS, BROADCAST_ROWS = 500_000, 200_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, one machine (tests) takes a temporary folder and a cluster refuses."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder: its rows stay where they are, whatever is computed from them."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """`df` of about `rows` rows dealt out by `key`, so many to a task, in the session's number of tasks at least: a task's memory does not grow with the table."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(tasks, *key)


def looked_up(small: DataFrame) -> DataFrame:
    """`small` as the side of a join that is held as a hash table: sent to all if it is of few rows, else dealt out by the key. The other side is not sorted, so a key that fills it costs no memory."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small.hint("shuffle_hash")


def worked_out(df: DataFrame, **made: Column) -> DataFrame:
    """`df` and the columns `made`, each worked out once a row: later filters and steps, which would else repeat it at each use, don't pass the generator."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return df.select(*rest, F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("_made")).select(*rest, "_made.*")
