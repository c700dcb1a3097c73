"""T4: writes that happen once, whatever is sent or run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(df: DataFrame, path: str) -> bool:
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(at)


def write_batch(batch: DataFrame, number: int, path: str, key: list[str], order: list[str]) -> None:
    """The rows of `batch` whose key is not in the table at `path` yet: of a key's rows in the batch the first in `order`.

    A batch has a folder of its own by its number, which running it again replaces, so a batch that failed half way or is
    replayed leaves what one run leaves. Keys with a null are one key. Rows are found by a shuffled join on the key.
    """
    row = F.struct(*[F.col(c) for c in batch.columns])
    first = batch.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")
    if _exists(batch, path):
        before = batch.sparkSession.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(path).where(F.col("batch") != number)
        same = [first[k].eqNullSafe(before[k]) for k in key]
        first = first.join(before.select(*key), same, "left_anti")
    first.write.mode("overwrite").parquet(f"{path}/batch={number}")


def write_once(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str]) -> None:
    """Drain `stream` into the table at `path` by `write_batch`: one row a key over all batches and runs."""
    put = lambda batch, number: write_batch(batch, number, path, key, order)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
