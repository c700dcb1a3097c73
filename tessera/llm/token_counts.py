"""Token counts by a digest cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.tokens import coder, default_path, version_digest
from tessera.llm.words import map_texts, slices

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Digests up to which a side of a join is broadcast (about 30 MB); beyond, both are shuffled.
BROADCAST_ROWS = 500_000


def _cache(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _bounded(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, limit: int = 1024) -> DataFrame:
    """Tokens of each whole text: (doc_id, n_bytes, n_tokens, over_limit).

    The normalised content is the text, a null one as empty; no more may be made equal, as a byte-level tokenizer tells all else
    apart. Contents are joined by SHA-256 with the counts stored in the Parquet table `cache_path` for this tokenizer's version;
    each distinct content missing there is encoded once, and its count appended before the result is read. Only digests and
    ids are compared: a text is read by an encoder only if its row was chosen (of a content the smallest doc_id, nulls
    first), so a warm cache reads none and many copies are not gathered anywhere. Empty texts have no tokens. Null and
    repeated doc_ids each keep their row; very long texts are encoded whole; other columns are ignored.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest, at = F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("chosen")
    known = _cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest").distinct()
    misses = store.stage(docs.select(digest, at).groupBy("digest").agg(F.min("chosen").alias("chosen")).join(known, "digest", "left_anti"), "count-misses")
    fresh = docs.select(digest, at, text.alias("text")).join(_bounded(misses), ["digest", "chosen"], "left_semi").select("digest", "text")

    def encode(batches):
        import pyarrow as pa

        c = coder(tokenizer_path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * batch.num_rows, pa.string()), pa.array([len(c.ids(x)) >> 2 for x in batch.column(1).to_pylist()], pa.int64())],
                names=["digest", "tokenizer", "n_tokens"],
            )

    map_texts(fresh, encode, CACHE_SCHEMA).dropDuplicates(["digest"]).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    stored = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest)
    return sized.join(_bounded(stored), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `documents`; each call begins with an empty cache of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, default_path("byte_bpe_50k.json"), store.fresh_path(spark, "token-counts"))
