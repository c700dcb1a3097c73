"""Directly addressable codes: ids in chunk levels with continuation bitmaps and rank directories, in files of their own."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.tokens import coder, default_path
from tessera.llm.words import map_texts, slices

MAGIC = b"DAC2"
#: Magic, shard, ids of the shard before this file, ids, documents.
HEADER = "<4sIQQQ"
#: Bits of each level's chunk; a value that does not end at a level goes on at the next.
CHUNKS = (8, 8, 16)
#: Ids in one file, but that a document is never divided.
FILE_IDS = 1 << 21
#: Ids found by one vectorised access.
ACCESS_IDS = 1 << 18


def encode(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, shard: int = 0, before: int = 0) -> bytes:
    """A file of documents' ids. Layout: header, documents (id, is null, first id's place), then each level: its values, its
    continuation bitmap in 64-bit words, and the rank directory, the ones before each word."""
    n = len(ids)
    out = [struct.pack(HEADER, MAGIC, shard, before, n, len(doc_ids)), np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes()]
    rest = ids.astype(np.uint32)
    for k, bits in enumerate(CHUNKS):
        final = k == len(CHUNKS) - 1
        values = (rest & np.uint32((1 << bits) - 1)).astype("<u1" if bits == 8 else "<u2")
        more = np.zeros(len(rest), dtype=bool) if final else (rest >> np.uint32(bits)) > 0
        packed = np.packbits(more, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed.view("<u8")), dtype=np.int64)]).astype("<u4")
        out += [struct.pack("<QQQ", len(values) * values.itemsize, len(packed), len(ranks) * 4), values.tobytes(), packed.tobytes(), ranks.tobytes()]
        rest = rest[more] >> np.uint32(bits)
    return b"".join(out)


class Reader:
    """Random access to a file (bytes or a memory map). Bytes after its end are not read."""

    def __init__(self, image):
        view = memoryview(image)
        at = struct.calcsize(HEADER)
        if len(view) < at or bytes(view[:4]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        _, self.shard, self.before, self.n, docs = struct.unpack(HEADER, view[:at])

        def take(dtype, count):
            nonlocal at
            a = np.frombuffer(view, dtype=dtype, count=count, offset=at)
            at += a.nbytes
            return a

        ids, null = take("<i8", docs), take(np.uint8, docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.places = take("<i8", docs + 1)
        self.levels = []
        for bits in CHUNKS:
            sizes = struct.unpack("<QQQ", view[at : at + 24])
            at += 24
            self.levels.append((bits, take("<u1" if bits == 8 else "<u2", sizes[0] // (1 if bits == 8 else 2)), take("<u8", sizes[1] // 8), take("<u4", sizes[2] // 4)))

    def get(self, where) -> np.ndarray:
        """The ids at the given places, each by ranks from level to level, without decoding any other."""
        at = np.asarray(where, dtype=np.int64)
        out, who, shift = np.zeros(len(at), dtype=np.uint32), None, 0
        for bits, values, more, ranks in self.levels:
            part = values[at].astype(np.uint32) << np.uint32(shift)
            if who is None:
                out |= part
            else:
                out[who] |= part
            word, bit = more[at >> 6], (at & 63).astype(np.uint64)
            on = np.flatnonzero((word >> bit) & np.uint64(1))
            if not len(on):
                break
            below = word[on] & ((np.uint64(1) << bit[on]) - np.uint64(1))
            who = on if who is None else who[on]
            at, shift = ranks[at[on] >> 6].astype(np.int64) + np.bitwise_count(below), shift + bits
        return out

    def document(self, i: int) -> np.ndarray:
        """Document i's ids."""
        return self.get(np.arange(self.places[i], self.places[i + 1]))

    def crcs(self) -> list[int]:
        """CRC-32 of each document's ids, read by access in bounded runs of documents; a longer one in parts."""
        out, places = [], self.places.tolist()
        i = 0
        while i < len(places) - 1:
            j = i + 1
            while j < len(places) - 1 and places[j + 1] - places[i] <= ACCESS_IDS:
                j += 1
            if places[j] - places[i] > ACCESS_IDS:
                crc = 0
                for a in range(places[i], places[j], ACCESS_IDS):
                    crc = zlib.crc32(self.get(np.arange(a, min(a + ACCESS_IDS, places[j]))).astype("<u4").tobytes(), crc)
                out.append(crc)
            else:
                raw = memoryview(self.get(np.arange(places[i], places[j])).astype("<u4").tobytes())
                out += [zlib.crc32(raw[4 * (a - places[i]) : 4 * (b - places[i])]) for a, b in zip(places[i:j], places[i + 1 : j + 1], strict=True)]
            i = j
        return out


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 2) -> None:
    """Write all documents' ids, in ascending doc_id (nulls first, ties by text), as files in the folder `path`.

    Texts are dealt out by ranges of doc_id, so a shard is a range and its files follow each other; each file tells its
    shard and how many ids that has before it. Files are written by Spark's own committer, one for each image, so that
    any store takes them and a lost executor leaves none behind; a line break that it adds is after the file's end.
    A null text is an empty one: its end id alone. Null and repeated doc_ids keep their rows, other columns are ignored, and no
    documents give no files.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        c, shard = coder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        before, held, keys, raw = 0, 0, [], []

        def image():
            lengths = np.array([len(x) >> 2 for x in raw], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([encode(np.frombuffer(b"".join(raw), dtype="<u4"), keys, lengths, shard, before)], pa.binary())], names=["image"])

        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (c.ids(text) if text else b"") + end
                keys.append(key)
                raw.append(ids)
                held += len(ids) >> 2
                if held >= FILE_IDS:
                    yield image()
                    before, held, keys, raw = before + held, 0, [], []
        if keys:
            yield image()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    images = map_texts(ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))), run, "image binary")
    # text files hold a string's bytes as they are
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(content) of each file of a folder that `write_tokens` wrote; each is about 3 bytes for each of `FILE_IDS` ids."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > 1).select("content")


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard. The driver gets one count for each shard, of which there are as many as partitions wrote."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            heads = [struct.unpack_from(HEADER, x.as_buffer()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([h[1] for h in heads], pa.int64()), pa.array([h[3] for h in heads], pa.int64())], names=["shard", "n"])

    counts = files(spark, path).mapInArrow(run, "shard long, n long").groupBy("shard").agg(F.sum("n")).collect()
    bases, total = {}, 0
    for shard, n in sorted(tuple(r) for r in counts):
        bases[shard] = total
        total += n
    return bases


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: (doc_id, start, n_tokens, ids_crc32)."""
    bases = _bases(spark, path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                r = Reader(content.as_buffer())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.doc_ids, pa.int64()), pa.array(r.places[:-1] + (bases[r.shard] + r.before), pa.int64()), pa.array(np.diff(r.places), pa.int64()), pa.array(r.crcs(), pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def get_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, id) of the ids at the given places (column `place`), counted over all documents; only their levels are read.

    Places are dealt to files by an equi-join on blocks of `FILE_IDS`, of which a file touches few. Places out of range or null
    give no row; a repeated one gives one for each time.
    """
    bases = _bases(spark, path)

    def bounds(batches):
        import pyarrow as pa

        for batch in batches:
            heads = [struct.unpack_from(HEADER, x.as_buffer()) for x in batch.column(0)]
            start = [bases[h[1]] + h[2] for h in heads]
            yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), pa.array([a + h[3] for a, h in zip(start, heads, strict=True)], pa.int64()), batch.column(0)], names=["start", "stop", "content"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, content, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(Reader(content.as_buffer()).get(np.array(wanted) - start), pa.int64())], names=["place", "id"])

    spans = files(spark, path).mapInArrow(bounds, "start long, stop long, content binary")
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / FILE_IDS), F.floor((F.col("stop") - 1) / FILE_IDS))))
    asked = places.where(F.col("place") >= 0).select("place", F.floor(F.col("place") / FILE_IDS).alias("block")).groupBy("block").agg(F.collect_list("place").alias("places"))
    inside = F.filter("places", lambda x: (x >= F.col("start")) & (x < F.col("stop")))
    return spans.join(asked, "block").select("start", "content", inside.alias("wanted")).where(F.size("wanted") > 0).mapInArrow(run, "place long, id long")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of `documents`, read back from files in the shared folder."""
    path = store.fresh_path(spark, "dac")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path)
