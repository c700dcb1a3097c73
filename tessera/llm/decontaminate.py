"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import map_texts, mix64, shingles, slices, words

#: Words of a shingle, and the weighted-shingle similarity from which a window is a leak of its item.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints may differ: far beyond the ten or so at that similarity.
RADIUS = 17
#: Blocks of a fingerprint's 64 bits. Of six, one differs in at most floor(17 / 6) = 2 bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Bytes of benchmark text that one pass over the documents holds.
SLICE = 4_000_000
#: Windows handled at once.
WINDOWS = 200_000


def fingerprint(weights: np.ndarray) -> np.ndarray:
    """Sums of signed bits, n x 64, to fingerprints: a bit is 1 where its sum is positive."""
    return np.packbits(weights > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16) * 2 - 1


class Length:
    """The items of one number of words, with an index of each block: value to the items (as bits of a word) within the block's radius."""

    def __init__(self, n_words: int, ids: list[int], shapes: list[np.ndarray]):
        self.words, self.span = n_words, max(1, n_words - SHINGLE + 1)
        self.ids, self.shapes = np.array(ids, dtype=np.int64), [np.unique(s, return_counts=True) for s in shapes]
        self.prints = fingerprint(np.stack([signs(s).sum(0) for s in shapes]))
        self.tables = []
        for lo in range(0, len(ids), 64):
            part, at, tables = self.prints[lo : lo + 64], 0, []
            for bits in BLOCKS:
                values = np.arange(1 << bits, dtype=np.uint64)
                table = np.zeros(1 << bits, dtype=np.uint64)
                for k, p in enumerate(part):
                    near = np.bitwise_count(values ^ (p >> np.uint64(at) & np.uint64((1 << bits) - 1))) <= RADIUS // len(BLOCKS)
                    table[near] |= np.uint64(1) << np.uint64(k)
                tables.append(table)
                at += bits
            self.tables.append(tables)

    def candidates(self, prints: np.ndarray):
        """(window, item) of all pairs within the radius."""
        for lo, tables in zip(range(0, len(self.ids), 64), self.tables, strict=True):
            found, at = np.zeros(len(prints), dtype=np.uint64), 0
            for bits, table in zip(BLOCKS, tables, strict=True):
                found |= table[(prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)]
                at += bits
            some = np.flatnonzero(found)
            for k in range(min(64, len(self.ids) - lo)):
                w = some[(found[some] >> np.uint64(k)) & np.uint64(1) > 0]
                w = w[np.bitwise_count(prints[w] ^ self.prints[lo + k]) <= RADIUS]
                for x in w.tolist():
                    yield x, lo + k


@dataclass
class Leak:
    row: int
    item_id: int
    start: int  # word of the document at which the window begins
    words: int
    bits: int
    similarity: float


class Benchmark:
    """Items, indexed; built once in a worker for each slice."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = words(pa.array(texts, pa.string()))
        s, bounds = shingles(w, w.hashes(), SHINGLE)
        groups: dict[int, tuple[list, list]] = {}
        for i, n in enumerate(w.counts().tolist()):
            if n:
                g = groups.setdefault(n, ([], []))
                g[0].append(ids[i])
                g[1].append(s[bounds[i] : bounds[i + 1]])
        self.lengths = [Length(n, *g) for n, g in sorted(groups.items())]
        self.known = np.unique(s)
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.known))))) + 4)
        self.sieve = np.zeros(1 << self.bits, dtype=bool)
        self.sieve[(self.known & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True
        self.short = [x for x in self.lengths if x.words < SHINGLE]

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.sieve[(s & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[k] == s[at]] if len(self.known) else at

    def leaks(self, col: pa.Array) -> list[Leak]:
        """The best window of each text for each item at or over the similarity.

        A window without any shingle of the benchmark has similarity zero to every item, so only windows that hold one
        are fingerprinted. Items of fewer than `SHINGLE` words are one shingle of all their words; windows of theirs are
        hashed the same way.
        """
        w = words(col)
        h = w.hashes()
        s, bounds = shingles(w, h, SHINGLE)
        counts = w.counts()
        s, bounds = s.copy(), bounds
        best: dict[tuple[int, int], Leak] = {}
        hit = self.hits(s)
        if len(hit):
            row = np.searchsorted(bounds, hit, "right") - 1
            for r in np.unique(row[counts[row] >= SHINGLE]).tolist():
                self._text(r, s[bounds[r] : bounds[r + 1]], hit[row == r] - bounds[r], best)
        for length in self.short:
            n = length.words
            acc = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
            for k in range(n):
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(acc)]
            acc = mix64(acc + np.uint64(n))
            at = np.flatnonzero(np.isin(acc, np.concatenate([x[0] for x in length.shapes])))
            row = np.searchsorted(w.bounds, at, "right") - 1
            inside = at + n <= w.bounds[row + 1]
            for a, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                prints = fingerprint(signs(acc[a : a + 1]))
                for _, k in length.candidates(prints):
                    if length.shapes[k][0][0] == acc[a]:
                        key = (r, int(length.ids[k]))
                        best.setdefault(key, Leak(r, key[1], int(a - w.bounds[r]), n, 0, 1.0))
        return [best[k] for k in sorted(best)]

    def _text(self, r: int, s: np.ndarray, hit: np.ndarray, best: dict) -> None:
        for length in self.lengths:
            if length.words < SHINGLE:
                continue
            # a text shorter than the item is one window
            span = min(length.span, len(s))
            # windows that hold a hit
            cover = np.zeros(len(s) + 1, dtype=np.int64)
            np.add.at(cover, np.maximum(0, hit - span + 1), 1)
            np.add.at(cover, hit + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            starts = starts[starts + span <= len(s)]
            for lo in range(0, len(starts), WINDOWS):
                part = starts[lo : lo + WINDOWS]
                # runs of adjoining windows share their running sums
                cuts = np.flatnonzero(np.diff(part) > 1) + 1
                for run in np.split(part, cuts):
                    a, b = int(run[0]), int(run[-1]) + span
                    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(s[a:b]), axis=0, dtype=np.int32)])
                    prints = fingerprint(sums[span:] - sums[:-span])
                    for x, k in length.candidates(prints):
                        similarity = self._similar(s[a + x : a + x + span], length.shapes[k])
                        if similarity >= SIMILARITY:
                            key = (r, int(length.ids[k]))
                            bits = int(np.bitwise_count(prints[x] ^ length.prints[k]))
                            old = best.get(key)
                            if old is None or (similarity, -a - x) > (old.similarity, -old.start):
                                best[key] = Leak(r, key[1], a + x, min(length.words, len(s) + SHINGLE - 1), bits, similarity)

    @staticmethod
    def _similar(window: np.ndarray, shape: tuple[np.ndarray, np.ndarray]) -> float:
        """Sum of the smaller counts of each shingle over the sum of the larger."""
        v, c = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(v, shape[0], assume_unique=True, return_indices=True)
        both = np.minimum(c[i], shape[1][j]).sum()
        return float(both / (c.sum() + shape[1].sum() - both))


_built: dict[int, Benchmark] = {}


def _bench(ids, texts) -> Benchmark:
    key = hash((tuple(ids), tuple(texts)))
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(ids, texts)
    return _built[key]


def item_slices(benchmark: DataFrame) -> list[tuple[list[int], list[str]]]:
    """The benchmark's items in slices of bounded size; the documents are scanned once for each. Items without id or words are left out."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // SLICE
    out = []
    for k in range(n):
        got = sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect())
        if got:
            out.append(([x[0] for x in got], [x[1] for x in got]))
    return out


LEAKS = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): for each row of `docs` and item, the best window at or over the similarity.

    Windows slide by a word and have as many words as the item, or are the whole of a shorter text; ties go to the earlier window. Null texts have no words. Repeated
    rows each give their leaks. No benchmark or no documents give no rows.
    """
    spark, out = docs.sparkSession, None
    for ids, texts in item_slices(benchmark):

        def run(batches, ids=ids, texts=texts):
            b = _bench(ids, texts)
            for batch in slices(batches, limit=1_000_000):
                found = b.leaks(batch.column(1))
                if found:
                    rows = pa.array([x.row for x in found])
                    cols = [batch.column(0).take(rows), *(pa.array([getattr(x, f) for x in found], t) for f, t in (("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("bits", pa.int32()), ("similarity", pa.float64())))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

        part = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, LEAKS)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without a leak; checked in place. Null and empty texts stay, repeated rows share their fate, and
    very long texts are read whole; a text shorter than an item is compared whole, so that most of an item is a leak too."""
    at = docs.columns.index("text")
    for ids, texts in item_slices(benchmark):

        def run(batches, ids=ids, texts=texts):
            b = _bench(ids, texts)
            for batch in slices(batches, limit=1_000_000):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[x.row for x in b.leaks(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = map_texts(docs, run, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best windows of every row of `documents` for each item of `benchmark` at or over the similarity."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, bench)
