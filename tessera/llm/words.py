"""Vectorised words over Arrow string columns: spans, hashes and bounded slices, without Python strings."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 2_000_000
#: Bytes whose word hashes are computed at once.
HASH_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(n + 1024, _P if kind == "p" else _PINV, dtype=np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if n <= 4 * HASH_BYTES:
            _powers[kind] = have
    return have


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; nulls read as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _release() -> None:
    """Give freed memory back to the system, which the allocators else keep for the worker's life."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        yield batch.slice(start)
        _release()


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over texts. Spark bounds its batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch), `slices` those of `run`."""
    return df.mapInArrow(run, schema)


@dataclass
class Words:
    data: np.ndarray  # bytes with A-Z lower-cased
    start: np.ndarray  # of each word
    end: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + HASH_BYTES, "right")))
            piece = self.data[base : self.end[j - 1]].astype(np.uint64)
            n = len(piece)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((piece + np.uint64(1)) * _pow("p", n)[:n], out=sums[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = mix64((sums[e] - sums[s]) * _pow("i", n)[s] + (e - s).astype(np.uint64))
            i = j
        return out


def words(col: pa.Array) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of every text, A-Z lower-cased."""
    raw, off = buffers(col)
    data = LOWER[raw]
    space = SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, off).astype(np.int64))


def shingles(w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size`-word shingles, repeats included, and their bounds by text; a shorter text has one of all its words, an empty one none."""
    counts = w.counts()
    have = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(have)]).astype(np.int64)
    n = len(h)
    out = np.empty(bounds[-1], dtype=np.uint64)
    text = np.repeat(np.arange(len(counts)), have)
    first = w.bounds[:-1][text] + (np.arange(len(text)) - bounds[:-1][text])
    full = counts[text] >= size
    acc = np.zeros(int(full.sum()), dtype=np.uint64)
    f = first[full]
    for k in range(size):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[f + k]
    out[full] = mix64(acc + np.uint64(size))
    for i in np.flatnonzero(~full):
        a, b = w.bounds[text[i]], w.bounds[text[i] + 1]
        acc1 = np.zeros(1, dtype=np.uint64)
        for k in range(a, b):
            acc1 = acc1 * np.uint64(0xD6E8FEB86659FD93) + h[k : k + 1]
        out[i] = mix64(acc1 + np.uint64(b - a))[0]
    return out, bounds


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
