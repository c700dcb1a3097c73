"""Byte-level BPE by rank files: encoding with a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import BYTE_SPLIT, default_path
from tessera.llm.words import slices

#: Distinct matches whose ids a worker keeps; at so many it begins anew.
KEPT = 300_000
#: Matches of more bytes are not kept.
KEPT_BYTES = 64
#: Matches that are merged at once.
ROWS = 8192
#: No pair: over every rank and position.
NONE = (1 << 63) - 1
#: Widths of the trees that many short matches are merged in at once; a longer match has a tree of its own.
WIDTHS = (8, 16, 32)
#: BYTE_SPLIT over texts of white space, printable ASCII and accented Latin letters, whose classes are plain, and any other sign.
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7eÀ-ÖØ-öø-ÿ]")


class Ranks:
    """A rank file: tokens by id, and for each two tokens whose bytes together are a token, that token's rank."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.plain = pattern == BYTE_SPLIT
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.kept: dict[str, bytes] = {}

    def matches(self, text: str) -> list[str]:
        return _PLAIN_SPLIT.findall(text) if self.plain and not _OTHER.search(text) else self.find(text)

    def leaves(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of each pair that is a token, NONE for the others."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at] << 32 | place, NONE)

    def merge_many(self, raws: list[bytes], width: int) -> list[bytes]:
        """`merge` of many matches of 2 to `width` bytes, none a token by itself: a tree each, one merge of all at a time."""
        m = len(raws)
        text = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raws]), dtype=np.uint8).reshape(m, width)
        size = np.array([len(r) for r in raws])
        ids = np.array(self.single, dtype=np.int64)[text]
        tree = np.full((m, 2 * width), NONE, dtype=np.int64)
        place = np.arange(width - 1)
        row, at = np.nonzero(place < size[:, None] - 1)
        tree[row, width + at] = self.leaves(ids[row, at], ids[row, at + 1], at)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        ids[np.arange(width) >= size[:, None]] = -1
        after, before = np.tile(np.arange(1, width + 1), (m, 1)), np.tile(np.arange(-1, width - 1), (m, 1))
        tree, ids_, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        live = np.flatnonzero(tree[1 :: 2 * width] != NONE)
        while len(live):
            base, root = live * width, live * 2 * width
            least = tree[root + 1]
            i, new = least & 0xFFFFFFFF, least >> 32
            j = after[base + i]
            k = after[base + j]
            ids_[base + i], ids_[base + j] = new, -1
            after[base + i] = k
            inside = k < size[live]
            before[(base + k)[inside]] = i[inside]
            p = before[base + i]
            first = p >= 0
            right, left = np.full(len(live), NONE), np.full(len(live), NONE)
            right[inside] = self.leaves(new[inside], ids_[(base + k)[inside]], i[inside])
            left[first] = self.leaves(ids_[(base + p)[first]], new[first], p[first])
            tree[root + width + j] = NONE
            tree[root + width + i] = right
            tree[(root + width + p)[first]] = left[first]
            nodes = [width + j, width + i, width + np.where(first, p, i)]
            for _ in range(width.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[root + x] = np.minimum(tree[root + 2 * x], tree[root + 2 * x + 1])
            live = live[tree[root + 1] != NONE]
        left = ids >= 0
        flat, ends = ids[left].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(left.sum(1))]) * 4
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one match: while any adjacent pair is a token, the leftmost pair of the smallest rank is merged.

        Leaf i of the segment tree has rank and place of the pair that begins at byte i, the root the least of all. A merge
        changes three leaves (the merged token's pair, the pair of the token swallowed, the pair before), each up to the root:
        n log n in all, whatever the text.
        """
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        pairs, n = self.pairs, len(raw)
        ids = [self.single[b] for b in raw]
        size = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i, value):
            i += size
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    return
                tree[i] = value

        while (least := tree[1]) != NONE:
            i = least & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            ids[i] = new = least >> 32
            ids[j] = -1
            after[i] = k
            put(j, NONE)
            rank = None
            if k < n:
                before[k] = i
                rank = pairs.get(new << 32 | ids[k])
            put(i, NONE if rank is None else rank << 32 | i)
            if (p := before[i]) >= 0:
                rank = pairs.get(ids[p] << 32 | new)
                put(p, NONE if rank is None else rank << 32 | p)
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, each match of the pattern by itself."""
        found, kept = [self.matches(t) for t in texts], self.kept
        sizes: dict[int, list] = {w: [] for w in WIDTHS}
        long = {}
        for x in set().union(*found).difference(kept):
            raw = x.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                kept[x] = struct.pack("<I", whole)
            elif len(raw) > WIDTHS[-1]:
                ids = self.merge(raw)
                (kept if len(x) <= KEPT_BYTES else long)[x] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                sizes[next(w for w in WIDTHS if len(raw) <= w)].append((x, raw))
        for width, some in sizes.items():
            for i in range(0, len(some), ROWS):
                part = some[i : i + ROWS]
                kept.update(zip([x for x, _ in part], self.merge_many([raw for _, raw in part], width), strict=True))
        out = [b"".join([kept.get(x) or long[x] for x in f] if long else map(kept.__getitem__, f)) for f in found]
        if len(kept) >= KEPT:
            kept.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    """One for each file in a worker."""
    return Ranks(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str = BYTE_SPLIT) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit integers, special tokens' strings as plain text.

    Null and empty texts have no ids; texts are encoded whole, whatever their length; null and repeated doc_ids each keep their
    row, an empty table gives none, other columns are ignored. One narrow pass; a worker keeps the ids of KEPT short matches.
    """

    def run(batches):
        coder = ranks(path, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.encode([x or "" for x in batch.column(1).to_pylist()]), pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str = BYTE_SPLIT) -> DataFrame:
    """(doc_id, ids, raw): the bytes that the ids stand for; null ids are no bytes. An id that the file lacks is an error."""

    def run(batches):
        coder = ranks(path, pattern)
        for batch in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([coder.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, raw binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `documents`."""
    path = default_path("byte_bpe_50k.tiktoken")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
