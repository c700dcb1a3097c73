"""Vector bin packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import coder, default_path
from tessera.llm.words import map_texts, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Ids, and pieces, held by one task while it packs.
POOL_IDS, POOL_PIECES = 2_000_000, 50_000

#: A piece of a document: key, all its ids, start, end, number of ids, and the first that bears loss.
Piece = tuple


def loss(piece: Piece) -> int:
    """Loss-bearing tokens of a piece: those from the document's first one on."""
    return max(0, piece[3] - max(piece[2], piece[5]))


class Pool:
    """Pieces by their demand (tokens, loss-bearing tokens): equal demands are one class, served in order of arrival."""

    def __init__(self):
        self.place: dict[tuple[int, int], int] = {}
        self.queue: list[deque] = []
        self.tokens, self.loss, self.many = np.zeros(64), np.zeros(64), np.zeros(64, dtype=np.int64)
        self.ids = self.pieces = 0

    def add(self, piece: Piece, first: bool = False) -> None:
        demand = (piece[3] - piece[2], loss(piece))
        k = self.place.get(demand)
        if k is None:
            k = self.place[demand] = len(self.queue)
            self.queue.append(deque())
            if k == len(self.many):
                self.tokens, self.loss, self.many = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.loss, self.many))
            self.tokens[k], self.loss[k] = demand
        (self.queue[k].appendleft if first else self.queue[k].append)(piece)
        self.many[k] += 1
        self.ids += demand[0]
        self.pieces += 1

    def take(self, k: int) -> Piece:
        piece = self.queue[k].popleft()
        self.many[k] -= 1
        self.ids -= piece[3] - piece[2]
        self.pieces -= 1
        return piece

    def best(self, room: np.ndarray, caps: np.ndarray) -> int | None:
        """The class that fits and whose demand has the largest dot product with the room, each limit by its capacity."""
        n = len(self.queue)
        fits = np.flatnonzero((self.many[:n] > 0) & (self.tokens[:n] <= room[0]) & (self.loss[:n] <= room[2]))
        if not len(fits):
            return None
        weight = room / caps / caps
        return int(fits[(weight[0] * self.tokens[fits] + weight[1] + weight[2] * self.loss[fits]).argmax()])

    def largest(self) -> int:
        n = len(self.queue)
        return int(np.where(self.many[:n] > 0, self.tokens[:n], -1.0).argmax())


class Packer:
    """Fills one open sequence at a time from a bounded pool of pieces under three limits.

    The next piece is, of those that fit, one whose demand vector (tokens, segments, loss-bearing tokens, each by its
    limit) has the largest dot product with the capacity left, ties to the class that came first. If none fits, the largest
    is cut to the room that is left. What remains open at the very end is cut into powers of two, which need no padding.
    """

    def __init__(self, tokens: int, segments: int, most_loss: int):
        self.caps = np.array([tokens, segments, most_loss], dtype=np.float64)
        self.pool = Pool()

    def add(self, key, ids: memoryview, total: int, first_loss: int) -> Iterator[list[Piece]]:
        """Full sequences that one document gives by itself; its rest goes to the pool."""
        at, cap = 0, int(self.caps[0])
        while total - at >= cap and loss(piece := (key, ids, at, at + cap, total, first_loss)) <= self.caps[2]:
            yield [piece]
            at += cap
        while at < total:
            piece = (key, ids, at, min(at + cap, total), total, first_loss)
            self.pool.add(piece)
            at = piece[3]

    @staticmethod
    def cut(piece: Piece, room: np.ndarray) -> int:
        """Tokens of the piece's beginning that the room takes."""
        free = max(0, min(piece[3], piece[5]) - piece[2])
        return int(min(piece[3] - piece[2], room[0], free + room[2]))

    def drain(self, last: bool) -> Iterator[list[Piece]]:
        """Sequences from the pool; unless `last`, the pieces of one that can't be filled go back to it."""
        pool = self.pool
        while pool.pieces:
            room, out = self.caps.copy(), []
            while pool.pieces and room[0] >= 1 and room[1] >= 1:
                k = pool.best(room, self.caps)
                piece = pool.take(pool.largest() if k is None else k)
                n = self.cut(piece, room)
                if n < 1:
                    pool.add(piece, first=True)
                    break
                head = (*piece[:3], piece[2] + n, *piece[4:])
                if n < piece[3] - piece[2]:
                    pool.add((*piece[:2], piece[2] + n, *piece[3:]), first=True)
                out.append(head)
                room -= (n, 1, loss(head))
            if room[0] < 1:
                yield out
            elif not last and not pool.pieces:
                self.pool = Pool()
                for piece in out:
                    self.pool.add(piece)
                return
            else:
                yield from powers(out)


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces in sequences whose lengths are powers of two, longest first."""
    rest, queue = sum(x[3] - x[2] for x in pieces), deque(pieces)
    while rest:
        size = 1 << (rest.bit_length() - 1)
        rest -= size
        out = []
        while size:
            piece = queue.popleft()
            n = min(size, piece[3] - piece[2])
            out.append((*piece[:3], piece[2] + n, *piece[4:]))
            if piece[2] + n < piece[3]:
                queue.appendleft((*piece[:2], piece[2] + n, *piece[3:]))
            size -= n
        yield out


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, max_tokens: int = 4096, max_segments: int = 512, max_loss: int = 4096, prompt: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens).

    Each partition of the input is packed by itself, without a shuffle, from a pool of bounded size; what a
    partition can't fill ends in sequences of a power of two, so no sequence needs padding. Sequence ids are
    the partition's number times 2^32 plus a count. Each limit is at least 1. `prompt` names a column whose text goes before each document's and
    bears no loss, as a question before its answer; without one only a document's first token bears none, as nothing
    predicts it, so that on plain documents `max_loss` binds only where it is well under `max_tokens`.

    A null text (or prompt) is an empty one; the end id is always there. Long texts are cut, whole. Null and repeated doc_ids keep
    their pieces. Other columns are ignored. No documents give no pieces.
    """

    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits of a sequence must be at least 1")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        c = coder(tokenizer_path)
        base = TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype="<u4").tobytes()
        packer, n = Packer(max_tokens, max_segments, max_loss), 0
        names = [x.split()[0] for x in PIECES.split(", ")]

        def rows(sequences):
            nonlocal n
            cols = [[] for _ in names]
            for sequence in sequences:
                at = 0
                for piece in sequence:
                    key, ids, a, b, total, _ = piece
                    for col, v in zip(cols, (key, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), total, base + n, at, loss(piece)), strict=True):
                        col.append(v)
                    at += b - a
                n += 1
                if len(cols[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)
                    cols = [[] for _ in names]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

        def full():
            for batch in slices(batches):
                prompts = batch.column(2).to_pylist() if prompt else [None] * batch.num_rows
                for key, text, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), prompts, strict=True):
                    lead = c.ids(before) if before else b""
                    ids = memoryview(lead + (c.ids(text) if text else b"") + end)
                    yield from packer.add(key, ids, len(ids) >> 2, max(1, len(lead) >> 2))
                    if packer.pool.ids > POOL_IDS or packer.pool.pieces > POOL_PIECES:
                        yield from packer.drain(last=False)
            yield from packer.drain(last=True)

        yield from rows(full())

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(prompt).alias("prompt")] if prompt else [])), run, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every row of `documents` in sequences of 4,096 tokens, by the word-level tokenizer."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("word_bpe_49k.json"))
