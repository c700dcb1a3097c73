"""Language-model scores of texts from Elias-Fano n-gram tries, sharded by context."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.elias_fano import Trie
from tessera.llm.toxicity import fold
from tessera.llm.words import mix64, slices, words

#: Text bytes of a batch, whose words are looked up together.
BATCH = 8_000_000
#: Tokens of a shard at most, on average.
SHARD_TOKENS = 2_000_000
#: A context's weight of the lower order is its count to this power.
BACKOFF = 0.85
END = np.uint64(0x5EED5EED5EED5EED)
#: Words' ids are from 1; this is what stands before a text.
BEGIN_ID = 0

BLOBS = "batch long, shard int, blob binary"
#: A shard of the model with what is asked of it: `image` is the trie. Under a shard below zero, batches' own rows go along.
SHARDS = "shard int, image binary, batches array<long>, asks array<binary>"


def _pack(x) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=9).compress(pickle.dumps(x, protocol=5))


def _unpack(b):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))  # noqa: S301  written by this module


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["batch", "shard", "blob"])


def _small(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _planes(x: np.ndarray) -> tuple[str, np.ndarray]:
    """An array by byte planes, of which the high ones hardly vary and so compress away."""
    return x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)


def _joined(x: tuple[str, np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(x[1].T).view(x[0]).ravel()


def tokens(docs: DataFrame, learns) -> DataFrame:
    """Batches of documents as ids into the batch's own words: what later steps read instead of texts. `learns`: rows to learn from.

    The column shard has the batch's tokens.
    """

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(slices(batches, limit=BATCH)):
            w = words(batch.column(1))
            h, counts = w.hashes(), w.counts()
            total = counts + 1
            out = np.empty(int(total.sum()), dtype=np.uint64)
            ends = np.cumsum(total) - 1
            inner = np.ones(len(out), dtype=bool)
            inner[ends] = False
            out[inner], out[ends] = h, END
            vocabulary, at = np.unique(out, return_inverse=True)
            learn = np.array(batch.column(2).to_pylist(), dtype=bool)
            seen = np.bincount(at, np.repeat(learn, total), minlength=len(vocabulary)).astype(np.int64)
            # the commonest words first, so that most ids are small
            order = np.argsort(-np.bincount(at, minlength=len(vocabulary)), kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            vocabulary, seen, at = vocabulary[order], seen[order], place[at]
            yield _rows([(base + n, len(out) if len(out) < 1 << 31 else (1 << 31) - 1, _pack((batch.column(0).to_pylist(), learn, total, vocabulary, _small(seen), _planes(_small(at)))))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learns, F.lit(False)).alias("learn")).mapInArrow(run, BLOBS)


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(x.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) % shards


def count_words(table: DataFrame, shards: int) -> DataFrame:
    """For each batch and shard, corpus counts and ids of the batch's words there; batch -1 has the shard's totals.

    A batch sends each of its words once, to the shard of the word's hash, so no common word weighs on a shard.
    """

    def send(batches):
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                _, _, _, vocabulary, seen, _ = _unpack(blob.as_py())
                to = _shard(vocabulary, shards)
                yield _rows([(b, s, _pack((vocabulary[to == s], _small(seen[to == s])))) for s in range(shards)])

    def add(group: pa.Table) -> pa.Table:
        shard = group.column(1)[0].as_py()
        parts = sorted(zip(group.column(0).to_pylist(), group.column(2).to_pylist(), strict=True))
        got = [_unpack(x) for _, x in parts]
        all_words, at = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[1] for x in got]), minlength=len(all_words)).astype(np.int64)
        # the commonest words first, so that most ids are small
        rank = np.empty(len(total), dtype=np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        ids = (rank * shards + shard + 1).astype(np.uint64)
        rows, lo = [], 0
        for (b, _), x in zip(parts, got, strict=True):
            k = at[lo : lo + len(x[0])]
            lo += len(x[0])
            rows.append((b, shard, _pack((_small(total[k]), _planes(ids[k])))))
        rows.append((-1, shard, _pack((int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))))
        return pa.Table.from_batches([_rows(rows)])

    return table.mapInArrow(send, BLOBS).groupBy("shard").applyInArrow(add, BLOBS)


def unigram(c: np.ndarray, n: int, v: int, n1: int, n2: int) -> np.ndarray:
    """Probabilities under absolute discounting; all that was not seen shares one type, which gets the discounts."""
    if not n:
        return np.ones(len(c))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return np.where(c > 0, (c - d) / n, d * v / n)


def _ask(v: np.ndarray, c: np.ndarray, w: np.ndarray, p: np.ndarray, of: np.ndarray, learn: np.ndarray) -> bytes:
    """What one batch asks of a shard, from its occurrences sorted by context v and word w: the distinct contexts with their
    counts, the distinct words with their probabilities, the pairs by places in these, how often each occurs and in which
    documents, and which of these are learnt from."""
    contexts, first, x = np.unique(v, return_index=True, return_inverse=True)
    vocabulary, one, y = np.unique(w, return_index=True, return_inverse=True)
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    i = np.flatnonzero(new)
    per_context = np.bincount(x[i], minlength=len(contexts))
    parts = (np.diff(contexts, prepend=np.uint64(0)), c[first], per_context, np.diff(vocabulary, prepend=np.uint64(0)), y[i], np.diff(np.append(i, len(x))), of)
    return _pack(([_planes(_small(q)) for q in parts], _planes(p[one].astype(np.float16)), np.packbits(learn), len(learn)))


def _asked(blob: bytes) -> tuple:
    parts, p, learn, n = _unpack(blob)
    contexts, c, per_context, vocabulary, y, many, of = map(_joined, parts)
    contexts, vocabulary = np.cumsum(contexts, dtype=np.uint64), np.cumsum(vocabulary, dtype=np.uint64)
    x = np.repeat(np.arange(len(contexts)), per_context)
    return contexts, c.astype(np.float64), vocabulary, _joined(p).astype(np.float64), x, y.astype(np.int64), many.astype(np.int64), of, np.unpackbits(learn, count=n)


def _merged(each: list[np.ndarray], *values: list[np.ndarray]) -> tuple:
    """Sorted distinct of several arrays, the place there of each one's elements, and the values of the distinct."""
    distinct, first, at = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
    return (distinct, np.split(at, np.cumsum([len(e) for e in each])[:-1]), *(np.concatenate(v)[first] for v in values))


def build_shard(asks: list[bytes]) -> bytes:
    """The trie of a shard: all pairs that batches learnt, with smoothed probabilities, and the weights of their contexts."""
    got = [_asked(b) for b in asks]
    contexts, at_v, c = _merged([g[0] for g in got], [g[1] for g in got])
    vocabulary, at_w, p = _merged([g[2] for g in got], [g[3] for g in got])
    keys = np.concatenate([at_v[k][g[4]] * len(vocabulary) + at_w[k][g[5]] for k, g in enumerate(got)])
    seen = np.concatenate([np.add.reduceat(g[8][g[7]].astype(np.int64), np.cumsum(g[6]) - g[6]) for g in got])
    held = seen > 0
    pairs, at = np.unique(keys[held], return_inverse=True)
    count = np.bincount(at, seen[held], minlength=len(pairs)) if len(pairs) else np.zeros(0)
    x, y = pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary))
    m = c**BACKOFF
    total = np.maximum(c + m, 1e-300)
    some = np.flatnonzero(c > 0)
    kept, place = contexts[some], np.cumsum(c > 0) - 1
    with np.errstate(divide="ignore"):
        return Trie.build(kept, np.log10(m / total)[some], vocabulary, place[x], y, np.log10((count + m[x] * 10 ** p[y]) / total[x]))


def shards(asked: DataFrame, many: int) -> DataFrame:
    """The model: for each shard its trie, beside what the batches ask of it."""

    def build(group: pa.Table) -> pa.Table:
        parts = sorted(zip(group.column("batch").to_pylist(), group.column("shard").to_pylist(), group.column("blob").to_pylist(), strict=True))
        asks, shard = [x[2] for x in parts], parts[0][1]
        cols = [pa.array([shard], pa.int32()), pa.array([build_shard(asks) if shard >= 0 else None], pa.binary()), pa.array([[x[0] for x in parts]], pa.list_(pa.int64())), pa.array([asks], pa.list_(pa.binary()))]
        return pa.Table.from_arrays(cols, names=["shard", "image", "batches", "asks"])

    to = F.when(F.col("shard") < 0, -1 - F.pmod("batch", F.lit(many))).otherwise(F.col("shard"))
    return asked.withColumn("to", to).groupBy("to").applyInArrow(lambda t: build(t.select(["batch", "shard", "blob"])), SHARDS)


def answers(model: DataFrame) -> DataFrame:
    """For each batch and shard, the sums of log-probabilities of the batch's documents, read from the shard's trie; batches' own rows as they are."""

    def run(batches):
        for batch in batches:
            for shard, image, asking, asks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if shard < 0:
                    for b, blob in zip(asking, asks.values, strict=True):
                        yield _rows([(b, shard, blob.as_py())])
                    continue
                trie = Trie(image.as_buffer())
                for b, blob in zip(asking, asks.values, strict=True):
                    contexts, _, vocabulary, p, x, y, many, of, learn = _asked(blob.as_py())
                    logp = trie.log_p(contexts, x, vocabulary, y, p)
                    sums = np.bincount(of, np.repeat(logp, many), minlength=len(learn))
                    some = np.flatnonzero(sums)
                    yield _rows([(b, shard, _pack((_small(some), sums[some])))])

    return model.select("shard", "image", "batches", "asks").mapInArrow(run, BLOBS)


def score(docs: DataFrame, learns, held_out, model_path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A bigram model: p(w | v) = (c(vw) + m p(w)) / (c(v) + m) with m = c(v) ^ `BACKOFF`, over p(w) by absolute
    discounting. Batches send each distinct bigram, with its corpus-level word counts, to the shard of its context; there
    the training counts of all batches make the shard's trie, from whose image every bigram is read; with `model_path` the
    images are written there first, each beside what is asked of it, and read again. A context
    that is more than half a shard's share of all tokens is dealt out by its successors, which its smoothing allows; there
    are as many shards as keep a share under `SHARD_TOKENS`. Nothing but five totals reaches the driver.

    A null text is an empty one, whose only token is its end. Null and repeated doc_ids keep their rows, very long texts are
    scored whole, other columns are ignored, and no documents give no rows. With nothing to learn from, every score is 0.
    """
    spark = docs.sparkSession
    table = store.stage(tokens(docs, learns), "lm-tokens")
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(table.agg(F.sum("shard")).first()[0] or 0) // SHARD_TOKENS))
    counted = store.stage(count_words(table, many), "lm-counts")
    sums = np.array([_unpack(r["blob"]) for r in counted.where("batch = -1").select("blob").collect()] or [(0, 0, 0, 0)], dtype=object)
    n, v, n1, n2 = (int(x) for x in sums.sum(0))
    starts = docs.where(F.coalesce(learns, F.lit(False))).count()

    def bigrams(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, learn, total, vocabulary, _, at = _unpack(left.column("blob")[0].as_py())
        at = _joined(at)
        b = key[0].as_py()
        c, word = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.uint64)
        to = _shard(vocabulary, many)
        for s, blob in zip(right.column("shard").to_pylist(), right.column("blob").to_pylist(), strict=True):
            got = _unpack(blob)
            c[to == s], word[to == s] = got[0], _joined(got[1])
        p = np.log10(unigram(c, n, v, n1, n2))
        base = np.log10((c + 1) / (n + v + 1))
        of = np.repeat(np.arange(len(total)), total)
        rows = [(b, -1, _pack((ids, learn, total, np.bincount(of, c[at] > 0, minlength=len(total)), np.bincount(of, base[at], minlength=len(total)))))]
        first = np.concatenate([[0], np.cumsum(total)[:-1]])
        before, before_count = np.empty(len(at), dtype=np.uint64), np.empty(len(at), dtype=np.int64)
        before[1:], before_count[1:] = word[at[:-1]], c[at[:-1]]
        before[first], before_count[first] = BEGIN_ID, starts
        w = word[at]
        hot = before_count * 2 * many > n
        to = _shard(np.where(hot, mix64(before) + w, before), many)
        order = np.lexsort((w, before, to))
        to = to[order]
        cut = np.searchsorted(to, np.arange(many + 1))
        for s in np.unique(to).tolist():
            k = order[cut[s] : cut[s + 1]]
            rows.append((b, s, _ask(before[k], before_count[k], w[k], p[at[k]], of[k], learn)))
        return pa.Table.from_batches([_rows(rows)])

    def gather(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column(1).to_pylist(), group.column(2).to_pylist(), strict=True))
        ids, learn, total, known, base = _unpack(rows[0][1])
        out = np.zeros(len(total))
        for _, blob in rows[1:]:
            at, sums = _unpack(blob)
            out[at] += sums
        cols = [pa.array(ids, pa.int64()), pa.array(total.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(out)]
        return pa.Table.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    asked = table.groupBy("batch").cogroup(counted.where("batch >= 0").groupBy("batch")).applyInArrow(bigrams, BLOBS)
    model = shards(asked, many)
    out = answers(store.stage(model, "lm-model", model_path) if model_path else model).groupBy("batch").applyInArrow(gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of `documents`, learnt from those whose crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fold("doc_id", 7) != 2, fold("doc_id", 7) == 2)
