"""Approximate nearest neighbours: anisotropic product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors in the training sample at most, in the order of a hash of their ids.
SAMPLE = 6000
#: Components of a subspace; centres of each, of which a code takes four bits.
WIDTH, CENTRES = 2, 16
#: Cosine from which a neighbour counts in the loss: it weighs residuals along the vector.
LEAST_COSINE = 0.2
#: Candidates reranked for each query and block at least, and the approximate score under the last of the nearest up to which all others are.
RERANK, MARGIN = 64, 0.12
#: Vectors and queries that meet in one task: a vector is sent once for each block of queries, a query once for each of vectors.
DATA_BLOCK, QUERY_BLOCK = 32_768, 8192


@dataclass
class Quantiser:
    centres: np.ndarray  # subspaces x CENTRES x WIDTH

    def split(self, x: np.ndarray) -> np.ndarray:
        m = len(self.centres)
        x = np.pad(x, ((0, 0), (0, m * WIDTH - x.shape[1])))
        return x.reshape(len(x), m, WIDTH)

    def encode(self, x: np.ndarray, along: float, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors that lessen the score-aware loss: squared residual, that along the vector weighing `along` times."""
        parts = self.split(x)
        cross = np.einsum("nmw,mkw->nmk", parts, self.centres)
        norm = (self.centres**2).sum(2)
        codes = (norm[None] - 2 * cross).argmin(2)
        n, m = codes.shape
        own = (parts**2).sum(2)
        rows = np.arange(n)
        # product of the residual with the vector, kept up as codes change
        lean = (own - np.take_along_axis(cross, codes[:, :, None], 2)[:, :, 0]).sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = lean - (own[:, j] - cross[rows, j, codes[:, j]])
                to = rest[:, None] + own[:, j, None] - cross[:, j]
                loss = own[:, j, None] - 2 * cross[:, j] + norm[j][None] + (along - 1) * to**2
                codes[:, j] = loss.argmin(1)
                lean = to[rows, codes[:, j]]
        return codes.astype(np.uint8)


def weight_along(dim: int) -> float:
    """Weight of the parallel residual for neighbours of at least LEAST_COSINE."""
    return max(1.0, (dim - 1) * LEAST_COSINE**2 / (1 - LEAST_COSINE**2))


def fit(x: np.ndarray, rounds: int = 6) -> Quantiser:
    """Centres for unit vectors x: codes and centres in turn, the centres by weighted least squares of the score-aware loss."""
    dim = x.shape[1]
    m, along = -(-dim // WIDTH), weight_along(dim)
    rng = np.random.default_rng(7)
    q = Quantiser(np.zeros((m, CENTRES, WIDTH)))
    parts = q.split(x)
    for j in range(m):
        q.centres[j] = parts[rng.integers(0, len(x), CENTRES), j] + rng.normal(0, 1e-6, (CENTRES, WIDTH))
    for _ in range(rounds):
        codes = q.encode(x, along, 1)
        for j in range(m):
            chosen = np.stack([q.centres[i][codes[:, i]] for i in range(m)], 1)
            lean = ((parts - chosen) * parts).sum((1, 2))
            p = parts[:, j]
            rest = lean - (p * (p - chosen[:, j])).sum(1)
            goal = p * (1 + (along - 1) * (rest + (p * p).sum(1)))[:, None]
            for k in range(CENTRES):
                at = codes[:, j] == k
                if at.any():
                    a = at.sum() * np.eye(WIDTH) + (along - 1) * p[at].T @ p[at]
                    q.centres[j, k] = np.linalg.solve(a + 1e-9 * np.eye(WIDTH), goal[at].sum(0))
    return q


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of every valid row where `is_query` (over vec_id) holds.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor does a row without an id.
    Vectors meet only vectors of their own length. Rows that share an id are one query and one candidate: the score of two ids is
    the largest of their vectors', and an id is never its own neighbour. Ties go to the smaller id. Other columns are ignored;
    without valid vectors or queries there are no rows. Equal vectors are one class, of which the k + 1 smallest ids stand for all, as no more of it can be among a query's k nearest; copies
    are cut to that many before any shuffle. Codes and vectors are dealt out in blocks, each of which meets each block of
    queries; a task scans the codes by four-bit tables, reranks exactly and gives k rows a query.
    """
    spark = vectors.sparkSession
    valid = _valid(vectors, id_col, vector_col)
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    classes = valid.withColumn("r", F.dense_rank().over(by_vector)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    queries = valid.where(is_query).distinct()
    sizes = {r["dim"]: (r["n"], r["q"]) for r in valid.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.coalesce(is_query.cast("long"), F.lit(0))).alias("q")).collect()}
    out = None
    for dim, (n, nq) in sorted(sizes.items()):
        if not nq:
            continue
        got = valid.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
        x = np.array([r["v"] for r in got], dtype=np.float64)
        q = fit(x / np.linalg.norm(x, axis=1, keepdims=True))
        blocks, asks = 1 + n // DATA_BLOCK, 1 + nq // QUERY_BLOCK
        part = _dim(classes.where(F.size("v") == dim), queries.where(F.size("v") == dim), q, dim, k, blocks, asks)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dim(classes: DataFrame, queries: DataFrame, q: Quantiser, dim: int, k: int, blocks: int, asks: int) -> DataFrame:
    along = weight_along(dim)

    def index(batches):
        """Classes with codes packed two to a byte."""
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            c = q.encode(v / np.linalg.norm(v, axis=1, keepdims=True), along)
            c = np.pad(c, ((0, 0), (0, c.shape[1] % 2)))
            c = c[:, ::2] | c[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary())], names=["ids", "v", "codes"])

    def pack(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["query_id", "v"])

    data = classes.select("v", "ids").mapInArrow(index, "ids array<long>, v binary, codes binary")
    data = data.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks))).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long"))))
    asked = queries.select("vec_id", "v").mapInArrow(pack, "query_id long, v binary")
    asked = asked.withColumn("ask", F.pmod(F.xxhash64("query_id"), F.lit(asks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = left.column("ids").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: ids[i][0])
            ids = [ids[i] for i in order]
            v = np.frombuffer(b"".join(left.column("v").to_pylist()), dtype=np.float64).reshape(-1, dim)[order]
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
            norm = np.linalg.norm(v, axis=1)
            columns = np.ascontiguousarray(codes.T)
            flat, owner = np.array([i for x in ids for i in x]), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            # an id's k nearest are among the k nearest of each of its vectors
            for key, raw in sorted(zip(right.column("query_id").to_pylist(), right.column("v").to_pylist(), strict=True)):
                y = np.frombuffer(raw, dtype=np.float64)
                size = np.linalg.norm(y)
                # products of the query with the centres of each subspace; pairs of four-bit tables as one of a byte
                t = np.einsum("mw,mkw->mk", q.split(y[None] / size)[0], q.centres)
                t = np.vstack([t, np.zeros((len(t) % 2, CENTRES))])
                pair = (t[1::2, :, None] + t[::2, None, :]).reshape(-1, 256).astype(np.float32)
                near = np.zeros(len(ids), dtype=np.float32)
                for j in range(len(pair)):
                    near += pair[j][columns[j]]
                if len(near) > RERANK:
                    top = np.partition(near, [-RERANK, -k])
                    pick = np.flatnonzero(near >= min(top[-RERANK], top[-k] - MARGIN))
                else:
                    pick = np.arange(len(near))
                exact = (v[pick] * y).sum(1) / (norm[pick] * size)
                spread = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
                values = np.repeat(exact, first[pick + 1] - first[pick])
                other = flat[spread] != key
                found, values = flat[spread][other], values[other]
                # an id with several vectors may be found several times: its first is its best
                best = np.lexsort((found, -values))
                best = best[np.sort(np.unique(found[best], return_index=True)[1])[:k]]
                out[0] += [key] * len(best)
                out[1] += found[best].tolist()
                out[2] += values[best].tolist()
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return data.groupBy("block", "ask").cogroup(asked.groupBy("block", "ask")).applyInArrow(scan, "query_id long, vec_id long, score double")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine of every row of `embeddings` whose vec_id is divisible by 50, among all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
