"""Centroid clustering of integer vectors by Elkan's bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store

#: Components beyond this size are refused: squared distances over 4,096 of them still fit into 64 bits.
MOST = 2**24
#: Vectors whose distances are computed at once.
ROWS = 4096


def up(x: np.ndarray) -> np.ndarray:
    """A 32-bit float not under x, with room for a square root's and a sum's rounding."""
    return np.nextafter(np.nextafter(x, np.inf).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """A 32-bit float not over x and not under 0."""
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, or to one row."""
    d = v.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def halves(centres: np.ndarray) -> np.ndarray:
    """Half of the distance between each two centroids, rounded down."""
    d = np.stack([squared(centres, c) for c in centres])
    return down(down(np.sqrt(d.astype(np.float64))).astype(np.float64) / 2)


def assign(v: np.ndarray, owner: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, upper, lower, distances computed) of each vector against `centres`, from bounds that hold for these centroids.

    A centroid is passed over only if it is strictly farther than the vector's own one, as its lower bound or half of its distance
    to that one shows; all others are compared by exact integers, and of equal ones the smaller number is taken.
    """
    half = halves(centres)
    other = half.copy()
    np.fill_diagonal(other, np.inf)
    work = np.zeros(len(v), dtype=np.int64)
    owner, upper, lower = owner.copy(), upper.copy(), lower.copy()
    open_ = np.flatnonzero(upper >= other.min(1)[owner])
    for i in range(0, len(open_), ROWS):
        at = open_[i : i + ROWS]
        own = owner[at]
        best, chosen = squared(v[at], centres[own]), own.copy()
        near = np.sqrt(best.astype(np.float64))
        tight = up(near)
        lower[at, own] = down(near)
        work[at] += 1
        for j in range(len(centres)):
            ask = np.flatnonzero((own != j) & (lower[at, j] <= tight) & (half[own, j] <= tight))
            if not len(ask):
                continue
            d = squared(v[at[ask]], centres[j])
            work[at[ask]] += 1
            lower[at[ask], j] = down(np.sqrt(d.astype(np.float64)))
            closer = (d < best[ask]) | ((d == best[ask]) & (j < chosen[ask]))
            best[ask[closer]], chosen[ask[closer]] = d[closer], j
        owner[at], upper[at] = chosen, up(np.sqrt(best.astype(np.float64)))
    return owner, upper, lower, work


def moved(upper: np.ndarray, lower: np.ndarray, owner: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds that hold once each centroid has gone from `before` to `after`."""
    drift = up(np.sqrt(squared(before, after).astype(np.float64)))
    drift[(before == after).all(1)] = 0
    return np.where(drift[owner] > 0, up(upper.astype(np.float64) + drift[owner]), upper), np.where(drift > 0, down(lower.astype(np.float64) - drift), lower)


STATE = "vec_id long, v array<int>, cluster int, upper float, lower array<float>, computed long"


def _matrix(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _round(state: DataFrame, centres: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """All vectors assigned to `centres`; `before`: those for which the state's bounds hold, None where there are none yet."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch, "v", np.int32)
            if before is None:
                owner = np.zeros(len(v), dtype=np.int32)
                upper, lower, spent = np.full(len(v), np.inf, dtype=np.float32), np.zeros((len(v), len(centres)), dtype=np.float32), 0
            else:
                owner, upper, lower = batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), _matrix(batch, "lower", np.float32)
                upper, lower = moved(upper, lower, owner, before, centres)
                spent = batch.column("computed").to_numpy()
            owner, upper, lower, work = assign(v, owner, upper, lower, centres)
            bounds = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * len(centres), pa.array(lower.ravel(), pa.float32()))
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(owner, pa.int32()), pa.array(upper, pa.float32()), bounds, pa.array(work + spent, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower", "computed"])

    return state.mapInArrow(run, STATE)


def scaled(vector: Column, dim: int, scale: int) -> Column:
    """Integer components floor(scale * x), null where the vector is not of `dim` components or holds a null or non-finite one."""
    fine = vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) > MOST)
    refuse = F.raise_error(F.lit(f"a component is beyond {MOST} after scaling: distances would not fit into 64 bits")).cast("array<int>")
    return F.when(fine & large, refuse).when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def cluster(vectors: DataFrame, k: int, rounds: int, dim: int, *, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, computed) of every kept vector, and the final centroids (integers, k x dim).

    Kept are vectors of exactly `dim` components, none null or non-finite; components are floor(scale * x). Centroids begin as
    the k kept vectors of the smallest SHA-256 of `<seed>:<id>`; ids that repeat are ordered by their vectors, rows without an id
    come last. Every round assigns each vector to the nearest centroid (ties: the smaller number) and replaces each non-empty
    centroid by the floor of its vectors' mean; then all are assigned once more. Fewer than k kept vectors give as many centroids,
    none an empty table. Repeated rows each count; components beyond 2^24 are refused, as are `dim` over 4,096; other columns are
    ignored. `computed`: distances computed in all rounds (without bounds it would be k in each).

    A round is a narrow pass over a written table of vectors and bounds, followed by sums with map-side partial aggregates;
    the driver holds k centroids and k sums. No vector is ever shuffled.
    """
    if not 0 < dim <= 4096:
        raise ValueError("dim must be within 1 and 4096")
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), dim, scale).alias("v")).where("v is not null")
    state = store.stage(kept, "centroids-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, computed long"), np.zeros((0, dim), dtype=np.int64)
    centres, before = np.array([r["v"] for r in first], dtype=np.int64), None
    for n in range(rounds + 1):
        old = store.staged_path(state)
        state = store.stage(_round(state, centres, before), "centroids-state")
        store.discard(spark, old)
        if n < rounds:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)]).collect()
            before = centres.copy()
            for r in sums:
                centres[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    final = centres.copy()

    def exact(batches):
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            d = squared(_matrix(batch, "v", np.int32), final[own]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d, pa.int64()), batch.column("computed")], names=["vec_id", "cluster", "distance", "computed"])

    return state.select("vec_id", "v", "cluster", "computed").mapInArrow(exact, "vec_id long, cluster int, distance long, computed long"), final


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all `embeddings` of 64 components: 16 centroids, 3 rounds, with inertia and the centroids' digests."""
    out, centres = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 16, 3, 64)
    # one row for each centroid
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    each = spark.createDataFrame([(j, sums.get(j, 0), d) for j, d in enumerate(digests)], "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(sum(sums.values())).cast("long")
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
