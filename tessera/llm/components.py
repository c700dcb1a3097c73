"""Connected components of a distributed edge table, by alternating large and small stars over written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import store

EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the given edges, by repeated hooking and shortcutting."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


#: Edges that one task contracts at a time.
HELD = 500_000


def contract(batches):
    """Each bounded run of edges as a forest of stars with the same components."""

    def put(part):
        a, b = (np.concatenate([np.asarray(p.column(k)) for p in part]) for k in (0, 1))
        x, y = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    part, n = [], 0
    for batch in batches:
        if batch.num_rows:
            part.append(batch)
            n += batch.num_rows
        if n >= HELD:
            yield put(part)
            part, n = [], 0
    if part:
        yield put(part)


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b: long, not null): the smallest node reachable.

    Loops, repeats and either direction are allowed. Every round is written to the shared folder, so that lineage
    stays short and a lost executor costs one round; all work is on keys with partial aggregates, and a node with very
    many neighbours is one side of a join that adaptive execution splits. No part of the graph reaches the driver.
    """
    spark = edges.sparkSession
    raw = store.stage(edges.where("a <> b").select("a", "b").mapInArrow(contract, EDGES), name)
    # a scan reads many small files in one task, so that the forests of many tasks become one before any join
    now = store.stage(raw.mapInArrow(contract, EDGES), name)
    if store.staged_path(raw):
        store.discard(spark, store.staged_path(raw))
    path, before = store.staged_path(now), None
    for _ in range(most):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = store.stage(small.mapInArrow(contract, EDGES), name)
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if path:
            store.discard(spark, path)
        now, path = nxt, store.staged_path(nxt)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components: not settled after {most} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    return stars.union(stars.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("node"), F.col("b").alias("component"))
