"""Ordinals, running sums and ordered folds over a whole table, or over groups of any size, without gathering either in one task.

Rows are dealt out in ranges of key and order, and written once. A range holds whole keys but for its first and its last, so what a
range must know of those before it is one state: that of its first key. Each range sums up how it changes such a state; the driver, which
gets these few figures of each range and no row, joins them end to end; each range then runs from the state it is entered in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import held


def _dealt(df: DataFrame, order: list, key: list[str], args: list[Column]) -> DataFrame:
    """`df` with `_a0`, ... (whole numbers, null as 0), the key's digest and the range's number, written in ranges in order."""
    named = [F.col(k) for k in key]
    marks = [*named, *[c.isNull() for c in named]]
    digest = [F.xxhash64(*marks), F.xxhash64(F.lit(1), *marks)] if key else [F.lit(0).cast("long")] * 2
    amounts = [F.coalesce(a.cast("long"), F.lit(0)).alias(f"_a{i}") for i, a in enumerate(args)]
    x = df.select("*", *amounts, digest[0].alias("_h1"), digest[1].alias("_h2"))
    return held(x.repartitionByRange("_h1", "_h2", *order).sortWithinPartitions("_h1", "_h2", *order).withColumn("_part", F.spark_partition_id()))


def _pieces(batches: Iterator[pa.RecordBatch], args: int):
    """(batch, part, [(digest, from, to)], arguments) of each batch: its runs of rows of one key."""
    for batch in batches:
        if batch.num_rows:
            column = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy()  # noqa: E731, B023
            h1, h2 = column("_h1"), column("_h2")
            cuts = [0, *(np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1).tolist(), batch.num_rows]
            runs = [((int(h1[a]), int(h2[a])), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield batch, int(column("_part")[0]), runs, [column(f"_a{i}") for i in range(args)]


def _put(batch: pa.RecordBatch, cols: list[str], values: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(cols))], pa.array(values, pa.int64())], names=[*cols, name])


def running(df: DataFrame, order: list, amount: Column, key: list[str] = (), name: str = "running") -> DataFrame:
    """`df` with the sum of `amount` (null as 0) over all rows of its key up to and including it, in `order`.

    Rows that are equal in key and order follow each other in any order: give a complete one. Nulls of a key are a key.
    """
    cols = df.columns
    kept = _dealt(df, order, list(key), [amount])

    def ends(batches):
        part, first, last, only = None, None, None, True
        for _, part, runs, (x,) in _pieces(batches, 1):  # noqa: B007
            for h, a, b in runs:
                total = int(x[a:b].sum())
                if last is not None and last[0] == h:
                    last = (h, last[1] + total)
                else:
                    only = last is None
                    last = (h, total)
                if only:
                    first = last
        if part is not None:
            values = [part, *first[0], first[1], *last[0], last[1], only]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["part", "f1", "f2", "fs", "l1", "l2", "ls", "single"])

    entry, now = {}, (None, 0)
    found = kept.select("_part", "_h1", "_h2", "_a0").mapInArrow(ends, "part long, f1 long, f2 long, fs long, l1 long, l2 long, ls long, single boolean")
    for r in sorted(found.collect(), key=lambda r: r["part"]):  # one row for each range
        entry[r["part"]] = now[1] if now[0] == (r["f1"], r["f2"]) else 0
        now = ((r["l1"], r["l2"]), r["ls"] + (entry[r["part"]] if r["single"] else 0))

    def place(batches):
        h_now, total, first = None, 0, True
        for batch, part, runs, (x,) in _pieces(batches, 1):
            out = np.cumsum(x)
            for h, a, b in runs:
                if h != h_now:
                    h_now, total, first = h, entry[part] if first else 0, False
                out[a:b] += total - (int(out[a]) - int(x[a]))
                total = int(out[b - 1])
            yield _put(batch, cols, out, name)

    return kept.mapInArrow(place, _with(df, name))


def _with(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])


def numbered(df: DataFrame, order: list, key: list[str] = (), name: str = "ordinal") -> DataFrame:
    """`df` with each row's place, from 1, among the rows of its key in `order`."""
    return running(df, order, F.lit(1), key, name)


def folded(df: DataFrame, order: list, key: list[str], args: list[Column], states: int, step, name: str = "group") -> DataFrame:
    """`df` with the number, from 1, of the group that each row falls in when the rows of its key pass in `order` through a machine.

    The machine has states 0 to `states` - 1 and begins in 0; `step(state, *args)` takes an array of states and a row's arguments (whole
    numbers, null as 0) and gives (the next states, whether the row opens a group), for each state. A row's group depends on all rows of
    its key before it, yet a key may be spread over many ranges: each works out where every state that it may be entered in leads to.
    """
    cols, n_args = df.columns, len(args)
    kept = _dealt(df, order, list(key), args)

    def ends(batches):
        part, first, last, h_now, only = None, None, None, None, True
        state, opened = np.arange(states), np.zeros(states, dtype=np.int64)
        for _, part, runs, xs in _pieces(batches, n_args):  # noqa: B007
            for h, a, b in runs:
                if h != h_now:
                    if h_now is not None:
                        only = False
                        state, opened = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
                    h_now = h
                for i in range(a, b):
                    state, opens = step(state, *[int(x[i]) for x in xs])
                    opened = opened + opens
                if only:
                    first = (h, state, opened)
                last = (h, state, opened)
        if part is not None:
            lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (first[1], first[2], last[1], last[2])]
            heads = [pa.array([v]) for v in (part, *first[0], *last[0], only)]
            yield pa.RecordBatch.from_arrays([*heads, *lists], names=["part", "f1", "f2", "l1", "l2", "single", "fs", "fn", "ls", "ln"])

    entry, now = {}, (None, 0, 0)
    found = kept.select("_part", "_h1", "_h2", *[f"_a{i}" for i in range(n_args)]).mapInArrow(ends, "part long, f1 long, f2 long, l1 long, l2 long, single boolean, fs array<long>, fn array<long>, ls array<long>, ln array<long>")
    for r in sorted(found.collect(), key=lambda r: r["part"]):  # one row for each range
        s, n = entry[r["part"]] = now[1:] if now[0] == (r["f1"], r["f2"]) else (0, 0)
        now = ((r["l1"], r["l2"]), r["fs"][s], n + r["fn"][s]) if r["single"] else ((r["l1"], r["l2"]), r["ls"][0], r["ln"][0])

    def place(batches):
        h_now, state, group, begun = None, None, 0, False
        for batch, part, runs, xs in _pieces(batches, n_args):
            out = np.empty(batch.num_rows, dtype=np.int64)
            for h, a, b in runs:
                if h != h_now:
                    s, group = (0, 0) if begun else entry[part]
                    h_now, state, begun = h, np.array([s]), True
                for i in range(a, b):
                    state, opens = step(state, *[int(x[i]) for x in xs])
                    group += int(opens[0])
                    out[i] = group
            yield _put(batch, cols, out, name)

    return kept.mapInArrow(place, _with(df, name))
