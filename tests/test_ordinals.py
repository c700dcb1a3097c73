"""Ordinals, running sums and folds over ranges: keys that fill many ranges, many keys in one, nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordinals, packing
from tessera.operators import relational as R


@pytest.fixture
def rows():
    rng = random.Random(11)
    out = [("hot", "a", i, rng.randint(0, 12)) for i in range(900)] + [(rng.choice(["x", "y", None]), rng.choice(["a", None]), 1000 + i, rng.randint(0, 12)) for i in range(200)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_running_sums_and_folds_equal_loops(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, j string, o long, n long").repartition(5)
        got = {r["o"]: r for r in ordinals.numbered(ordinals.running(df, ["o"], F.col("n"), ["k", "j"]), ["o"], ["k", "j"]).collect()}
        passes = {r["o"]: r["pass"] for r in packing.fold_small(df, ["k", "j"], "o", "n").collect()}
        bins = {r["o"]: r["bin"] for r in packing.bins(df.withColumn("m", F.col("n") % 5), ["k", "j"], "o", "m", "n").collect()}
        whole = {r["o"]: r["ordinal"] for r in ordinals.numbered(df, [F.col("o").desc()]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state = {}
    for k, j, o, n in sorted(rows, key=lambda r: r[2]):
        s = state.setdefault((k, j), {"sum": 0, "n": 0, "built": None, "pass": 0, "r": None, "u": 0, "bin": 0})
        s["sum"] += n
        s["n"] += 1
        if s["built"] is not None and min(s["built"], n) < 3 and s["built"] + n <= 12:
            s["built"] += n
        else:
            s["built"], s["pass"] = n, s["pass"] + 1
        if s["r"] is not None and s["r"] + n % 5 <= 8 and s["u"] + n <= 10:
            s["r"], s["u"] = s["r"] + n % 5, s["u"] + n
        else:
            s["r"], s["u"], s["bin"] = n % 5, n, s["bin"] + 1
        assert (got[o]["running"], got[o]["ordinal"], passes[o], bins[o]) == (s["sum"], s["n"], s["pass"], s["bin"])
    assert [whole[o] for o in sorted(whole, reverse=True)] == list(range(1, len(rows) + 1))


def test_empty_tables_and_null_amounts(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "o long, n long")
    assert [(r["o"], r["running"]) for r in ordinals.running(df, ["o"], F.col("n")).orderBy("o").collect()] == [(1, 0), (2, 5)]
    assert ordinals.numbered(df.where("false"), ["o"]).collect() == [] and packing.bins(df.where("false").withColumn("k", F.lit(1)), ["k"], "o", "n", "n").collect() == []


def test_even_split_of_each_key(spark):
    df = spark.range(60).select(F.when(F.col("id") < 35, 1).alias("k"), "id")
    got = packing.even_split(df, ["k"], ["id"]).groupBy("k", "part").count().collect()
    assert sorted((r["k"] or 0, r["part"], r["count"]) for r in got) == [(0, 0, 9), (0, 1, 8), (0, 2, 8), (1, 0, 12), (1, 1, 12), (1, 2, 11)]


def test_capped_print_goes_on(spark):
    lines = ["one", "two", "x" * 25, "", None, "end"]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "k string, i int, line string")
    at, seen = (1, 0), []
    while at[0]:
        r = R.capped_print(df, ["k"], ["i"], "line", 10, *at).first()
        assert len(r["printed"]) <= 10
        seen.append(r["printed"])
        at = (r["next_line"], r["next_char"])
    assert seen == ["one\ntwo", "x" * 10, "x" * 10, "x" * 5 + "\n\n", "end"]
