import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, packing, record
from tessera.operators import relational as R


def test_even_split_sizes(spark):
    df = spark.range(25).withColumn("g", F.lit(1))
    sizes = [r["count"] for r in packing.even_split(df, ["g"], ["id"]).groupBy("part").count().orderBy("part").collect()]
    assert sizes == [9, 8, 8]


def test_two_beside_eleven_stay_apart(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 11), (1, 3, 1)], "g int, o int, n int")
    got = {r["o"]: r["pass"] for r in packing.fold_small(df, ["g"], "o", "n").collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_ids_are_kept_and_never_reused(spark):
    rows = spark.createDataFrame([(k, "A") for k in range(1, 6)], "k int, part string")
    ledger = spark.createDataFrame([(3, "A", 7)], "k int, part string, number int")
    plan = spark.createDataFrame([(1, "A", 2), (4, "A", 7)], "k int, part string, number int")
    got = {r["k"]: (r["number"], r["bound"]) for r in packing.bind_ids(rows, "k", "part", "k", ledger, plan).collect()}
    assert got == {3: (7, "ledger"), 1: (2, "plan"), 2: (8, "new"), 4: (9, "new"), 5: (10, "new")}


def test_constraint_refuses_with_names(spark):
    with pytest.raises(ValueError, match=r"small: 0, 1, 2, 3, 4 \(6 in all\)"):
        R.require(spark.range(9), {"small": F.col("id") > 5}, F.col("id").cast("string"))


def test_cycle_refuses(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(e, spark.createDataFrame([(1,), (2,)], "a int"), "a", "b")


def test_levels(spark):
    e = spark.createDataFrame([(2, 1), (3, 2)], "a int, b int")
    got = graph.levels(e, spark.createDataFrame([(1,), (2,), (3,)], "a int"), "a", "b")
    assert {(r["a"], r["level"]) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}


def test_reachability_survives_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    assert graph.reachable(e, "a", "b").count() == 9


def test_scalars(spark):
    df = spark.createDataFrame([("A.1.2", " 03 30 00 ", "033000")], "a string, b string, c string")
    r = df.select(T.stem(F.col("a")).alias("stem"), T.folded(F.col("b")).alias("f"), T.trimmed_code(F.col("c")).alias("t"), T.letters(F.lit("ab1")).alias("l"), T.utf16_length(F.lit("a\U0001f600")).alias("u")).first()
    assert (r["stem"], r["f"], r["t"], r["l"], r["u"]) == ("A.1", "033000", "0330", "AB", 3)


def test_partition_check_is_empty_for_a_partition(spark):
    df = spark.range(10)
    assert R.partition_check(df, [df.where("id < 4"), df.where("id >= 4")], ["id"]).isEmpty()


def test_dropped_rows_name_what_stands_for_them(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, o int")
    assert {(r["k"], r["o"], r["kept"]["o"]) for r in R.dropped_rows(df, ["k"], ["o"]).collect()} == {("a", 2, 1), (None, 5, 4)}


def test_excludes_win_and_patterns_that_match_nothing_show(spark):
    df = spark.createDataFrame([("A-1",), ("A-2",), ("B-1",), (None,)], "x string")
    pick = lambda *a: sorted(r["x"] or "" for r in R.include_exclude(df, F.col("x"), *a).collect())
    assert pick(["A*"], ["*2"]) == ["A-1"] and pick([], ["A*"]) == ["", "B-1"] and pick(["[!A]*"], []) == ["B-1"]
    assert {tuple(r) for r in R.pattern_matches(df, F.col("x"), ["A*", "Z*", "?-1"]).collect()} == {("A*", 2), ("Z*", 0), ("?-1", 2)}


def test_matches_with_both_named_and_restores(spark):
    left, right = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "k string"), spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "z"), ("b", "q"), ("d", "1"), ("d", "2"), (None, "n"), (None, "m")], "k string, name string")
    assert [tuple(r) for r in record.ambiguous_matches(left, right, "k", "name").collect()] == [("a", 3, "x", "y")]
    rows = [("s", 1, "note"), ("r", 1, "retire"), ("b", 1, "retire"), ("b", 2, "restore"), ("o", 1, "restore"), ("t", 1, "retire"), ("t", 2, "restore"), ("t", 3, "retire"), ("t", 4, "note"), (None, 1, "retire")]
    got = record.standing(spark.createDataFrame(rows, "i string, o int, w string"), "i", ["o"], F.col("w") == "retire", F.col("w") == "restore")
    assert {tuple(r) for r in got.collect()} == {("s", "standing"), ("r", "retired"), ("b", "restored"), ("o", "standing"), ("t", "retired")}
