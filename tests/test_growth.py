"""Steps that must not meet every pair: rows that are compared are counted."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import carry, citations, graph, placement, regions
from tessera.plans import project, registry, scans  # noqa: F401  they add their queries to the registry
from tessera.sources import comparison, shared, standard


@pytest.fixture
def counted(spark):
    """(a column function that adds 0, and counts the rows that it is worked out for; the count)"""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def count(_):
        seen.add(1)
        return 0

    return count, seen


def save(path, **tables):
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def test_parts_meet_codes_not_packages(spark, tmp_path, monkeypatch, counted):
    count, seen = counted
    con = save(tmp_path, part="SELECT range AS p_partkey, CAST(range % 50 AS INT) AS p_size FROM range(200)", supplier="SELECT 700 - range AS s_suppkey, CAST(range % 25 AS INT) AS s_nationkey FROM range(500)")
    real = F.abs
    monkeypatch.setattr(scans.F, "abs", lambda c: real(c) + count(c))
    got = {tuple(r) for r in registry.QUERIES["j5_best_match"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(registry.ORACLE["j5_best_match"]).fetchall())
    assert seen.value <= 200 * 5


def test_homes_meet_codes_once(spark, monkeypatch, counted):
    count, seen = counted
    real = placement.nearness
    monkeypatch.setattr(placement, "nearness", lambda code, home: real(code, home) + count(code))
    packages = spark.createDataFrame([("09 65 00", ["09 65 00", "09 60 00"]), ("09 70 00", ["09 70 00"])], "trade_code string, codes array<string>")
    files = spark.range(300).select(F.concat(F.lit("f"), "id").alias("file"), F.array(F.lit("09 65")).alias("homes"), F.array(F.lit("09 65")).alias("numbers"), F.lit(None).cast("string").alias("otherwise"))
    got = placement.place(files, packages).groupBy("package", "step").count().collect()
    assert [tuple(r) for r in got] == [("09 65 00", "home", 300)]
    assert seen.value <= 20


def test_check_ins_take_few_batches_of_any_number_of_files(spark, tmp_path, monkeypatch):
    """Before: a batch for every four files, so one for every few partitions."""
    con = save(tmp_path, events="SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(range % 90 AS INT)) AS ts, range % 40 AS user_id, CASE WHEN range % 11 = 0 THEN 'purchase' ELSE 'click' END AS event_type FROM range(2000)")
    monkeypatch.setattr(project, "fresh_folder", lambda s, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(project.tail, "drain", (lambda real: lambda stream, *at: real(stream.sparkSession.conf.set("spark.sql.shuffle.partitions", "12") or stream, *at))(project.tail.drain))
    try:
        got = {tuple(r) for r in registry.QUERIES["t3_stream_check_ins"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == set(con.execute(registry.ORACLE["t3_stream_check_ins"]).fetchall())
    assert len([f for f in (tmp_path / "due-tail" / "commits").iterdir() if f.name.isdigit()]) <= 5


def test_regions_are_no_rows_of_a_shuffle(spark, tmp_path):
    """Pages and stamps of a shape give a region a pair: before, each pair was dealt out; corners, odd boxes and empty pages too."""
    con = save(
        tmp_path, supplier="SELECT range AS s_suppkey, CAST(range % 2 AS INT) AS s_nationkey, CASE WHEN range = 3 THEN -900.5 ELSE range * 70.0 END AS s_acctbal FROM range(30)",
        customer="SELECT range AS c_custkey, CAST(range % 2 AS INT) AS c_nationkey, CASE WHEN range % 9 = 0 THEN 720.0 * (range % 5) ELSE range * 13.7 - 500 END AS c_acctbal FROM range(200)",
        lineitem="SELECT range // 3 AS l_orderkey, range % 40 AS l_partkey, range % 28 AS l_suppkey, CAST(range % 7 AS INT) AS l_linenumber, CAST(range % 50 AS DOUBLE) AS l_quantity, 100.0 * (range % 333) AS l_extendedprice FROM range(1500)",
    )
    for name in ("r21_spans", "r21_answers"):
        out = registry.QUERIES[name](spark, str(tmp_path))
        cols = ", ".join(f'"{c}"' for c in out.columns)
        assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, con.execute(f"SELECT {cols} FROM ({registry.ORACLE[name]})").fetchall()))
    plan = registry.QUERIES["r21_answers"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    # pages meet stamps by shape and bin at last: nothing that comes of it is dealt out again
    assert "Window" not in plan and plan.index("SortMergeJoin") < plan.index("Aggregate")


def test_a_page_of_two_anchors_gives_each_its_spans(spark, tmp_path):
    """Before: a supplier given with two balances near each other had the spans of both regions twice."""
    con = save(
        tmp_path, supplier="SELECT range % 9 AS s_suppkey, CAST(range % 2 AS INT) AS s_nationkey, range * 7.0 AS s_acctbal FROM range(20)",
        customer="SELECT range AS c_custkey, CAST(range % 2 AS INT) AS c_nationkey, 300.0 * (range % 11) AS c_acctbal FROM range(90)",
        lineitem="SELECT range // 3 AS l_orderkey, range % 40 AS l_partkey, range % 9 AS l_suppkey, CAST(range % 7 AS INT) AS l_linenumber, CAST(range % 20 AS DOUBLE) AS l_quantity, 100.0 * (range % 50) AS l_extendedprice FROM range(400)",
    )
    got = sorted(tuple(r) for r in registry.QUERIES["r21_spans"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(registry.ORACLE["r21_spans"]).fetchall())


def test_stamps_that_meet_the_same_spans_are_one_row(spark, monkeypatch):
    """Before: a row, and a look at each span near, for each pair of a stamp and a page; a page given with two heights had spans twice."""
    monkeypatch.setattr(regions, "TOGETHER", 50, raising=False)
    monkeypatch.setattr(regions, "GROUP", 200, raising=False)
    words = [(p, i % 7, f"w{i}", 40.0 * (i % 9), 13.0 * (i % 5), 40.0 * (i % 9) + 30, 13.0 * (i % 5) + 8) for p in range(6) for i in range(30)] + [(1, 0, "none", None, 1.0, 5.0, 5.0), (1, None, None, 10.0, 1.0, 50.0, 20.0)]
    stamps = [(k, k % 2, 25.0 + k / 1000, 115.0 + k / 1000, 20.0) for k in range(700)] + [(900 + k, k % 2, 90.0 * k - 300, 90.0 * k - 210, 77.0 - 30 * k) for k in range(9)]
    stamps += [(950, 0, None, 80.0, 10.0), (951, 0, 5.0, 80.0, None), (952, 1, 80.0, 5.0, 9.0), (953, 1, float("nan"), float("nan"), float("nan"))]
    anchors = [(p, p % 2, 9.0 * p) for p in range(6)] + [(3, 1, 40.0), (7, 1, 3.0), (4, 0, None)]
    s = spark.createDataFrame(words, "page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    found = regions.stamped(s, spark.createDataFrame(stamps, "stamp int, shape int, x0 double, x1 double, high double"), spark.createDataFrame(anchors, "page int, shape int, y double"))
    rows = found.collect()

    def meets(page, y, x0, x1, high):
        whole = None not in (y, x0, x1, high) and x0 <= x1 and high >= 0
        hit = [w for w in words if whole and w[0] == page and w[3] is not None and w[3] <= x1 and x0 <= w[5] and w[4] <= y + high and y <= w[6]]
        return [w[1:3] for w in sorted(hit, key=lambda w: (w[1] is not None, w[1:]))]

    want = sorted(repr((p, k, meets(p, y, *box))) for p, shape, y in anchors for k, of, *box in stamps if of == shape)
    assert sorted(repr((r["page"], k, [tuple(x) for x in r["spans"]])) for r in rows for k in r["stamps"]) == want
    assert len(rows) <= len(want) / 10 and max(len(r["stamps"]) for r in rows) <= 50


def test_a_condition_is_read_once(spark, monkeypatch, counted):
    count, seen = counted
    real = F.aggregate
    monkeypatch.setattr(standard.F, "aggregate", lambda *a: F.when(count(F.col("condition")) >= 0, real(*a)))
    rows = spark.range(200).select(F.lit("f").alias("file"), F.col("id").alias("ord"), F.lit("Which Trade").alias("kind"), F.lit("Set by Tile").alias("line"), F.lit("see paint").alias("condition"), F.array(F.concat(F.lit("n"), "id")).alias("names"))
    halves, refusals = standard.which_trade(rows, {"Tile": ["t1"], "Paint": ["t2"]}, ["Owner"])
    got = halves.groupBy("shape", "trades", "condition_trades").count().collect()
    assert [tuple(r) for r in got] == [("one", ["t1"], ["t2"], 200)] and refusals.isEmpty()
    assert seen.value <= 4


def test_a_page_is_read_once_for_its_rules(spark):
    """Before: JSON was read anew at each place that used it, in each of the rules' branches."""
    row = '{"kind":"scopeItem","open":true,"subject":"s%s","section":"a"}'
    page = lambda k: '{"delivery":{"id":"d"},"ruleVersion":"7","complete":true,"referenceRows":{"total":80,"offset":%d,"rows":[%s,%s]}}' % (2 * k, row % k, row % (k + (k == 7)))
    pages = spark.createDataFrame([("f", f"p{k:02}", page(k)) for k in range(40)], "folder string, file string, json string")
    _, refusals = comparison.scan_comparison(pages, spark.createDataFrame([("f", "d", "7")], "folder string, delivery_id string, rule_version string"))
    assert {tuple(r) for r in refusals.collect()} == {("f", f"p{k:02}", "a row is there twice") for k in range(40) if k != 7}
    plan = refusals._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sum(plan.count(w) for w in ("parse_json", "parsejson")) == 1


def test_references_are_told_apart_without_numbers(spark):
    """Equal references give one that is carried, by whatever orders them; before, each equal one was."""
    refs = spark.createDataFrame([((1, 1), "a", 1, 5)] * 3 + [((0, 2), "b", 1, 5), ((0, 1), "b", 1, 5)], "ref struct<x:int,y:int>, subject string, page int, box int")
    out, balance = carry.carry_forward(refs, spark.createDataFrame([(1, 2, True)], "page int, next_page int, same boolean"), spark.createDataFrame([], "subject string, page int"))
    got = sorted((r["subject"], tuple(r["ref"]), r["outcome"]) for r in out.collect())
    assert got == [("a", (1, 1), "already there"), ("a", (1, 1), "already there"), ("a", (1, 1), "carried"), ("b", (0, 1), "carried"), ("b", (0, 2), "already there")]
    assert balance.collect()[0]["holds"]


def test_waits_are_no_rows_of_a_shuffle(spark):
    """Before: each pair of passes was dealt out, by itself."""
    units = spark.range(60).selectExpr("id % 20 as pass", "id % 20 as position", "id % 3 as unit", "case when id % 2 = 0 then id % 3 end as continues", "case when id < 20 then id % 4 end as trade")
    out = graph.waits_of_reviews(units)
    rows = units.collect()
    want = {(p["pass"], q["pass"]) for p in rows for q in rows if q["position"] < p["position"] and (p["continues"] is not None and p["continues"] == q["unit"] or p["trade"] is not None and p["trade"] == q["trade"])}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert not re.search(r"hashpartitioning\(pass#\d+L?, waits_on", out._jdf.queryExecution().executedPlan().toString())


def test_words_of_every_page_are_not_sorted(spark, monkeypatch):
    """Before: beyond some codes, pages' words were sorted to meet them, one that all pages print in one task."""
    monkeypatch.setattr(citations, "BROADCAST_CODES", 0, raising=False)
    monkeypatch.setattr(citations, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(60).selectExpr("id as page", "concat('Schedule: door ', id % 7, ' b.1; pt-', id, ' of one two three four five') as text")
        codes = spark.createDataFrame([("door 3 b.1",), ("pt-9",), ("one two three four five",), ("one two three four six",), ("door 8",)], "code string")
        found = citations.find_codes(pages, codes)
        got = {tuple(r) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(i, "one two three four five") for i in range(60)} | {(i, "door 3 b.1") for i in range(3, 60, 7)} | {(9, "pt-9")}
    assert not re.search(r"SortMergeJoin \[gram", plan)


def test_a_files_rows_are_dealt_out_once(spark):
    """Before: rows and the names that are used again were dealt out by row to meet."""
    row = "| Pricing | by hand | | | %s |"
    text = ["# T", "Numbers: 09 65", "Home: 09 65", standard.HEADER, "|---|---|---|---|---|", row % "a", row % "A", row % "", row % "b; c", row % "d"]
    lines = spark.createDataFrame([(f"f{k}", n, x) for k in range(5) for n, x in enumerate(text[: 10 - k])], "file string, line_no long, line string").repartition(8, "file")
    files, rows, refusals = standard.scan_standard_lines(lines)
    flaws = {2: "a row name is used twice", 3: "no row name", 4: "not one row name"}
    assert {tuple(r) for r in refusals.collect()} == {(f"f{k}", o, r) for k in range(5) for o, r in flaws.items() if o <= 5 - k}
    assert {(r["file"], r["ord"]) for r in rows.collect()} == {(f"f{k}", o) for k in range(5) for o in (1, 5) if o <= 5 - k} and files.count() == 5
    plan = refusals._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file#\d+, ord", plan)


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Before: the session's number of tasks, whatever the table."""
    con = save(
        tmp_path, orders="SELECT range AS o_orderkey, range % 40 AS o_custkey, CASE WHEN range % 3 = 0 THEN 'F' WHEN range % 7 = 0 THEN 'P' ELSE 'O' END AS o_orderstatus, range * 1000.0 AS o_totalprice, '5-LOW' AS o_orderpriority FROM range(300)",
        lineitem="SELECT range // 2 AS l_orderkey, range % 50 AS l_partkey FROM range(500)",
    )
    monkeypatch.setattr(shared, "TASK_ROWS", 100, raising=False)
    out = registry.QUERIES["s8_delivery_plans"](spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == set(con.execute(registry.ORACLE["s8_delivery_plans"]).fetchall())
    assert out.rdd.getNumPartitions() == 30
