"""Files of lines: whole or not at all, appended after a whole last line, and summaries that are read back."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import plan, sinks


def rows(spark, *lines):
    return spark.createDataFrame([(f, i, x) for f, i, x in lines], "file string, line_no int, line string").repartition(3)


def held(path):
    return {f: (path / f).read_text() for f in sorted(os.listdir(path))}


def test_files_are_replaced_whole_and_in_order(spark, tmp_path):
    (tmp_path / "a.md").write_text("old\n")
    (tmp_path / "other").write_text("stays")
    sinks.write_lines(rows(spark, ("a.md", 2, "two é"), ("a.md", 1, "one"), ("a.md", 3, None), ("b.md", 1, "")), f"file://{tmp_path}")
    assert held(tmp_path) == {"a.md": "one\ntwo é\n\n", "b.md": "\n", "other": "stays"}


def test_a_log_gets_its_missing_end_first(spark, tmp_path):
    (tmp_path / "log").write_text("first\nsecond")
    (tmp_path / "whole").write_text("x\n")
    (tmp_path / "empty").write_text("")
    for k in (1, 2):
        sinks.write_lines(rows(spark, ("log", 1, f"line {k}"), ("whole", 1, f"y{k}"), ("empty", 1, f"e{k}"), ("new", 1, f"n{k}")), f"file://{tmp_path}", append=True)
    assert held(tmp_path) == {"log": "first\nsecond\nline 1\nline 2\n", "whole": "x\ny1\ny2\n", "empty": "e1\ne2\n", "new": "n1\nn2\n"}


@pytest.mark.parametrize("append", [False, True])
def test_a_failed_task_leaves_no_half_file(spark, tmp_path, append):
    (tmp_path / "f0").write_text("before\n")
    many = spark.range(2000).select(F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("file"), F.col("id").alias("line_no"), F.when(F.col("id") == 1999, F.raise_error(F.lit("lost executor")).cast("string")).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="lost executor"):
        sinks.write_lines(many, f"file://{tmp_path}", append)
    assert held(tmp_path) == {"f0": "before\n"}
    for name in ("a/b", "", "..", None):
        with pytest.raises(Exception, match="not the name of a file"):
            sinks.write_lines(rows(spark, ("ok", 1, "x"), (name, 1, "x")), f"file://{tmp_path}", append)
    assert held(tmp_path) == {"f0": "before\n"}


def test_summaries_are_read_back(spark, tmp_path):
    units = spark.createDataFrame(
        [("s1", "2", "P1", 2, "A-2", 3, 1, 0, 2, 1, 0, 1, "mismatch"), ("s1", "2", "P1", 1, "A-1", 4, 2, 5, 0, 0, 3, 2, "ok"), ("s1", "2", "P1", 3, "A-3", None, None, None, None, None, None, None, None), ("s2", "1", "P2", 1, "B-1", 1, 1, 1, 1, 1, 0, 1, "ok")],
        "file string, window string, pass string, ord int, unit string, created int, items int, updated int, questions int, replied int, conflicts int, reads int, result string",
    )
    trades = spark.createDataFrame([("s1", "09 65 00", 2), ("s1", "03 30 00", 9), ("s1", "01 00 00", 2)], "file string, code string, n int")
    ledgers = spark.createDataFrame([("s1", "/l.md", "verified A-2", 7, "ab" * 32), ("s2", "/l.md", None, 0, "cd" * 32)], "file string, ledger string, last_line string, lines int, hash string")
    notes = spark.createDataFrame([("s1", 2, "overlap", "A-1", "with A-2"), ("s1", 1, "anomaly", None, "a page twice")], "file string, ord int, kind string, unit string, clause string")
    out = sinks.render_summaries(units, trades, ledgers, notes)
    got = [r["line"] for r in out.where("file = 's1'").orderBy("line_no").collect()]
    assert got == [
        "window: 2   pass: P1", "units read: A-1, A-2, A-3", "per unit: A-1 created 4 items 2 updated 5 questions 0 replied 0 conflicts 3 read 2 verified yes", "per unit: A-2 created 3 items 1 updated 0 questions 2 replied 1 conflicts 0 verified no",
        "per unit: A-3 created - items - updated - questions - replied - conflicts - verified no", "totals verified: created 7 (entry count under the unit prefixes), items 3 (reader's own item count), updated 5, questions 2 replied 1",
        "trades: 03 30 00 x9, 01 00 00 x2, 09 65 00 x2", "conflicting rows: 3, on units A-1", "anomaly: a page twice", "overlap: A-1 with A-2", "ledger: /l.md, appended through verified A-2", f"ledger lines: 7 sha256 {'ab' * 32}",
    ]
    sinks.write_lines(out, f"file://{tmp_path}")
    text = spark.read.text(f"file://{tmp_path}", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    summaries, read, sold, refusals = plan.scan_summaries(text)
    assert refusals.collect() == [] and {(r["file"], r["items"], r["created"]) for r in summaries.collect()} == {("s1", 13, 7), ("s2", 0, 1)}
    assert {tuple(r) for r in read.where("file = 's1'").collect()} == {("s1", "A-1", 4, True), ("s1", "A-2", 3, False), ("s1", "A-3", None, False)} and sold.count() == 3


def test_plans_are_read_back(spark):
    units = [("p1", "1", 2, "B1", "Other", None, 1, "B1-1", "x: y", None), ("p1", "1", 1, "A1", "Vocabulary, discipline A", "words", 2, "A1-2", "b", True), ("p1", "1", 1, "A1", "Vocabulary, discipline A", "words", 1, "A1-1", None, True), ("p3", "3", 1, "W3-1", "Package reviews", "package reviews", 1, "rev-09-1", "A, trade 09", False)]
    df = spark.createDataFrame(units, "file string, window string, pass_ord int, pass string, title string, reads_for string, ord int, unit string, text string, verified boolean")
    left = spark.createDataFrame([("p1", 1, "A-9", "by pattern"), ("p1", 2, "units: 9", None)], "file string, ord int, text string, why string")
    out = sinks.render_plans(df, left)
    assert [r["line"] for r in out.where("file = 'p3'").orderBy("line_no").collect()] == [
        "# Read plan: window 3", "", "## Window 3", "", "### W3-1. Package reviews", "", "window: 3", "reads for: package reviews", "units: 1", "units verified: 0", "", "1. rev-09-1: A, trade 09", "",
        "## Deliberately left out", "", "Nothing. This window left nothing out by pattern.", "", "## Totals", "", "units planned 1, passes 1",
    ]
    passes, read, fields, refusals = plan.scan_plan(out)
    assert refusals.collect() == [] and sorted(tuple(r)[1:] for r in passes.collect()) == [("1", "A1", 1, 2, 2), ("1", "B1", 2, 1, 1), ("3", "W3-1", 1, 1, 1)]
    assert sorted((r["pass"], r["ord"], r["unit"], r["text"]) for r in read.collect()) == [("A1", 1, "A1-1", ""), ("A1", 2, "A1-2", "b"), ("B1", 1, "B1-1", "x: y"), ("W3-1", 1, "rev-09-1", "A, trade 09")]
    assert {r["value"] for r in fields.where("field = 'units verified'").collect()} == {"2", "0"}
