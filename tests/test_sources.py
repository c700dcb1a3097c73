"""Scans of lines and JSON: what each accepts, skips and refuses."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import record
from tessera.sources import lines as L


def as_lines(spark, *lines, file="a.txt"):
    return spark.createDataFrame([(file, i + 1, x) for i, x in enumerate(lines)], "file string, line_no int, line string")


def test_lines_are_whole_and_in_name_order(spark, tmp_path):
    (tmp_path / "b.txt").write_text("three\nhalf writ")
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "c.txt").write_text("")
    got = sorted(tuple(r) for r in L.read_lines(spark, f"file://{tmp_path}").collect())
    assert got == [("a.txt", 1, "one"), ("a.txt", 2, ""), ("a.txt", 3, "two"), ("b.txt", 1, "three")]


def test_empty_folder_is_refused(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no file"):
        L.read_lines(spark, f"file://{tmp_path}/none")


def test_outcomes_refuse_each_flaw(spark):
    cases = {
        "row: k1 | updated | p 1 | \"a | b\" | went | on": None, "row: k1 | updated | p 1 | \"a\\\" | b\" | x": None, "row:  | updated | p 1 | \"a\" | x": "no key", "row: k1 | retired | p 1 | \"a\" | x": "no outcome of its kind",
        "row: k1 | updated |  | \"a\" | x": "no page", "row: k1 | updated | p 1 | a | x": "no quoted name", "row: k1 | updated | p 1 | \"a\"": "no quoted name", "item: x | kept | y": "no item", "item: scopeItem:1 | updated | y": "no outcome of its kind",
        "item: scopeItem:1 | kept": "does not say what", "item: scopeItem:1 | kept | y | z": None, "row: k1": "no outcome of its kind",
    }
    got = {r["line"]: r for r in L.scan_outcomes(as_lines(spark, *cases)).collect()}
    assert {x: r["error"] for x, r in got.items()} == cases
    assert [(r["name"], r["what"]) for x, r in got.items() if x.startswith("row") and cases[x] is None] == [("a | b", "went | on"), ('a" | b', "x")]
    assert got["item: scopeItem:1 | kept | y | z"]["what"] == "y | z" and got["row: k1 | updated |  | \"a\" | x"]["key"] is None


def test_deleted_lines(spark):
    cases = {
        "deleted: a door, trade 09 65 00, package pkg-1, no work left": "pkg-1", "deleted: x, trade y, z, trade 09, package pkg-2, why, so": "pkg-2", "deleted: , trade 09, package pkg-1, why": None, "deleted: x, trade <code>, package pkg-1, why": None,
        "deleted: x, trade 09, package pkg-1": None, "deleted: x, trade 09, package pkg-1, ": None, "deleted: x, package pkg-1, why": None, "deleted: x, trade 09, package p-1, why": None, "deleted: x, trade 09, package pkg-, why": None,
    }
    got = {r["line"]: (r["package"], r["error"]) for r in L.scan_fold_report(as_lines(spark, *cases)).collect()}
    assert got == {x: (p, None if p else "not the shape of a deleted line") for x, p in cases.items()}


def test_packages(spark):
    body = '[{"id":"a","tradeCode":"09","codes":["1","2"],"name":"N"},{"id":"a","tradeCode":"09","codes":[]},{"tradeCode":"09","codes":[]},{"id":"b","tradeCode":" ","codes":[]},{"id":"c","tradeCode":"09","codes":[1]},{"id":"d","tradeCode":"09"}]'
    packages, refusals = L.scan_packages(spark.createDataFrame([("f", body), ("g", "{}"), ("h", "[")], "file string, json string"))
    assert [tuple(r) for r in packages.collect()] == [("f", 0, "a", "09", ["1", "2"], "N")]
    want = {("f", 1, "an id is there twice"), ("f", 2, "no id"), ("f", 3, "no tradeCode"), ("f", 4, "codes are no list of texts"), ("f", 5, "codes are no list of texts"), ("g", None, "no list of packages"), ("h", None, "no list of packages")}
    assert {tuple(r) for r in refusals.collect()} == want


def test_deliveries_keep_three_issues_apart(spark):
    cases = {'{"id":"x","issue": null,"stillReading":false}': None, '{"id":"x","issue":"set","stillReading":true}': None, '{"id":"x","stillReading":true}': "no issue", '{"id":"x","issue":"other","stillReading":true}': "another issue", '{"id":"x","issue":"set","stillReading":"no"}': "stillReading is no flag", '{"issue":"set"}': "no delivery", "{": "no delivery"}
    got = {r["line"]: r for r in L.scan_deliveries(as_lines(spark, *cases)).collect()}
    assert {x: r["error"] for x, r in got.items()} == cases
    lenient = {r["line"]: (r["issue"], r["still_reading"], r["error"]) for r in L.scan_deliveries(as_lines(spark, *cases), strict=False).collect()}
    assert lenient['{"id":"x","issue":"other","stillReading":true}'] == (None, True, None) and lenient['{"id":"x","issue":"set","stillReading":"no"}'] == ("set", False, None) and lenient["{"][2]


def test_broken_json_is_refused(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert L.read_strict(spark, f"file://{tmp_path}/x.json", "a long").first()["a"] == 1
    (tmp_path / "x.json").write_text('{"a": 1')
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        L.read_strict(spark, f"file://{tmp_path}/x.json", "a long").collect()


def test_ledger(spark):
    got = L.scan_ledger(as_lines(spark, "dispatch 1 P1 A-1 sheets S2, S1 , S2 purpose read", "verified 1 P1 A-1 created 3 items 2 result ok", "verified 1 P1 A-1 created 3", "pass: P1 created 9", " ", "note 1 P1 - kind a clause", "dispatch 1"))
    by = {r["line_no"]: r for r in got.collect()}
    assert by[1]["sheets"] == ["S1", "S2"] and by[1]["unit_id"] == "A-1" and by[2]["created"] == 3 and by[2]["result"] == "ok"
    assert by[3]["error"] == "no result" and by[4]["is_lead"] and by[4]["created"] is None and by[6]["unit_id"] == "-" and by[7]["error"] == "fields missing" and 5 not in by


def test_trades_and_names(spark):
    got = {r["line_no"]: r for r in L.scan_trades(as_lines(spark, "u1 trade 09  65 00 12", "u1 touched 03 30 00", "u1 trade 09 x", "", "u2 other")).collect()}
    assert (got[1]["code"], got[1]["n"]) == ("09 65 00", 12) and got[2]["kind"] == "touched" and got[3]["error"] and got[5]["error"] and 4 not in got
    names = L.scan_names(as_lines(spark, "u1\tscopeItem:u1-1\tDoor ", "u1\tscopeItem:u1-1\tGate", "u1\tnone", "no tab", "u1\tscopeItem:u2-1\tX", "a\tb"))
    assert {r["line_no"]: bool(r["error"]) for r in names.collect()} == {1: False, 2: False, 3: False, 5: True, 6: True}
    assert [tuple(r) for r in L.last_names(names).collect()] == [("u1", "scopeItem:u1-1", "Gate")]


def test_outcomes_and_fold_report(spark):
    got = {r["line_no"]: r for r in L.scan_outcomes(as_lines(spark, 'row: k1 | not found | p 3 | "a \\"b\\" | c" | it | went', "item: scopeItem:x | kept | why", "row: k1 | lost | p | \"a\" | x", "other")).collect()}
    assert (got[1]["name"], got[1]["what"], got[1]["outcome"]) == ('a "b" | c', "it | went", "not found") and got[2]["kind"] == "item" and got[3]["error"] and 4 not in got
    fold = [(r["label"], r["error"]) for r in L.scan_fold_report(as_lines(spark, "sealant kept: x", "kept: y", "", "deleted: no", "nothing")).orderBy("line_no").collect()]
    assert fold == [("sealant kept", None), ("kept", None), ("deleted", "not the shape of a deleted line"), (None, "opens with no label")]


def test_relation_and_jsonl(spark):
    text = spark.createDataFrame([("a = b=03 30 00, 03; x; =03; y=zz; q=",)], "t string")
    got = {r["place"]: (r["name"], r["codes"], r["error"]) for r in L.scan_relation(text, "t").collect()}
    assert got[0] == ("a = b", ["03 30 00", "03"], None) and [got[k][2] for k in (1, 2, 3, 4)] == ["no =", "no name", "not a code", "no code"]
    assert [r["k"] for r in L.scan_jsonl(as_lines(spark, '{"k": 1}', '{"k": ', "", '{"k": 2}'), "k long").collect()] == [1, 2]


def test_appends_batches_and_reconciliation(spark):
    current = spark.createDataFrame([("s", 7)], "subject string, entry_id long")
    asked = spark.createDataFrame([("s", None), ("s", 7), ("s", 6), ("t", None)], "subject string, supersedes_id long")
    assert sorted((r["subject"], r["supersedes_id"] or 0, r["accepted"]) for r in record.append(current, asked, ["subject"]).collect()) == [("s", 0, False), ("s", 6, False), ("s", 7, True), ("t", 0, True)]
    big = spark.range(501).select(F.lit("b").alias("batch"), "id")
    assert not record.batch_verdict(big, "batch", "id", F.lit(True)).first()["accepted"]
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {r["k"]: (r["verdict"], r["in_spec"]) for r in record.reconcile_three(a, b, None, "k").collect()} == {"x": ("index-only", None), "y": ("matched", None), "z": ("set-only", None)}
