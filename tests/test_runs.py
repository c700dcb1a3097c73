"""Placement, runs, next actions, review waits, revisions and totals: every rule by a case that breaks it."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, placement, record, runs


@pytest.mark.parametrize(
    ("code", "home", "near"),
    [("09 65 00", "09 65", 0), ("09 65 13", "09 65", 102), ("09 60 00", "09 65", 2), ("09 00 00", "09 65", None), ("09 00 00", "09", 0), ("09 65 16.13", "09 65 16", 102), ("09 70 00", "09 65", None), ("09 65 00", "09 65 13", 3), ("09 65 00", "08 65", None), ("09 65 10", "09 65 13", 2)],
)
def test_nearness(spark, code, home, near):
    r = spark.range(1).select(placement.nearness(F.lit(code), F.lit(home)).alias("n")).first()
    assert r["n"] == near


def test_steps_of_placement(spark):
    packages = spark.createDataFrame([("09 65 00", ["09 65 00", "09 60 00", None, "09 65 00"]), ("09 60 00", ["09 65 00"]), ("05 50 00", ["05 00 00"]), ("22 10 00", ["22 11 00", "22 12 00"]), ("22 20 00", ["22 13 00"]), (None, ["07 00 00"])], "trade_code string, codes array<string>")
    files = [
        ("home", ["09 65"], ["09 65"], None), ("second", ["01 10", "09 61"], [], None), ("division", ["05 12"], ["05 12"], None), ("else", ["31 10"], ["22 13"], "home"), ("lost else", ["31 10"], ["22 11"], "nobody"),
        ("numbers", ["31 10"], ["22 11", "22 12", "22 13"], None), ("tie", ["31 10"], ["22 11", "22 13"], None), ("none", ["07 10"], ["07 10"], None), ("bare", [], [], None), ("chain", ["31 10"], [], "else"), ("null", None, None, None),
    ]
    got = {r["file"]: (r["package"], r["step"]) for r in placement.place(spark.createDataFrame(files, "file string, homes array<string>, numbers array<string>, otherwise string"), packages).collect()}
    assert got == {
        "home": ("09 65 00", "home"), "second": ("09 65 00", "home"), "division": ("05 50 00", "division"), "else": ("09 65 00", "else"), "lost else": ("22 10 00", "numbers"), "numbers": ("22 10 00", "numbers"), "tie": ("22 10 00", "numbers"),
        "none": (None, None), "bare": (None, None), "chain": (None, None), "null": (None, None),
    }


def manifest(**kw):
    return {"deliveryId": "D1", "issue": "set", "readFrom": ["D0", "D1"], "unitTag": "i3", "unitTagCheck": {"subjectPrefix": "scopeItem:i3-", "count": 0}} | kw


def scanned(spark, *manifests):
    files = [("p", f"r{i}", json.dumps(m) if not isinstance(m, str) else m) for i, m in enumerate(manifests)]
    good, refused = runs.scan_runs(spark.createDataFrame([*files, (None, "x", "{}"), ("q", "other", json.dumps(manifest()))], "project string, folder string, json string"))
    return {r["folder"]: r for r in good.where("project = 'p'").collect()}, {r["folder"]: r["rule"] for r in refused.where("project = 'p'").collect()}


def test_a_run_is_read(spark):
    good, refused = scanned(spark, manifest(), manifest(deliveryId="D2", readFrom=["D2"], unitTag="i12", unitTagCheck={"subjectPrefix": "scopeItem:i12-", "count": 0}, label="Addendum"))
    assert not refused and (good["r0"]["label"], good["r0"]["tag_no"], good["r1"]["label"], good["r1"]["tag_no"]) == ("D1", 3, "Addendum", 12)


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ("[]", "no run file"), ("{", "no run file"), ({"deliveryId": ""}, "names no delivery"), ({"deliveryId": 7}, "names no delivery"), ({"issue": "other"}, "issue is neither set nor addendum"), ({"readFrom": ["D1", "D1"]}, "readFrom is no list of distinct deliveries with its own"),
        ({"readFrom": ["D0"]}, "readFrom is no list of distinct deliveries with its own"), ({"readFrom": ["D1", 3]}, "readFrom is no list of distinct deliveries with its own"), ({"unitTag": "I3"}, "no unit tag"), ({"unitTag": "i0"}, "no unit tag"), ({"unitTagCheck": {"subjectPrefix": "scopeItem:i3", "count": 0}}, "no count under its tag"),
        ({"unitTagCheck": {"subjectPrefix": "scopeItem:i3-", "count": False}}, "no count under its tag"), ({"unitTagCheck": {"subjectPrefix": "scopeItem:i3-", "count": 2}}, "its tag is taken on the record"),
    ],
)
def test_each_rule_of_a_run(spark, change, rule):
    assert scanned(spark, change if isinstance(change, str) else manifest(**change))[1] == {"r0": rule}


def test_siblings_have_tags_and_deliveries_of_their_own(spark):
    other = {"unitTag": "i4", "unitTagCheck": {"subjectPrefix": "scopeItem:i4-", "count": 0}}
    assert scanned(spark, manifest(), manifest(deliveryId="D2", readFrom=["D2"]))[1] == {"r0": "its tag is another run's", "r1": "its tag is another run's"}
    assert scanned(spark, manifest(), manifest(**other))[1] == {"r0": "its delivery is another run's", "r1": "its delivery is another run's"}


def test_what_comes_next(spark):
    d = "project string, ord int, delivery_id string, issue string, set_id string, still_reading boolean"
    deliveries = [
        ("resume", 1, "a", "set", "a", True), ("two", 1, "a", "set", "a", False), ("wait", 1, "a", "set", "a", False), ("wait", 2, "b", None, None, True), ("wait", 3, "c", None, None, True), ("start", 1, "a", "set", "a", False), ("start", 2, "b", "set", "b", None),
        ("addendum", 1, "a", "set", "a", False), ("addendum", 2, "b", "addendum", "a", False), ("addendum", 3, "c", "addendum", "a", False), ("old", 1, "a", "set", "a", False), ("old", 2, "b", "addendum", "a", False), ("old", 3, "c", "set", "c", False), ("no set", 1, "a", None, None, False), (None, 1, "a", "set", "a", False),
    ]
    have = [("resume", "f", "a", 4, False), ("two", "f", "a", 1, False), ("two", "g", "b", 2, None), ("addendum", "f", "a", 4, True), ("addendum", "g", "b", 7, True), ("old", "f", "c", 1, True), ("gone", "f", "x", 2, True)]
    got = runs.next_actions(spark.createDataFrame(deliveries, d), spark.createDataFrame(have, "project string, folder string, delivery_id string, tag_no long, closed boolean")).collect()
    assert {r["project"]: tuple(r)[1:] for r in got} == {
        "resume": ("resume", "a", "f", None), "two": ("refusal", None, None, None), "wait": ("wait", "b", None, None), "start": ("start", "b", None, 1), "addendum": ("start", "c", None, 8), "old": ("none", None, None, None), "no set": ("none", None, None, None), "gone": ("none", None, None, None),
    }


def test_reviews_wait_for_what_they_continue_and_their_trades(spark):
    rows = [("A", 1, "u1", None, "09"), ("A", 1, "u2", None, None), ("B", 2, "u3", "u1", "05"), ("C", 3, "u4", None, "09"), ("D", 4, None, "u9", None), ("C", 3, "u4", None, "09"), ("E", 0, "u5", "u1", "07")]
    got = graph.waits_of_reviews(spark.createDataFrame(rows, "pass string, position int, unit string, continues string, trade string"))
    assert {tuple(r) for r in got.collect()} == {("B", "A"), ("C", "A")} and got.count() == 2


def test_revisions_by_their_mode(spark):
    heads = spark.createDataFrame([(p, "k", line, f"{p}{line}", v) for p in "wsnt" for line, v in (("1", "a"), ("2", "b"), ("3", None))], "party string, package string, line string, entry_id string, value string")
    named = spark.createDataFrame([(p, "k", line, v) for p in "wsn" for line, v in (("1", "x"), ("4", "new"))] + [("w", "k", "1", "x"), ("t", "k", "1", "x"), ("t", "k", "1", "y"), ("s", "k", "2", "b")], "party string, package string, line string, value string")
    modes = spark.createDataFrame([("w", "k", "wholesale"), ("s", "k", "surgical"), ("t", "k", "surgical"), ("u", "k", "both"), ("v", "k", "wholesale"), ("v", "k", "surgical")], "party string, package string, mode string")
    writes, refused = record.revision(heads, named, modes)
    assert {(r["party"], r["line"], r["value"], r["cleared"], r["supersedes_id"]) for r in writes.collect()} == {("w", "1", "x", False, "w1"), ("w", "2", None, True, "w2"), ("w", "4", "new", False, None), ("s", "1", "x", False, "s1"), ("s", "4", "new", False, None)}
    assert {tuple(r) for r in refused.collect()} == {("n", "k", "no mode"), ("t", "k", "a line is named twice"), ("u", "k", "another mode"), ("v", "k", "two modes")}


def test_alternates_move_no_total_until_accepted(spark):
    rows = [("a", 1, False, 100, None, None, None), ("a", 2, False, 50, "add", 30, False), ("a", 3, True, None, "deduct", 20, True), ("a", 4, True, 7, "add", 1, True), ("a", 5, False, None, "add", -3, True), ("a", 6, False, 9, None, 3, True), ("a", 7, False, 9, "add", None, True), ("a", 8, False, 9, "less", 3, True), ("b", 9, True, None, "add", 5, True)]
    totals, refused = record.bid_totals(spark.createDataFrame(rows, "party string, row int, additional boolean, amount int, direction string, alternate int, accepted boolean"))
    assert {tuple(r) for r in totals.collect()} == {("a", 150, -20, 130), ("b", None, 5, None)}
    assert {r["row"]: r["rule"] for r in refused.collect()} == {4: "an additional item with an amount and an alternate", 5: "a negative magnitude", 6: "no direction", 7: "no magnitude", 8: "another direction"}
