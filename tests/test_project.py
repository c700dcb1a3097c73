"""The citation index, continuations, nested pages, comparisons, plans, summaries, locations, carries and regions: every rule by a case that breaks it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import carry, citations, continuations, recheck, record, regions
from tessera.sources import comparison, grid, plan

# -- citation index ---------------------------------------------------------------------------------------------------------------


def test_codes_are_whole_words_in_any_case(spark):
    pages = spark.createDataFrame([(1, "see A-101. and B-2"), (2, "XA-101 A-1012 A-101.2"), (3, "(a-101)\nDoor  12 b.1,"), (4, None), (5, ""), (6, "door 12\tB.1 one two three four five six")], "page int, text string")
    codes = spark.createDataFrame([("a-101",), ("b-2",), ("door 12 b.1",), ("one two three four five six",), ("one two three four nine",), ("",)], "code string")
    got = sorted((r["page"], r["code"]) for r in citations.find_codes(pages, codes).collect())
    assert got == [(1, "a-101"), (1, "b-2"), (3, "a-101"), (3, "door 12 b.1"), (6, "door 12 b.1"), (6, "one two three four five six")]
    assert citations.find_codes(pages, codes.where("false")).collect() == []


def test_codes_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"{c}{n}" for c in "ab" for n in range(4)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    codes = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(60)}
    pages = spark.createDataFrame(list(enumerate(texts)), "page long, text string").withColumn("code", F.lit("clash"))
    got = {(r["page"], r["code"]) for r in citations.find_codes(pages, spark.createDataFrame([(c,) for c in codes], "code string")).collect()}
    assert got == {(i, c) for i, t in enumerate(texts) for c in codes if f" {c} " in f" {t} "}


def test_index_leaves_nine_kinds_open(spark):
    pages = spark.createDataFrame(
        [(1, "A-1 T-7 door 1 b", True, False, True), (2, "A-1 plain X", False, None, True), (3, "A-1", True, False, False), (4, "OLD-1", True, True, True), (5, "A-1", True, True, True), (6, "A-1 N.5", True, False, True)],
        "page int, text string, is_sheet boolean, replaced boolean, drawable boolean",
    )
    rows = [("d1", "definition", "a-1"), ("d1", "definition", "a-1"), ("d2", "definition", "old-1"), ("d3", "definition", "gone-1"), ("d4", "definition", "X"), ("d5", "definition", "plain"), ("d6", "definition", "door 1 b"), ("d7", "definition", "n.5"),
            ("i1", "item", "A-1"), ("i2", "item", "t-7"), ("i3", "item", "t-8"), ("i4", "item", "door 1"), ("i5", "item", None), (None, "item", "a-1")]
    rec = spark.createDataFrame(rows, "subject string, kind string, code string")
    cited = spark.createDataFrame([("i1", 1), ("i9", 1)], "subject string, page int")
    fresh, left = citations.index_citations(pages, rec, cited)
    assert {tuple(r) for r in fresh.collect()} == {("d1", 1), ("d1", 6), ("d6", 1), ("d7", 6), ("i1", 6), ("i2", 1)}
    assert {(r["kind"], r["subject"], r["code"], r["page"]) for r in left.collect()} == {
        ("codeOnlyOnReplacedPages", "d2", "old-1", None), ("codeNoLocation", "d3", "gone-1", None), ("codeTooShort", "d4", "x", None), ("codeIsAWord", "d5", "plain", None), ("unmatchedTag", "i3", "t-8", None),
        ("fragmentUnresolvable", "i4", "door 1", None), ("pageNotASheet", None, "a-1", 2), ("hitNotDrawable", None, "a-1", 3),
    }
    fresh, left = citations.index_citations(pages, rec, cited, cap=2)
    assert [tuple(r) for r in fresh.orderBy("subject", "page").collect()] == [("d1", 1), ("d1", 6)]
    counts = {r["kind"]: r["n"] for r in citations.leftover_counts(left).collect()}
    assert counts == dict.fromkeys(citations.LEFTOVERS, 1) | {"overRunCap": 4}
    none = citations.index_citations(pages.where("false"), rec.where("false"), cited.where("false"))
    assert [x.collect() for x in none] == [[], []]


# -- continuations ----------------------------------------------------------------------------------------------------------------

ASK = "pass string, ordinal long, review string, units long, trade string, number_from long"


def bound(spark, rows, **kw):
    got = continuations.bind_continuations(spark.createDataFrame(rows, ASK).withColumn("outcome", F.lit("clash")).repartition(3), **kw)
    return {(r["pass"], r["ordinal"]): (r["bound_pass"], r["continuation"], r["outcome"]) for r in got.collect()}


def test_three_outcomes_and_a_pass_that_does_not_wait(spark):
    rows = [("P", i, f"r{i}", 1, None, None) for i in range(1, 5)]  # holds 1 of 2: r1 after its unit, r2 and r3 in b, r4 in c, which waits for P alone
    rows += [("P", 5, "r2", 1, None, None), ("P", 6, "r5", 1, None, None)]  # r2's continuation sits in the full b: c doesn't wait for b, so d; then P takes c
    got = bound(spark, rows, cap=2)
    assert [got["P", i][0] for i in range(1, 7)] == ["P", "Pb", "Pb", "Pc", "Pd", "Pc"]
    assert [got["P", i][2] for i in range(1, 7)] == ["after its unit", "new letter", "carried", "new letter", "new letter", "carried"]
    assert got["P", 5][1] == "r2c-2"


def test_passes_of_a_trade_wait_for_each_other(spark):
    rows = [("P", i, f"r{i}", 1, None if i == 1 else "09", None) for i in range(1, 5)] + [("P", 5, "r2", 1, "09", None)]
    assert bound(spark, rows, cap=2)["P", 5][:1] == ("Pc",)  # c holds a unit of b's trade, so it waits for b


def test_numbers_run_on_and_letters_end(spark):
    rows = [("P", i, f"r{i}", 2, None, 40 if i == 3 else None) for i in range(1, 60)] + [("Q", 1, "r1", None, None, 6), (None, 1, "x", 1, None, None), ("Q", None, "x", 1, None, None)]
    got = bound(spark, rows, cap=2)
    assert got["P", 3][1] == "r3c-41" and got["Q", 1] == ("Q", "r1c-7", "after its unit") and len(got) == 60
    assert got["P", 50][0] == "Pz" and got["P", 51] == (None, None, "no pass left")
    assert bound(spark, []) == {}


# -- nested pages -----------------------------------------------------------------------------------------------------------------


def occurrence(**kw):
    return {"fileId": "f", "pageInPdf": 2, "deliveryId": None, "opensAs": "k"} | kw


def test_each_rule_of_a_page_list(spark):
    own = {"fileId": "g", "pageInPdf": 1, "selected": True}
    without = {k: v for k, v in occurrence(pageInPdf=30).items() if k != "deliveryId"}
    lists = {
        1: [own, occurrence(), occurrence(pageInPdf=3, deliveryId="D1"), occurrence(pageInPdf=4, deliveryId="D9")], 2: [], 3: None, 4: [occurrence()], 5: [own, own], 6: [own | {"pageInPdf": 2}, occurrence()], 7: [own, without],
        8: [own, occurrence(pageInPdf=5, deliveryId=" ")], 9: [own, occurrence(pageInPdf=6, deliveryId=7)], 10: [own, occurrence(fileId="", opensAs=None, pageInPdf=True)], 11: [own, occurrence(pageInPdf=7), occurrence(pageInPdf=7, deliveryId="D9")],
        12: [own, occurrence()], 13: [own, occurrence(fileId="g", pageInPdf=2)], 14: [own, occurrence(pageInPdf=0)], 15: [own, 3], 16: [own | {"selected": "true"}, occurrence()], 17: [own, occurrence(fileId="g")], 18: [own, occurrence(deliveryId="D9", pageInPdf=None)],
    }
    rows = [(i, f"S-{i}", "A", "g", 100 + i if i != 13 else 2, json.dumps({"pageOccurrences": [x if x is not own else own | {"pageInPdf": 100 + i if i != 13 else 2} for x in v] if v is not None else "none"})) for i, v in lists.items()]
    df = spark.createDataFrame(rows, "row_ord int, number string, discipline string, file_id string, page int, json string").withColumn("raw", F.parse_json("json")).withColumn("pos", F.lit(9))
    further, carried, refusals = grid.further_pages(df, ["D1"])
    assert sorted((r["row_ord"], r["pos"], r["file_id"], r["page"], r["unit_key"]) for r in further.collect()) == [(1, 1, "f", "2", "S-1@f#2"), (1, 2, "f", "3", "S-1@f#3"), (11, 1, "f", "7", "S-11@f#7")]
    assert sorted((r["row_ord"], r["page"], r["delivery_id"]) for r in carried.collect()) == [(1, "4", "D9"), (18, "", "D9")]
    assert sorted((r["row_ord"], r["pos"] or -1, r["rule"]) for r in refusals.collect()) == sorted([
        (3, -1, "no pageOccurrences list"), (4, -1, "not one page is its own"), (5, -1, "not one page is its own"), (6, -1, "its own page is another"), (7, 1, "no deliveryId"), (8, 1, "deliveryId is neither null nor an id"),
        (9, 1, "deliveryId is neither null nor an id"), (10, 1, "no file and no key it opens as and no page number"), (11, 2, "listed twice"), (12, 1, "already another row's page"), (13, 1, "listed twice"), (14, 1, "no page number"),
        (15, -1, "no pageOccurrences list"), (16, -1, "not one page is its own"), (17, 1, "already another row's page"),
    ])


# -- comparison pages -------------------------------------------------------------------------------------------------------------


def item(i, **kw):
    return {"kind": "scopeItem", "open": True, "subject": f"scopeItem:{i}", "entryIds": ["b", "a"], "sheetNumber": "S", "old": {"fileId": "f", "page": i}, "box": [1, 2]} | kw


def page(refs, offset=0, total=None, manuals=None, **kw):
    out = {"delivery": {"id": "D"}, "ruleVersion": 7, "complete": True, "referenceRows": {"total": len(refs) if total is None else total, "offset": offset, "rows": refs}}
    return out | ({"manualRows": manuals} if manuals else {}) | kw


def scanned(spark, *pages):
    rows = [("x", f"page-{i:03}.json", json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(pages)]
    out, refusals = comparison.scan_comparison(spark.createDataFrame(rows, "folder string, file string, json string"), spark.createDataFrame([("x", "D", 7)], "folder string, delivery_id string, rule_version int"))
    return sorted((r["list"], r["ord"], r["subject"]) for r in out.collect()), {r["rule"] for r in refusals.collect()}


def test_pages_that_fit_are_taken(spark):
    manual = {"total": 1, "offset": 0, "rows": [item(1, section="09 65")]}  # the same but for its section: another identity
    rows, rules = scanned(spark, page([item(1), item(2)], 0, 3, manual), page([item(3)], 2, 3, {"total": 1, "offset": 2, "rows": []}))
    assert not rules and rows == [("manualRows", 0, "scopeItem:1"), ("referenceRows", 0, "scopeItem:1"), ("referenceRows", 1, "scopeItem:2"), ("referenceRows", 2, "scopeItem:3")]
    assert scanned(spark, page([])) == ([], set())


@pytest.mark.parametrize(
    ("pages", "rule"),
    [
        (["{"], "not a page"), (["[]"], "not a page"), ([page([], delivery={"id": "E"})], "another delivery"), ([page([], ruleVersion=8)], "another rule version"), ([page([], complete="true")], "not complete"), ([page([], referenceRows=[])], "no referenceRows list"),
        ([page([], manualRows={"total": 0, "offset": 0})], "no manualRows list"), ([page([item(1)], 0, 3), page([item(2)], 2, 3)], "starts elsewhere"), ([page([item(1)], 0, 2), page([item(2)], 1, 3)], "its total changes"), ([page([item(1)], 0, 2)], "rows are missing"),
        ([page([item(1), item(1, entryIds=["a", "b"])])], "a row is there twice"), ([page([item(1, kind="other")])], "a row is no scope item's"), ([page([item(1, open=None)])], "a row has no open flag or no subject"), ([page([item(1, itemOnCurrentPage="yes")])], "itemOnCurrentPage is no flag"),
        ([page([], manuals={"total": 1, "offset": 0, "rows": [item(1)]})], "a manual row names no section"),
    ],
)
def test_each_rule_of_a_comparison(spark, pages, rule):
    assert rule in scanned(spark, *pages)[1]


def test_folders_without_pages_or_runs(spark):
    pages = spark.createDataFrame([("y", "p", json.dumps(page([]))), (None, "p", "{}")], "folder string, file string, json string")
    runs = spark.createDataFrame([("x", "D", 7)], "folder string, delivery_id string, rule_version int")
    assert {(r["folder"], r["rule"]) for r in comparison.scan_comparison(pages, runs)[1].collect()} == {("x", "no page"), ("y", "no run names its delivery")}


# -- read plans and summaries -----------------------------------------------------------------------------------------------------


def as_lines(spark, **files):
    return spark.createDataFrame([(f, i, x) for f, text in files.items() for i, x in enumerate(text.split("\n"))], "file string, line_no int, line string")


PLAN = """
# Read plan: window 1

units: 9
A1-9. outside a block

### A1. Vocabulary, discipline A

window: 1
units: 5
units: 2
units verified: 0
Units: 7

A1-1. A-0.11, page 3: (no title)
A1-0. not a number
A1-2. A-0.21: x. y: z
text A1-3. no unit

### B1. Other

units: 1
summed: no, no summary on file

B1-1. B-0.01

## Deliberately left out

A1-4. left out
### C1. Not a pass
units: 3"""


def test_plan_blocks(spark):
    three = PLAN.replace("window 1\n\nunits", "window 3\n\nunits").replace("A1-1. A", "1. rev-09-1: A").replace("A1-2. A", "2. rev-08-1: A").replace("B1-1. B-0.01", "1. rev-07-1: B")
    twice = PLAN.replace("A1-2. A", "A1-1. A").replace("### B1.", "### A1.")
    passes, units, fields, refusals = plan.scan_plan(as_lines(spark, a=PLAN, b=three, c="", d="# Plan\n### A1. x", e=PLAN.replace("units: 2\n", ""), f=PLAN.replace("units: 1\n", ""), g=twice, h="# Read plan: window 7"))
    assert sorted(tuple(r) for r in passes.where("file in ('a', 'b')").collect()) == [("a", "1", "A1", 1, 2, 2), ("a", "1", "B1", 2, 1, 1), ("b", "3", "A1", 1, 2, 2), ("b", "3", "B1", 2, 1, 1)]
    got = sorted((r["file"], r["pass"], r["ord"], r["unit"], r["text"]) for r in units.where("file in ('a', 'b')").collect())
    assert got == [("a", "A1", 1, "A1-1", "A-0.11, page 3: (no title)"), ("a", "A1", 2, "A1-2", "A-0.21: x. y: z"), ("a", "B1", 1, "B1-1", "B-0.01"), ("b", "A1", 1, "rev-09-1", "A-0.11, page 3: (no title)"), ("b", "A1", 2, "rev-08-1", "A-0.21: x. y: z"), ("b", "B1", 1, "rev-07-1", "B")]
    assert {(r["pass"], r["field"], r["value"]) for r in fields.where("file = 'a'").collect()} == {("A1", "window", "1"), ("A1", "units", "2"), ("A1", "units verified", "0"), ("B1", "units", "1"), ("B1", "summed", "no, no summary on file")}
    assert {tuple(r) for r in refusals.collect()} == {("c", None, "no read plan"), ("d", None, "no read plan"), ("h", None, "no read plan"), ("e", "A1", "units and unit lines differ"), ("f", "B1", "names no units"), ("g", "A1", "a unit is listed twice"), ("g", "A1", "a pass has two blocks")}


SUMMARY = f"""window: 2   pass: P1
units read: A-1, A-2
per unit: A-1 created 3 items 2 conflicts 0 verified no
per unit: A-1 created 4 items 2 conflicts 0 read 2 verified yes
per unit: A-2 created - items - verified no
per unit: A-3 created x items - verified no
totals verified: created 7 (entry count under the unit prefixes), items 5 (reader's own item count), updated 1, questions 2 replied 3
trades: 09 65 00 x3, a x b x10, 09 65 00 x1
ledger: /x, appended through line
ledger lines: 12 sha256 {"ab" * 32}"""
RECHECKED = "recheck: rows recited 1, updated 2, removed 3, not found 4; items retired 5, kept 6, refused 7"


def test_summaries(spark):
    three = SUMMARY.replace("window: 2", "window: 3") + "\nreview: pages opened 8, searches 9"
    again = SUMMARY.replace("window: 2", "window: r").replace("trades: 09 65 00 x3, a x b x10, 09 65 00 x1", "trades: no trade on any unit of this pass") + "\n" + RECHECKED
    summaries, units, trades, refusals = plan.scan_summaries(as_lines(spark, a=SUMMARY, b=three, c=again))
    got = {r["file"]: r for r in summaries.collect()}
    assert tuple(got["a"])[:9] == ("a", "2", "P1", 7, 5, 1, 2, 3, 14) and got["a"]["ledger_lines"] == 12 and got["a"]["recheck"] is None
    assert (got["b"]["pages_opened"], got["b"]["searches"], got["c"]["items"]) == (8, 9, 0)
    assert got["c"]["recheck"] == {"recited": 1, "updated": 2, "removed": 3, "not found": 4, "retired": 5, "kept": 6, "refused": 7}
    assert {tuple(r) for r in units.where("file = 'a'").collect()} == {("a", "A-1", 4, True), ("a", "A-2", None, False)}
    assert {tuple(r) for r in trades.where("file = 'a'").collect()} == {("a", "09 65 00", 4), ("a", "a x b", 10)} and refusals.collect() == []


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("", "no summary"), (SUMMARY.replace("pass: P1", ""), "no summary"), (SUMMARY.replace("12 sha256", "12 sha"), "no ledger line"), (SUMMARY.replace("updated 1", "updated"), "no totals"), (SUMMARY.replace("trades: ", "trade: "), "no trades line"),
        (SUMMARY.replace("trades: 09 65 00 x3, a x b x10, 09 65 00 x1", "trades: no trades file for this pass"), "summed with no trades file"), (SUMMARY.replace("09 65 00 x3", "09 65 00"), "not the shape of a trades line"),
        (SUMMARY.replace("window: 2", "window: 3"), "no review line"), (SUMMARY.replace("window: 2", "window: r"), "no recheck line"), (SUMMARY.replace("window: 2", "window: r") + "\n" + RECHECKED.replace("kept 6, ", ""), "no recheck line"),
    ],
)
def test_each_rule_of_a_summary(spark, text, rule):
    out = plan.scan_summaries(as_lines(spark, a=text))
    assert [tuple(r) for r in out[3].collect()] == [("a", rule)] and out[0].collect() == []


# -- record service ---------------------------------------------------------------------------------------------------------------


def test_retractions_and_their_reversals(spark):
    rows = [
        (1, "a", "locatedAt", None, 5, "p1", None), (2, "a", "retractedBy", None, 6, None, [1]),  # removed
        (3, "b", "locatedAt", None, 5, "p3", None), (4, "b", "retractedBy", None, 6, None, [3]), (5, "b", "retractionReversal", None, 7, None, [4]),  # a chain of three: located
        (6, "c", "locatedAt", None, 5, "p6", None), (7, "c", "retractedBy", None, 6, None, [6]), (8, "c", "retractedBy", None, 6, None, [6]), (9, "c", "retractionReversal", None, 7, None, [7]),  # one still stands
        (10, "d", "locatedAt", None, 5, "old", None), (11, "d", "locatedAt", 10, 4, "new", None), (12, "e", "notedAs", None, 1, None, None), (13, "f", "locatedAt", None, 9, "hi", None), (14, "f", "locatedAt", None, 9, "lo", None),
        (15, "g", "locatedAt", None, None, "x", None), (16, "h", "locatedAt", 15, 1, "y", None), (17, None, "locatedAt", None, 1, "z", None), (18, "f", "retractedBy", None, 1, None, [99]),
    ]
    df = spark.createDataFrame(rows, "entry_id int, subject string, predicate string, supersedes_id int, asserted_at int, value string, names array<int>").withColumn("state", F.lit("clash"))
    got = {r["subject"]: (r["state"], r["entry_id"], r["value"]) for r in record.live_locations(df).collect()}
    assert got == {"a": ("removed", None, None), "b": ("located", 3, "p3"), "c": ("removed", None, None), "d": ("located", 11, "new"), "e": ("never located", None, None), "f": ("located", 13, "hi"), "g": ("located", 15, "x"), "h": ("located", 16, "y")}


def test_carries_follow_pages_and_balance(spark):
    steps = [(i, i + 1, True) for i in range(1, 20)] + [(30, 31, True), (31, 32, False), (32, 33, True), (40, 41, True), (41, 42, True), (42, 40, True), (50, 50, True), (60, 61, None), (None, 1, True)]
    steps = spark.createDataFrame(steps, "page int, next_page int, same boolean")
    ways = {r["page"]: (r["at"], r["end"]) for r in carry.current_pages(steps).collect()}
    assert ways[1] == ways[19] == (20, "current") and ways[30][1] == ways[31][1] == "changed" and ways[32] == (33, "current") and {ways[i][1] for i in (40, 41, 42, 50)} == {"cycle"} and ways[60][1] == "changed"
    refs = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "x"), (3, "b", 1, "x"), (4, "c", 1, None), (5, "d", 30, "x"), (6, "e", 40, "x"), (7, "f", 20, "x"), (8, "a", 1, "y"), (9, None, 1, "x")], "ref int, subject string, page int, box string")
    out, balance = carry.carry_forward(refs, steps, spark.createDataFrame([("b", 20)], "subject string, page int"))
    got = {r["ref"]: (r["to_page"], r["outcome"]) for r in out.collect()}
    assert got == {1: (20, "carried"), 2: (20, "already there"), 3: (20, "already there"), 4: (20, "left"), 5: (None, "not carried"), 6: (None, "not carried"), 8: (20, "carried"), 9: got[9]}
    assert balance.first().asDict() == {"boxes": 7, "no_box": 1, "carried": 2 + (got[9][1] == "carried"), "already_there": 2 + (got[9][1] == "already there"), "not_carried": 2, "left": 1, "holds": True}


def test_regions_equal_brute_force(spark):
    rng = random.Random(2)
    spans = [(rng.randint(0, 2), i, f"w{i}", *sorted(rng.uniform(-50, 300) for _ in range(2))) for i in range(200)]
    spans = [(p, i, t, x0, y, x1, y + rng.uniform(0, 90)) for p, i, t, x0, x1 in spans for y in [rng.uniform(-50, 300)]] + [(0, 900, "bad", 5.0, 5.0, 1.0, 9.0), (0, 901, "null", None, 0.0, 1.0, 1.0), (0, 902, "edge", 72.0, 72.0, 72.0, 72.0)]
    asks = [(f"r{i}", rng.randint(0, 2), x, y, x + rng.uniform(0, 200), y + rng.uniform(0, 200)) for i in range(40) for x, y in [(rng.uniform(-50, 250), rng.uniform(-50, 250))]] + [("edge", 0, 0.0, 0.0, 72.0, 72.0), ("all", 1, None, None, None, None)]
    s = spark.createDataFrame(spans, "page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame(asks, "region string, page int, x0 double, y0 double, x1 double, y1 double")
    got = [(x["region"], x["ord"]) for x in regions.spans_in(s, r, 72.0).collect()]
    fine = [x for x in spans if None not in x and x[3] <= x[5]]
    want = [(q[0], x[1]) for q in asks for x in fine if x[0] == q[1] and (q[2] is None or x[3] <= q[4] and q[2] <= x[5] and x[4] <= q[5] and q[3] <= x[6])]
    assert sorted(got) == sorted(want) and ("edge", 902) in got


def test_answers_go_on_to_the_end(spark):
    found = spark.createDataFrame([("r", 1, i, t, 0.0, 0.0, 1.0, 1.0) for i, t in enumerate(["ab", "c" * 40, "d", "e", "f" * 9])], "region string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    offset, seen = 0, []
    while offset is not None:
        a = regions.answers(found, spark.createDataFrame([("r", offset), ("none", 0)], "region string, offset int"), 10).where("region = 'r'").first()
        seen.append([x["ord"] for x in a["spans"]])
        assert a["span_count"] == 5
        offset = a["next_offset"]
    assert seen == [[0], [1], [2, 3], [4]]
    assert regions.answers(found, spark.createDataFrame([("none", None)], "region string, offset int")).first()["spans"] == []


# -- recheck and delivery plans ---------------------------------------------------------------------------------------------------


def test_decisions_in_their_order(spark):
    rows = [("lost", "not found", "s1", ""), ("lost", "recited", "s2", ""), ("stays", "removed", "s", ""), ("stays", "updated", "s", ""), ("cur", "removed", "s", ""), ("set", "removed", "s", ""), ("go", "removed", "s", "x" * 2000), ("long", "removed", "s", "x" * 1999 + "\U0001f600"), ("none", None, None, ""), (None, "removed", "s", "")]
    rows += [("many", "removed", f"s{i}", "") for i in range(11)] + [("ten", "removed", f"s{i % 10}", "") for i in range(20)]
    after = spark.createDataFrame([("cur", False, None), ("cur", True, True), ("set", True, True), ("go", True, False), ("go", None, None), ("other", False, True)], "subject string, open boolean, on_current_page boolean")
    got = recheck.item_decisions(spark.createDataFrame(rows, "subject string, outcome string, source string, words string"), after, F.col("words"))
    assert {r["subject"]: (r["decision"], r["why"]) for r in got.collect()} == {
        "lost": ("his", "a row not found"), "stays": ("stays", None), "cur": ("kept", "cited on a current page"), "set": ("kept", "cited on another page of the current set"), "go": ("retire", None), "ten": ("retire", None),
        "many": ("his", "shows on more places than one retirement names"), "long": ("his", "runs past the length of a retirement"), "none": ("stays", None),
    }


@pytest.mark.parametrize("carried", [False, True])
def test_categories_are_nine(spark, carried):
    rows = [("a", False, "same", None), ("a", False, "moved", None), ("a", True, "gone", "recited"), ("a", None, "gone", "updated"), ("a", True, "gone", "not found"), ("go", True, "gone", "removed"), ("no", True, "gone", "removed"), ("his", True, "gone", "removed"), ("a", True, "gone", "removed"), ("x", True, "gone", None), ("x", True, "gone", "other")]
    df = spark.createDataFrame(rows, "subject string, open boolean, answer string, outcome string").withColumn("i", F.monotonically_increasing_id())
    decisions = spark.createDataFrame([("go", "retire"), ("no", "retire"), ("his", "his"), ("a", "stays")], "subject string, decision string")
    out = recheck.row_categories(df, decisions, spark.createDataFrame([("no",), ("no",)], "subject string"), carried)
    assert [r["category"] for r in out.orderBy("i").collect()] == ["carried" if carried else "pass", "pass", "recited", "updated", "left", "removed", "refused", "held", "kept", None, None]
    assert recheck.open_rows_agree(out).first().asDict() == {"open_rows": 9, "sorted": 7, "agrees": False} and recheck.open_rows_agree(out.where("subject <> 'x'")).first()["agrees"]


def test_plans_of_deliveries(spark):
    text = 'plan: D-2 | Set | two | written 2026-01-05\nmeasured: last poll x, rule version 3, complete\nmeasured: rule version 9\nnote\npass: partial\nread: A-1, , A-2\nread: B-1\ncarry: left out\nstatus: shown 10:03\nstatus: approved 10:04 "go "ahead""\nstatus: lost 1\nstatus: stopped\ncarried: 1\ncarried: 2'
    files = {"a": text, "b": "plan: D-3 | x | written t\npass: full\nread: A-1\nstatus: approved 1 \"ok\"\nstatus: stopped 2", "c": "plan: D-3 | x | written t\npass: partial\nread: none", "d": "plan: D-3 | written t\npass: full", "e": "plan: D-3 | x | written t\npass: some", "f": ""}
    plans, statuses, refusals = plan.scan_delivery_plans(as_lines(spark, **files))
    got = {r["file"]: tuple(r)[1:] for r in plans.collect()}
    assert got == {
        "a": ("D-2", "Set | two", 3, "partial", ["A-1", "A-2"], "left out", "approved", 'go "ahead"', "2"), "b": ("D-3", "x", None, "full", None, None, "stopped", None, None), "c": ("D-3", "x", None, "partial", [], None, None, None, None),
    }
    assert sorted((r["file"], r["ord"], r["status"], r["time"], r["words"]) for r in statuses.where("file = 'a'").collect()) == [("a", 1, "shown", "10:03", None), ("a", 2, "approved", "10:04", 'go "ahead"')]
    assert {tuple(r) for r in refusals.collect()} == {("d", "no plan line"), ("e", "pass is neither full nor partial"), ("f", "no plan line")}
