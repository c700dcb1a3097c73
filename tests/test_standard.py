"""Trades' files, the trades that lines name, and who writes each half: every rule by a case that breaks it."""

import pytest

from tessera.sources import standard

HEAD = "# Painting\n\nNumbers: 09 9, 09 90\nHome: 09 90 10\n\n| Kind | Line | Condition | Where to Look | Row Name |\n|---|---|---|---|---|\n".replace("09 9,", "09 96,")
ROW = "| Pricing | Two coats | if shown | A9 | coats |\n"


def scan(spark, **files):
    return standard.scan_standard_lines(spark.createDataFrame([(f, i, x) for f, t in files.items() for i, x in enumerate(t.split("\n"))], "file string, line_no int, line string"))


def test_a_file_and_its_rows(spark):
    files, rows, refusals = scan(spark, a=HEAD + ROW + "| Which Trade | X by Y, Z | | | one ; two |\n# later\n", b=HEAD.replace("Home: 09 90 10", "Home: 09 90, 09 96 00\nElse: Drywall") + ROW)
    assert {r["file"]: (r["title"], r["numbers"], r["homes"], r["otherwise"]) for r in files.collect()} == {"a": ("Painting", ["09 96", "09 90"], ["09 90 10"], None), "b": ("Painting", ["09 96", "09 90"], ["09 90", "09 96 00"], "Drywall")}
    got = {(r["file"], r["ord"]): (r["kind"], r["line"], r["condition"], r["look"], r["names"]) for r in rows.collect()}
    assert got == {("a", 1): ("Pricing", "Two coats", "if shown", "A9", ["coats"]), ("a", 2): ("Which Trade", "X by Y, Z", "", "", ["one", "two"]), ("b", 1): ("Pricing", "Two coats", "if shown", "A9", ["coats"])}
    assert refusals.collect() == []


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ((HEAD + ROW).replace("# ", "#"), "no title"), ((HEAD + ROW).replace("Numbers:", "Number:"), "no Numbers line"), ((HEAD + ROW).replace("09 96, 09 90\n", " , \n"), "no number"), ((HEAD + ROW).replace("09 96,", "0996,"), "a number is no pairs of digits"),
        ((HEAD + ROW).replace("Home", "House"), "no Home line"), ((HEAD + ROW).replace("09 90 10", ""), "no home"), ((HEAD + ROW).replace("09 90 10", "09 90 1"), "a home is no pairs of digits"), ((HEAD + ROW).replace("09 90 10", "09 65"), "a home is under none of the numbers"),
        ((HEAD + ROW).replace("09 90 10", "09 90,09 90"), "a home is there twice"), (HEAD.replace("10\n", "10\nElse:\n") + ROW, "no trade on the Else line"), ((HEAD + ROW).replace("| Kind ", "| Sort "), "does not open its table"), ((HEAD + ROW).replace("|---|---|---|---|---|\n", ""), "does not open its table"), (HEAD, "no line"),
        (HEAD + "| Pricing | a | b | c |", "not five cells"), (HEAD + "| Pricing | a | b | c | d", "not five cells"), (HEAD + "| Price | a | b | c | d |", "no such kind"), (HEAD + "| Pricing | | b | c | d |", "no line in the row"), (HEAD + "| Pricing | a | b | c | |", "no row name"), (HEAD + "| Pricing | a | b | c | d; |", "no row name"),
        (HEAD + f"| Pricing | a | b | c | {'d' * 37} |", "a row name is too long"), (HEAD + "| Pricing | a | b | c | d, e |", "a row name has a comma"), (HEAD + ROW + ROW.replace("coats |\n", "Coats |"), "a row name is used twice"), (HEAD + "| Pricing | a | b | c | d; e |", "not one row name"),
    ],
)
def test_each_rule_of_a_file(spark, text, rule):
    assert [r["rule"] for r in scan(spark, a=text)[2].collect()] == [rule]


TRADES = {"Painting": ["painting"], "Fire Protection": ["fire"], "Protection": ["guard"], "MEP": ["pipes", "wires"], "Drywall": ["drywall"], "Millwork": ["millwork"]}


def halves_of(spark, *cases):
    rows = [("f", i, "Which Trade", line, condition, "", [f"n{k}" for k in range(n)]) for i, (line, condition, n) in enumerate(cases)]
    return standard.which_trade(spark.createDataFrame(rows, "file string, ord int, kind string, line string, condition string, look string, names array<string>"), TRADES, ["Owner"])


def test_halves_shapes_and_conditions(spark):
    halves, refusals = halves_of(
        spark, ("Paint by Painting", "by the mep trades, or fire protection", 1), ("Install by Painting or the Drywall, patched with MEP, as shown Not Fire Protection", None, 2), ("Millwork Install with Painting and Drywall", "", 1),
        ("Set by Owner, wired with MEP", "", 2), ("Set by Owner or Painting", "", 1), ("Bypass by Painting", "", 1), ("Other", "", 1), ("Set by Nobody", "", 1), ("Set by Painting and Drywall or MEP", "", 1),
        ("Set by Painting Not Owner", "", 1), ("Set by Owner and Painting", "", 1), ("Set by Owner", "", 1), ("Set by Painting", "", 2),
    )
    got = {(r["ord"], r["half"]): (r["shape"], r["trades"], r["owner"], r["kept_off"]) for r in halves.collect()}
    assert got == {
        (0, 0): ("one", ["painting"], False, []), (1, 0): ("or", ["painting", "drywall"], False, ["fire"]), (1, 1): ("each", ["pipes", "wires"], False, ["fire"]), (2, 0): ("each", ["painting", "drywall"], False, ["millwork"]),
        (3, 0): ("owner", [], True, []), (3, 1): ("each", ["pipes", "wires"], False, []), (4, 0): ("or", ["painting"], True, []), (5, 0): ("one", ["painting"], False, []),
    }
    assert sorted(halves.where("ord = 0").first()["condition_trades"]) == ["fire", "pipes", "wires"]  # the longer name first, so no guard
    assert {r["ord"]: r["rule"] for r in refusals.collect()} == {
        6: "names no trade", 7: "names no known trade", 8: "joins one list with both words", 9: "keeps the work off the owner", 10: "names the owner beside a trade", 11: "an owner half without one other half", 12: "as many names as halves",
    }


def test_writers_of_each_shape(spark):
    halves, _ = halves_of(spark, ("A by Painting", "Drywall", 1), ("B by Millwork", "Drywall", 1), ("C by Painting or Drywall Not MEP", "", 1), ("D by MEP Not Painting", "", 1), ("E by Millwork or Fire Protection Not MEP", "", 1), ("F by Owner, G by Painting", "Drywall", 2), ("H by Millwork", "", 1))
    places = spark.createDataFrame([("painting", "p-paint"), ("drywall", "p-dry"), ("pipes", "p-b"), ("wires", "p-a"), ("millwork", None)], "trade string, package string")
    carriers = spark.createDataFrame([("f", 0, "pipes")], "file string, ord int, trade string")
    out = standard.half_writers(halves, carriers, places, spark.createDataFrame([("millwork", "06 40")], "trade string, home string"))
    got = {(r["ord"], r["half"]): (r["writers"], [tuple(x) for x in r["records"]], r["left"]) for r in out.collect()}
    x = "exclusion"
    assert got == {
        (0, 0): (["p-paint"], [("p-paint", x, "p-b", "p-paint"), ("p-paint", x, "p-dry", "p-paint")], False), (1, 0): (["p-dry"], [("p-dry", x, "p-dry", "06 40 00")], True),
        (2, 0): (["p-dry"], [("p-dry", "note", "p-dry", ""), ("p-dry", x, "p-a", "none"), ("p-dry", x, "p-b", "none")], True), (3, 0): (["p-a", "p-b"], [("p-a", x, "p-paint", "p-a"), ("p-b", x, "p-paint", "p-b")], False),
        (4, 0): (["p-a"], [("p-a", x, "p-a", "none"), ("p-a", x, "p-b", "none")], True), (5, 0): (["p-paint"], [("p-paint", x, "p-paint", "owner")], False), (5, 1): (["p-paint"], [("p-paint", x, "p-dry", "p-paint")], False), (6, 0): ([], [], True),
    }
