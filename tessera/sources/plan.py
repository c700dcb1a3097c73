"""Read plans and pass summaries as tables of their blocks, units and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import phase

# Headings and words of the two formats.
PLAN_HEADER, PASS_HEADING, LEFT_OUT = "# Read plan: window ", "### ", "## Deliberately left out"
NO_TRADE, NO_TRADES_FILE = "trades: no trade on any unit of this pass", "trades: no trades file for this pass"
TOTALS = ("created", "items", "updated", "questions", "replied")
RECHECK = ("recited", "updated", "removed", "not found", "retired", "kept", "refused")


def _number(word: Column) -> Column:
    """A whole number from 1 on, written plainly; else null."""
    return F.when(word.rlike("^[1-9][0-9]*$"), word.cast("long"))


def _opens(line: Column, word: str) -> Column:
    return F.startswith(line, F.lit(word))


def scan_plan(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(passes, units, fields, refusals) of read plans, from their lines (file, line_no, line); many files at once.

    A plan opens (blank lines apart) with `# Read plan: window <1, 2, 3 or r>`. A heading `### <pass>. <title>` opens a pass's block,
    which ends at the next one; from the heading of what was left out on nothing is read, though its lines look like units. In a
    block, a unit's line is `<unit>. <text>`, the unit's id ending in a dash and a number, or, in window 3, `<ordinal>. <unit>: <text>`;
    a field's line is `<words>: <value>`, words in small letters, of which the last of a name counts. Every other line is passed over.

    passes: (file, window, pass, ord, units, listed): the number that its field names and the unit lines found; units: (file, pass, ord, unit,
    text); fields: (file, pass, field, value). Refused, with the pass or null for the file, are a file without the header, a block whose
    `units` is absent or not the number of its unit lines, a unit that a block lists twice, and a pass with two blocks. Null lines are blank.
    """
    read = lines.where("file is not null and line_no is not null").select("file", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    trimmed = F.trim("line")
    head = read.where(trimmed != "").groupBy("file").agg(F.min_by(trimmed, "line_no").alias("head"))
    files = read.select("file").distinct().join(head, "file", "left")
    window = F.when(_opens(F.col("head"), PLAN_HEADER), phase(F.substring("head", F.lit(len(PLAN_HEADER) + 1), F.length("head"))))
    files = files.select("file", window.alias("window"))
    order = Window.partitionBy("file").orderBy("line_no")
    out = F.max(trimmed == LEFT_OUT).over(order)
    name = F.regexp_extract("line", r"^### (\S+?)\.\s", 1)
    heading = F.when(_opens(F.col("line"), PASS_HEADING) & (name != ""), name)
    marked = read.withColumn("out", out).where("not out").withColumn("heading", heading)
    block = F.struct(F.col("line_no").alias("at"), F.col("heading").alias("pass"))
    marked = marked.withColumn("block", F.last(F.when(F.col("heading").isNotNull(), block), ignorenulls=True).over(order)).where("block is not null")
    marked = marked.join(files.where("window is not null"), "file").select("file", "window", F.col("block.at").alias("at"), F.col("block.pass").alias("pass"), "line_no", "line", "heading")

    label, rest = F.substring_index("line", ". ", 1), F.substring("line", F.length(F.substring_index("line", ". ", 1)) + 3, F.length("line"))
    dotted = F.contains("line", F.lit(". "))
    is_three = F.col("window") == "3"
    sheet = F.when(dotted & label.rlike(r"^\S+-[1-9][0-9]*$"), label)
    subject = F.substring_index(rest, ": ", 1)
    review = F.when(dotted & _number(label).isNotNull() & F.contains(rest, F.lit(": ")) & subject.rlike(r"^\S+$"), subject)
    unit = F.when(is_three, review).otherwise(sheet)
    about = F.when(is_three, F.substring(rest, F.length(subject) + 3, F.length(rest))).otherwise(rest)
    words = F.substring_index("line", ": ", 1)
    field = F.when(unit.isNull() & F.contains("line", F.lit(": ")) & words.rlike("^[a-z][a-z ]*$"), words)
    marked = marked.select("*", unit.alias("unit"), about.alias("text"), field.alias("field"), F.trim(F.substring("line", F.length(words) + 3, F.length("line"))).alias("value"))

    found = marked.where("unit is not null").select("file", "at", "pass", F.row_number().over(Window.partitionBy("file", "at").orderBy("line_no")).alias("ord"), "unit", "text")
    fields = marked.where("field is not null").groupBy("file", "at", "pass", "field").agg(F.max_by("value", "line_no").alias("value"))
    n = marked.groupBy("file", "window", "at", "pass").agg(F.count("unit").alias("listed"), F.max(F.when(F.col("field") == "units", F.struct("line_no", "value")))["value"].alias("units"))
    n = n.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    none = F.lit(None).cast("string")
    refusals = files.where("window is null").select("file", none.alias("pass"), F.lit("no read plan").alias("rule"))
    counts = F.when(F.col("units").isNull(), "names no units").when(F.col("units") != F.col("listed").cast("string"), "units and unit lines differ")
    refusals = refusals.union(n.select("file", "pass", counts.alias("rule")).where("rule is not null"))
    refusals = refusals.union(found.groupBy("file", "at", "pass", "unit").count().where("count > 1").select("file", "pass", F.lit("a unit is listed twice").alias("rule")).distinct())
    refusals = refusals.union(n.groupBy("file", "pass").count().where("count > 1").select("file", "pass", F.lit("a pass has two blocks").alias("rule")))
    return n.select("file", "window", "pass", "ord", _number(F.col("units")).alias("units"), "listed"), found.drop("at"), fields.drop("at"), refusals


def _figure(line: Column, name: str) -> Column:
    """The number after a name, itself after a blank, comma or semicolon, or with ` rows ` or ` items ` before it."""
    return F.nullif(F.regexp_extract(line, rf"(?:^|[ ,;:])\s?{name} (\d+)(?=$|[ ,;(])", 1), F.lit("")).cast("long")


def scan_summaries(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(summaries, units, trades, refusals) of pass summaries, from their lines (file, line_no, line); many files at once.

    The first line is `window: <n>   pass: <pass>`. Read are `per unit:` lines (unit, created, `-` as null, and whether verified),
    `totals verified:`, `trades:` (`<code> x<n>, ...`, codes may have blanks, a code's figures are added up; or the line for none),
    `review: pages opened <n>, searches <n>`, `recheck: rows ...; items ...` and `ledger lines: <n> sha256 <hash>`; the last line of a kind counts.

    summaries: (file, window, pass, created, items_read, updated, questions, replied, items, pages_opened, searches, recheck (a map),
    ledger_lines, ledger_hash), items being the trades' sum. units: (file, unit, created, verified), the last line of a unit counts. trades: (file, code, n).
    Refused are a file without the header; without a ledger line, totals or trades, each in its shape; one summed with no trades file; a
    window 3 without a review line; a window r without a recheck line. The first rule that a file breaks, in this order, is given. Null lines are blank.
    """
    read = lines.where("file is not null and line_no is not null").select("file", "line_no", F.trim(F.coalesce("line", F.lit(""))).alias("line"))
    line = F.col("line")
    last = lambda test: F.max(F.when(test, F.struct("line_no", "line")))["line"]
    g = read.groupBy("file").agg(
        F.min_by("line", "line_no").alias("head"), last(_opens(line, "totals verified:")).alias("totals"), last(_opens(line, "trades:")).alias("trades"),
        last(_opens(line, "review:")).alias("review"), last(_opens(line, "recheck:")).alias("recheck"), last(_opens(line, "ledger lines:")).alias("ledger"),
    )
    head, ledger = F.split("head", r"\s+"), F.split("ledger", " ")
    fits = (F.size(head) == 4) & (F.get(head, F.lit(0)) == "window:") & (F.get(head, F.lit(2)) == "pass:")
    window = F.when(fits, phase(F.get(head, F.lit(1))))
    hashed = (F.size(ledger) == 5) & (F.get(ledger, F.lit(3)) == "sha256") & F.get(ledger, F.lit(2)).rlike("^[0-9]+$") & F.get(ledger, F.lit(4)).rlike("^[0-9a-f]{64}$")
    total = {k: _figure(F.col("totals"), k) for k in TOTALS}
    again = {k: _figure(F.col("recheck"), k) for k in RECHECK}
    rechecked = F.when(F.lit(True), F.create_map(*[x for k, c in again.items() for x in (F.lit(k), c)]))
    whole = F.lit(True)
    for c in again.values():
        whole = whole & c.isNotNull()
    entry = F.transform(F.split(F.substring("trades", F.lit(9), F.length("trades")), ", "), lambda x: F.struct(F.substring_index(x, " x", 1).alias("a"), x.alias("x")))
    entry = F.transform(entry, lambda e: F.struct(F.regexp_replace(e["x"], r" x[0-9]+$", "").alias("code"), F.nullif(F.regexp_extract(e["x"], r"^.+ x([0-9]+)$", 1), F.lit("")).cast("long").alias("n")))
    none = F.col("trades") == NO_TRADE
    sums = F.when(none, F.array().cast("array<struct<code:string,n:bigint>>")).when(F.startswith("trades", F.lit("trades: ")), entry)
    g = g.select("file", window.alias("window"), F.when(window.isNotNull(), F.get(head, F.lit(3))).alias("pass"), *[c.alias(k if k != "items" else "items_read") for k, c in total.items()], F.col("trades").alias("said"), sums.alias("sums"),
                 _figure(F.col("review"), "pages opened").alias("pages_opened"), _figure(F.col("review"), "searches").alias("searches"), F.when(whole, rechecked).alias("recheck"), F.when(hashed, F.get(ledger, F.lit(2)).cast("long")).alias("ledger_lines"), F.when(hashed, F.get(ledger, F.lit(4))).alias("ledger_hash"))
    bad_trades = F.col("sums").isNull() | F.exists("sums", lambda e: e["n"].isNull())
    rule = (
        F.when(F.col("window").isNull(), "no summary")
        .when(F.col("ledger_hash").isNull(), "no ledger line")
        .when(F.col("updated").isNull() | F.col("questions").isNull() | F.col("replied").isNull(), "no totals")
        .when(F.col("said").isNull(), "no trades line")
        .when(F.col("said") == NO_TRADES_FILE, "summed with no trades file")
        .when(bad_trades, "not the shape of a trades line")
        .when((F.col("window") == "3") & (F.col("pages_opened").isNull() | F.col("searches").isNull()), "no review line")
        .when((F.col("window") == "r") & F.col("recheck").isNull(), "no recheck line")
    )
    g = g.withColumn("rule", rule)
    items = F.aggregate("sums", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    good = g.where("rule is null")
    summaries = good.select("file", "window", "pass", "created", "items_read", "updated", "questions", "replied", items.alias("items"), "pages_opened", "searches", "recheck", "ledger_lines", "ledger_hash")
    trades = good.select("file", F.explode("sums").alias("e")).groupBy("file", "e.code").agg(F.sum("e.n").alias("n"))
    words = F.split("line", " ")
    size = F.size(words)
    verdict, created = F.get(words, size - 1), F.get(words, F.lit(4))
    shape = _opens(line, "per unit: ") & (size >= 8) & (F.get(words, F.lit(3)) == "created") & created.rlike("^([0-9]+|-)$") & (F.get(words, size - 2) == "verified") & verdict.isin("yes", "no")
    unit = read.where(shape).join(good.select("file"), "file", "left_semi")
    units = unit.groupBy("file", F.get(words, F.lit(2)).alias("unit")).agg(F.max_by(F.struct(F.when(created != "-", created.cast("long")).alias("created"), (verdict == "yes").alias("verified")), "line_no").alias("x")).select("file", "unit", "x.*")
    return summaries, units, trades, g.where("rule is not null").select("file", "rule")


def scan_delivery_plans(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plans, statuses, refusals) of the plan files of deliveries, from their lines (file, line_no, line); many at once.

    A line is `<key>: <value>`. Of `plan`, `measured`, `pass`, `read` and `carry` the first one counts, of `carried` the last, and of `status` all, in order:
    `shown`, `approved` or `stopped`, a time, and perhaps words in quotes. A plan's value is `<delivery> | <label> | written <time>`; its pass is `full` or
    `partial`; a partial one reads the sheets listed, `none` or nothing for no sheet.

    plans: (file, delivery_id, label, rule_version, pass, read, carry, status, approved_words, carried): `read` is null for a full pass, which is not an empty list;
    rule_version, the number after these words in `measured`, null without; the status, and an approval's words, of the last status line. statuses: (file, ord,
    status, time, words). refusals: (file, rule), the first broken. A status line of another shape is passed over; null lines are blank.
    """
    read = lines.where("file is not null and line_no is not null").select("file", "line_no", F.rtrim(F.coalesce("line", F.lit(""))).alias("line"))
    line = F.col("line")
    key = F.when(F.contains(line, F.lit(": ")), F.substring_index(line, ": ", 1))
    value = F.trim(F.substring(line, F.length(F.substring_index(line, ": ", 1)) + 3, F.length(line)))
    kv = read.select("file", "line_no", key.alias("key"), value.alias("value"))
    first = lambda k: F.min(F.when(F.col("key") == k, F.struct("line_no", "value")))["value"].alias(f"_{k}")
    g = kv.groupBy("file").agg(*[first(k) for k in ("plan", "measured", "pass", "read", "carry")], F.max(F.when(F.col("key") == "carried", F.struct("line_no", "value")))["value"].alias("carried"))

    words = F.split("value", " ")
    word, time = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    rest = F.substring("value", F.length(word) + F.length(time) + 3, F.length("value"))
    quoted = F.startswith(rest, F.lit('"')) & F.endswith(rest, F.lit('"')) & (F.length(rest) > 1)
    shape = word.isin("shown", "approved", "stopped") & (F.length(time) > 0) & ((rest == "") | quoted)
    told = kv.where((F.col("key") == "status") & F.coalesce(shape, F.lit(False))).select("file", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).alias("ord"), word.alias("status"), time.alias("time"), F.when(quoted, F.substring(rest, F.lit(2), F.length(rest) - 2)).alias("words"))
    last = told.groupBy("file").agg(F.max(F.struct("ord", "status", "words")).alias("s"))

    parts = F.split("_plan", " [|] ")
    written = F.get(parts, F.size(parts) - 1)
    own = F.get(parts, F.lit(0))
    label = F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), " | ")
    headed = (F.size(parts) >= 3) & own.rlike(r"^\S+$") & (F.length(label) > 0) & written.rlike(r"^written \S+$")
    g = g.join(last, "file", "left")
    rule = F.when(~F.coalesce(headed, F.lit(False)), "no plan line").when(~F.coalesce(F.col("_pass").isin("full", "partial"), F.lit(False)), "pass is neither full nor partial")
    sheets = F.when(F.col("_pass") == "partial", F.when(F.coalesce("_read", F.lit("")).isin("", "none"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split("_read", ","), lambda x: F.trim(x)), lambda x: x != "")))
    version = F.nullif(F.regexp_extract("_measured", r"(?:^|\W)rule version ([0-9]+)(?:\W|$)", 1), F.lit("")).cast("long")
    status = F.col("s.status")
    plans = g.where(rule.isNull()).select("file", own.alias("delivery_id"), label.alias("label"), version.alias("rule_version"), F.col("_pass").alias("pass"), sheets.alias("read"), F.col("_carry").alias("carry"), status.alias("status"), F.when(status == "approved", F.col("s.words")).alias("approved_words"), "carried")
    every = read.select("file").distinct().join(g.select("file", rule.alias("rule")), "file", "left").select("file", F.coalesce("rule", F.lit(None).cast("string")).alias("rule"))
    return plans, told, every.where("rule is not null")
