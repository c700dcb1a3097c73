"""Line-oriented files. Every scan takes (file, line_no, line) and gives one row a line, `error` null where the line has its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.grid import kind_of

# The words that the formats close their fields to.
ROW_OUTCOMES = ("recited", "updated", "removed", "not found")
ITEM_OUTCOMES = ("retired", "kept", "refused")
FOLD_LABELS = (
    "folded", "split", "moved", "supplier", "sealant kept", "default", "deleted",
    "owner's work still covered", "kept", "changed", "re-homed", "question", "fold touched",
)
KEYWORDS = ("dispatch", "verified", "note")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of each file, whole lines only: what follows the last line break is not yet written.

    Files of this kind are small, so each is read whole, which numbers its lines without a shuffle; their order is that of the two
    columns. A folder that is not there, or that holds no file, is refused.
    """
    read = spark.read.text(path, wholetext=True)
    if not read.inputFiles():
        raise ValueError(f"no file under {path}")
    files = read.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    whole = F.split("value", "\n", -1)
    return files.select("file", F.posexplode(F.slice(whole, 1, F.size(whole) - 1)).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line")


def _at(tokens: Column, i: int) -> Column:
    return F.get(tokens, F.lit(i))


def after(tokens: Column, word: str) -> Column:
    """The token after the first one that equals `word`."""
    place = F.array_position(tokens, word).cast("int")
    return F.when(place > 0, F.get(tokens, place))


def scan_ledger(lines: DataFrame) -> DataFrame:
    """Runner lines by keyword, phase, pass and unit, with the figures after their names; a keyword with a colon is the lead's."""
    t = F.split(F.trim("line"), r"\s+")
    word = _at(t, 0)
    lead = word.endswith(":")
    runner = word.isin(*KEYWORDS)
    figures = [F.when(word == "verified", after(t, n)).cast("long").alias(n) for n in ("created", "items", "updated", "questions", "replied", "sent", "landed", "conflicts")]
    rest = F.trim(F.regexp_extract("line", r"\ssheets\s+(.*?)(?:\s+purpose\s.*)?$", 1))
    sheets = F.when((word == "dispatch") & (_at(t, 4) == "sheets"), F.array_sort(F.array_distinct(F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != ""))))
    error = F.when(runner & (F.size(t) < 4), "fields missing").when((word == "dispatch") & (_at(t, 4) != "sheets"), "names no sheets").when((word == "verified") & ~F.coalesce(after(t, "result").isin("ok", "mismatch"), F.lit(False)), "no result")
    parsed = lines.select(
        "*", F.when(lead, F.rtrim(word, F.lit(":"))).otherwise(word).alias("keyword"), lead.alias("is_lead"), F.when(runner, _at(t, 1)).alias("phase"), F.when(runner, _at(t, 2)).alias("pass_id"),
        F.when(runner, _at(t, 3)).alias("unit_id"), sheets.alias("sheets"), *figures, F.when(word == "verified", after(t, "result")).alias("result"), error.alias("error"),
    )
    return parsed.where(F.trim("line") != "")


def scan_trades(lines: DataFrame) -> DataFrame:
    """`unit trade code n`, where the code may have blanks and the count is the last word, or `unit touched code`."""
    line = F.trim("line")
    trade, touched = r"^(\S+)\s+trade\s+(\S.*\S|\S)\s+(\d+)$", r"^(\S+)\s+touched\s+(\S.*)$"
    is_trade, is_touched = line.rlike(trade), line.rlike(touched)
    pick = lambda k: F.when(is_trade, F.regexp_extract(line, trade, k)).when(is_touched, F.regexp_extract(line, touched, k))
    kind = F.when(is_trade, "trade").when(is_touched, "touched")
    return lines.where(line != "").select("*", pick(1).alias("unit_id"), kind.alias("kind"), F.regexp_replace(pick(2), r"\s+", " ").alias("code"), F.when(is_trade, F.regexp_extract(line, trade, 3).cast("long")).alias("n"), F.when(kind.isNull(), "neither a trade nor a touched line").alias("error"))


def scan_names(lines: DataFrame) -> DataFrame:
    """Unit, subject and name between tabs, or unit and `none`; a line without a tab names no unit and is skipped."""
    t = F.split("line", "\t", -1)
    unit, none = F.trim(_at(t, 0)), (F.size(t) == 2) & (F.trim(_at(t, 1)) == "none")
    three = F.size(t) == 3
    subject = F.when(three, F.trim(_at(t, 1)))
    error = F.when(~none & ~three, "neither three fields nor none").when(three & ~subject.startswith(F.concat(F.lit("scopeItem:"), unit, F.lit("-"))), "not under the unit's prefix")
    return lines.where(F.contains("line", F.lit("\t"))).select("*", unit.alias("unit_id"), none.alias("is_none"), subject.alias("subject"), F.when(three, F.trim(_at(t, 2))).alias("name"), error.alias("error"))


def last_names(names: DataFrame) -> DataFrame:
    """The name that stands for each unit and subject: that of the last line, files in name order."""
    return names.where("error IS NULL AND NOT is_none").groupBy("unit_id", "subject").agg(F.max_by("name", F.struct("file", "line_no")).alias("name"))


def _cut(line: Column, mark: str) -> tuple[Column, Column]:
    """Text before and after the first mark; after it null where there is none."""
    before = F.substring_index(line, mark, 1)
    return before, F.when(F.contains(line, F.lit(mark)), F.substring(line, F.length(before) + len(mark) + 1, F.length(line)))


def scan_outcomes(lines: DataFrame) -> DataFrame:
    """(kind, key, outcome, page, name, what, error) of lines `row: key | outcome | page | "name" | what` and `item: subject | outcome | what`.

    Outcomes are closed words, another set for each kind; the name is a JSON text, which may hold the separator; `what` may too. A line
    with an error keeps its kind and has no other field. Lines that open with neither word are skipped.
    """
    is_row = _opens("row: ")
    rows = lines.where(is_row | _opens("item: ")).withColumn("kind", F.when(is_row, "row").otherwise("item")).withColumn("_body", F.substring("line", F.when(is_row, 6).otherwise(7), F.length("line")))
    key, rest = _cut(F.col("_body"), " | ")
    rows = rows.withColumn("_key", key).withColumn("_rest", rest)
    outcome, rest = _cut(F.col("_rest"), " | ")
    rows = rows.withColumn("_outcome", outcome).withColumn("_rest", rest)
    page, rest = _cut(F.col("_rest"), " | ")
    rows = rows.withColumn("_page", page).withColumn("_rest", F.when(F.col("kind") == "row", rest).otherwise(F.col("_rest")))
    # the name ends at the first separator after a quote that makes it a whole JSON text
    ends = F.size(F.split("_rest", '" [|] ', -1)) - 1
    name = F.transform(F.when(ends > 0, F.sequence(F.lit(1), ends)), lambda i: F.concat(F.call_function("substring_index", F.col("_rest"), F.lit('" | '), i), F.lit('"')))
    rows = rows.withColumn("_name", F.get(F.filter(name, lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)) == "STRING", F.lit(False))), F.lit(0)))
    row, word = F.col("kind") == "row", lambda c: F.coalesce(F.col(c).rlike(r"^\S+$"), F.lit(False))
    error = (
        F.when(~word("_key"), "no key")
        .when(~row & (~F.startswith("_key", F.lit("scopeItem:")) | (F.col("_key") == "scopeItem:")), "no item")
        .when(~F.coalesce(F.col("_outcome").isin(*ROW_OUTCOMES) & row | F.col("_outcome").isin(*ITEM_OUTCOMES) & ~row, F.lit(False)), "no outcome of its kind")
        .when(row & (F.coalesce("_page", F.lit("")) == ""), "no page")
        .when(row & F.col("_name").isNull(), "no quoted name")
        .when(~row & (F.coalesce("_rest", F.lit("")) == ""), "does not say what")
    )
    rows = rows.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    what = F.when(row, F.substring("_rest", F.length("_name") + 4, F.length("_rest"))).otherwise(F.col("_rest"))
    return rows.select(*lines.columns, "kind", good(F.col("_key")).alias("key"), good(F.col("_outcome")).alias("outcome"), good(F.when(row, F.col("_page"))).alias("page"), good(F.try_variant_get(F.try_parse_json("_name"), "$", "string")).alias("name"), good(what).alias("what"), "error")


def _opens(word: str) -> Column:
    return F.startswith("line", F.lit(word))


def scan_fold_report(lines: DataFrame) -> DataFrame:
    """Each line's label, the longest that opens it, and the package of a deleted line; blank lines are skipped.

    A deleted line reads `deleted: <what>, trade <trade>, package <id>, <why>`: the id opens with `pkg-`, a trade has no comma, and
    neither has angle brackets, as a line copied from the instructions would.
    """
    rows = lines.withColumn("_line", F.trim("line")).where(F.col("_line") != "")
    label = F.lit(None).cast("string")
    for x in sorted(FOLD_LABELS, key=len):
        label = F.when(F.startswith("_line", F.lit(f"{x}: ")), x).otherwise(label)
    rows = rows.withColumn("label", label).withColumn("_body", F.when(F.col("label") == "deleted", F.substring("_line", F.lit(len("deleted: ") + 1), F.length("_line"))))
    before, after_ = _cut(F.col("_body"), ", package pkg-")
    rows = rows.withColumn("_before", before).withColumn("_after", after_)
    package, why = _cut(F.col("_after"), ", ")
    trade = F.substring_index("_before", ", trade ", -1)
    plain = lambda c: (F.length(c) > 0) & ~F.contains(c, F.lit(",")) & ~F.contains(c, F.lit("<")) & ~F.contains(c, F.lit(">"))
    what = F.length("_before") - F.length(trade) - len(", trade ")
    shape = (what > 0) & F.contains("_before", F.lit(", trade ")) & plain(trade) & plain(package) & ~package.rlike(r"\s") & (F.length(why) > 0)
    fits = F.coalesce(shape, F.lit(False))
    error = F.when(F.col("label").isNull(), "opens with no label").when((F.col("label") == "deleted") & ~fits, "not the shape of a deleted line")
    return rows.select(*lines.columns, "label", F.when(fits, F.concat(F.lit("pkg-"), package)).alias("package"), error.alias("error"))


def scan_relation(text: DataFrame, column: str) -> DataFrame:
    """`name=code,code; ...` as (place, name, codes, error): the codes follow the last =, the first one leads and may lead once."""
    part = text.select(F.posexplode(F.split(column, ";")).alias("place", "part")).where(F.trim("part") != "")
    name = F.regexp_replace(F.trim(F.regexp_extract("part", r"^(.*)=[^=]*$", 1)), r"\s+", " ")
    codes = F.array_distinct(F.filter(F.transform(F.split(F.substring_index("part", "=", -1), ","), lambda x: F.trim(x)), lambda x: x != ""))
    error = F.when(~F.contains("part", F.lit("=")), "no =").when(F.size(codes) == 0, "no code").when(F.exists(codes, lambda x: ~x.rlike(r"^\d\d( \d\d)*$")), "not a code").when(name == "", "no name")
    return part.select("place", name.alias("name"), codes.alias("codes"), error.alias("error"))


def scan_jsonl(lines: DataFrame, schema: str) -> DataFrame:
    """Objects of the lines that are JSON of the schema; all others are skipped."""
    bad = "_corrupt"
    return lines.select("*", F.from_json("line", f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad}).alias("x")).where(F.col("x").isNotNull() & F.col(f"x.{bad}").isNull()).select("file", "line_no", "x.*").drop(bad)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents or a refusal; nothing of a broken file is used."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_pages(pages: DataFrame) -> DataFrame:
    """(file, page_ord, row_ord, sheet) of grid pages (file, json): an object with `sheets` or a bare array of rows.

    Pages are in the order of `offset` where every page has one, else of their names.
    """
    variant = F.parse_json("json")
    bare = F.schema_of_variant(variant).startswith("ARRAY")
    offset = F.try_variant_get(variant, "$.offset", "bigint")
    rows = F.when(bare, F.try_variant_get(variant, "$", "array<variant>")).otherwise(F.try_variant_get(variant, "$.sheets", "array<variant>"))
    all_have = pages.select(offset.alias("offset")).agg(F.coalesce(F.bool_and(F.col("offset").isNotNull()), F.lit(False)).alias("all_have"))
    read = pages.select("file", offset.alias("offset"), rows.alias("rows")).join(F.broadcast(all_have))
    order = F.when(F.col("all_have"), F.col("offset"))
    return read.select("file", F.struct(order.alias("o"), F.col("file").alias("f")).alias("page_ord"), F.posexplode("rows").alias("row_ord", "sheet"))


def scan_packages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, refusals) of files of packages (file, json), each a JSON list of objects.

    packages: (file, place, id, trade_code, codes, name) of every object in the shape: a non-empty text as `id` and as `tradeCode`, and
    `codes` a list of texts. refusals: (file, place, rule): no list (place null), an object without one of these, and each that has
    an id that the file has before. Null files are passed over; other fields and columns are ignored.
    """
    read = files.where("file is not null").select("file", F.try_parse_json("json").alias("v"))
    is_list = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")), F.lit(False))
    each = read.where(is_list).select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("place", "x"))
    x = F.col("x")
    text = lambda p: F.when(kind_of(x, p) == "STRING", F.nullif(F.trim(F.try_variant_get(x, p, "string")), F.lit("")))
    codes = F.when(F.startswith(kind_of(x, "$.codes"), F.lit("ARRAY")), F.try_variant_get(x, "$.codes", "array<variant>"))
    each = each.select("file", "place", text("$.id").alias("id"), text("$.tradeCode").alias("trade_code"), codes.alias("_codes"), text("$.name").alias("name"))
    texts = ~F.exists("_codes", lambda c: ~F.coalesce(F.schema_of_variant(c) == "STRING", F.lit(False)))
    again = F.row_number().over(Window.partitionBy("file", "id").orderBy("place")) > 1
    rule = F.when(F.col("id").isNull(), "no id").when(F.col("trade_code").isNull(), "no tradeCode").when(F.col("_codes").isNull() | ~texts, "codes are no list of texts").when(again, "an id is there twice")
    each = each.withColumn("rule", rule)
    packages = each.where("rule is null").select("file", "place", "id", "trade_code", F.transform("_codes", lambda c: F.try_variant_get(c, "$", "string")).alias("codes"), "name")
    whole = read.where(~is_list).select("file", F.lit(None).cast("int").alias("place"), F.lit("no list of packages").alias("rule"))
    return packages, whole.union(each.where("rule is not null").select("file", "place", "rule"))


def scan_deliveries(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(id, issue, still_reading, error) beside the columns of `lines` (line), a delivery's JSON object each.

    `issue` has three values, `set`, `addendum` and a JSON null, which is not the same as no `issue`; `stillReading` is a boolean. A strict
    scan refuses whatever else; the lenient one takes another issue as null and another flag as false, and refuses only what has no id.
    """
    v = F.try_parse_json("line")
    kind, flag = kind_of(v, "$.issue"), kind_of(v, "$.stillReading").eqNullSafe("BOOLEAN")
    issue = F.when(kind == "STRING", F.try_variant_get(v, "$.issue", "string"))
    known = F.coalesce(issue.isin("set", "addendum"), F.lit(False))
    own = F.when(kind_of(v, "$.id") == "STRING", F.nullif(F.try_variant_get(v, "$.id", "string"), F.lit("")))
    error = F.when(own.isNull(), "no delivery")
    if strict:
        error = error.when(kind.isNull(), "no issue").when(~known & (kind != "VOID"), "another issue").when(~flag, "stillReading is no flag")
    good = lambda c: F.when(error.isNull(), c)
    reading = F.when(flag, F.try_variant_get(v, "$.stillReading", "boolean")).otherwise(False)
    return lines.select("*", good(own).alias("id"), good(F.when(known, issue)).alias("issue"), good(reading).alias("still_reading"), error.alias("error"))
